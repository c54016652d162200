import pytest

from tessera.llm import graph


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        graph.connected_components(chain, rounds=2)
    assert {(r.node, r.component) for r in graph.connected_components(chain).collect()} == {(i, 0) for i in range(61)}
