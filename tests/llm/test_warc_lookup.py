import tempfile
from pathlib import Path

import pytest
import reference as R
from pyspark.sql import functions as F

from tessera.llm import queries, warc
from tessera.llm.common import new_folder


@pytest.mark.parametrize("most", [warc.DIRECTORY_BYTES, 100])
def test_lookup_finds_every_key(spark, monkeypatch, most):
    """Both ways through the directory, with keys over many blocks, in several, before the first, after the last, and with tabs and line ends."""
    monkeypatch.setattr(warc, "DIRECTORY_BYTES", most)
    odd = ["http://a.example/x\ty", "http://a.example/x%09y", "http://a.example/x\\ty", "http://b.example/p\nq", "http://b.example/p\\nq", "http://c.example/\\\\t"]
    urls = [f"http://h{i % 7}.example/{i}" for i in range(150)] + ["http://m.example/hot"] * 40 + odd
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    records = warc.write_archive(pages, folder)
    directory = warc.write_index(records, folder, block_lines=5)
    assert directory.count() > 30
    keys = spark.createDataFrame([("aaa)/",), ("zzz)/",), (None,), ("example,m)/",)], "surt string").union(pages.filter("page_id % 2 = 0 or page_id >= 150").select(warc.surt(F.col("url"))))
    found = warc.lookup(spark, folder, keys).select("surt", "page_id", "file", "offset", "size")
    want = records.join(keys.distinct(), "surt", "left_semi").select("surt", "page_id", "file", "offset", "size")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.filter("page_id >= 150").count() == 46


def test_repeated_ids_and_null_keys(spark):
    """An id that repeats with another payload is two records, each with its own length."""
    pages = spark.createDataFrame([(1, "u", "AAA"), (1, "u", "BBBBB"), (2, "v", "AAA"), (3, None, "BBBBB")], "page_id long, url string, html string")
    with tempfile.TemporaryDirectory() as folder:
        pages.write.parquet(f"{folder}/pages.parquet")
        got = [tuple(r) for r in queries.op5_warc_round_trip(spark, folder).collect()]
    a, b = R.sha1_32(b"AAA"), R.sha1_32(b"BBBBB")
    assert sorted(got, key=str) == [(1, 3, a, "response", None), (1, 5, b, "response", None), (2, 3, a, "revisit", 1), (3, 5, b, "revisit", 1)]


def test_archives_agree(spark):
    """The same pages in another order are the same bytes."""
    rows = [(i, f"http://h{i % 3}.example/{i}", "x" * (i % 5)) for i in range(60)]
    files = []
    for some in (rows, rows[::-1]):
        folder = new_folder(spark, "warc")
        warc.write_archive(spark.createDataFrame(some, "page_id long, url string, html string").repartition(3, "page_id"), folder)
        files.append({p.name: p.read_bytes() for p in Path(folder.removeprefix("file://")).glob("part-*.warc.gz")})
    assert files[0] == files[1] and files[0]


def test_round_trip_reads_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 1000)
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"{i}" * 50) for i in range(400)], "page_id long, url string, html string")
    tasks = warc.round_trip(pages).withColumn("_task", F.spark_partition_id()).groupBy("_task").count().count()
    assert tasks > 1


def test_round_trip_looks_keys_up(spark, monkeypatch):
    asked = []
    lookup = warc.lookup
    monkeypatch.setattr(warc, "lookup", lambda s, folder, keys: asked.append(keys.count()) or lookup(s, folder, keys))
    pages = spark.createDataFrame([(1, "http://a.example/", "x"), (2, "http://a.example/", "x"), (3, None, "y"), (3, "http://b.example/\t", None)], "page_id long, url string, html string")
    read = warc.round_trip(pages)
    assert sorted((r.page_id, r.record_type, bytes(r.payload)) for r in read.collect()) == [(1, "response", b"x"), (2, "revisit", b""), (3, "response", b""), (3, "response", b"y")]
    assert asked == [4]
