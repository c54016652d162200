import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    """Odd documents: null, empty, blank, one word, periodic, accents and NUL, copies, near copies, shared passages, a long one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(60)
    near = base.split()
    near[3] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "a" * 700), (6, "a" * 200), (7, "the " * 80), (8, "the " * 25), (9, "é中\U0001f600 " * 90),
        (10, base), (11, base), (12, " ".join(near)), (13, base.upper()), (14, text(30) + " " + passage + " " + text(30)), (15, text(10) + "  " + passage + "\n" + text(50)),
        (16, "nul\x00byte " * 30), (17, text(6000)), (18, passage), (19, "w1 w2 w3"), (20, "w1 w2 w3"), (21, "W1 w2 w3"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The odd documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, i, True, "x") for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, kept boolean, node string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
