"""Vector code compression: product quantisation with integer codebooks, searched by partial distances.

Components become floor(scale * x). Each round assigns every part of every vector to the
nearest entry of its codebook and replaces entries by the floored mean of their parts:
tasks sum their own parts per (part, entry), Spark adds those sums, and only the
parts x entries means come to the driver, whatever the number of rows. All sums are integers, so
results don't depend on order or partitions.

The search adds squared differences dimension by dimension, in descending variance of
the codebook. The entry that leads so far is completed, which gives the current best
complete distance of a row; entries whose accumulated distance strictly exceeds it are
dropped by masks over all rows of a block at once, so ties survive to the end, where the lower index wins.

Defined results: rows whose vector is null or holds null or non-finite components are
left out; the first codebook takes null ids last, and equal ids in order of their
components; fewer rows than entries give fewer entries; repeated rows give a row each;
null labels are a group of their own; an empty table gives no rows. Vectors of unequal
length, of a length that the parts don't divide, or so large that distances pass 64 bits
are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows searched together; dimensions added to all entries before the first are dropped, and then between two rounds of dropping.
ROWS, HEAD, STEP = 512, 12, 4


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower of equals, and its squared distance) for each row of integers."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if (2 * most) ** 2 * len(order) < 1 << 31 else np.int64
    x, book = np.ascontiguousarray(x[:, order], kind), np.ascontiguousarray(book[:, order], kind)
    found = [_search(x[i : i + ROWS], book) for i in range(0, len(x), ROWS)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code, error = (np.concatenate(f) for f in zip(*found, strict=True))
    return code, error.astype(np.int64)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size = x.shape
    head = min(HEAD, size)
    done, step = np.zeros((n, len(book)), x.dtype), np.empty((n, len(book)), x.dtype)
    for d in range(head):
        np.subtract(x[:, d, None], book[None, :, d], out=step)
        np.multiply(step, step, out=step)
        done += step
    best = _squares(x - book[done.argmin(1)])
    left = np.flatnonzero(done <= best[:, None])
    row, entry = np.divmod(left, len(book))
    done = done.ravel()[left]
    for d in range(head, size, STEP):
        done = done + _squares(x[row, d : d + STEP] - book[entry, d : d + STEP])
        lead = entry[_first_least(row, done, n)]
        best = np.minimum(best, _squares(x - book[lead]))
        keep = done <= best[row]
        row, entry, done = row[keep], entry[keep], done[keep]
    at = _first_least(row, done, n)
    return entry[at], done[at]


def _first_least(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Position of each row's least value, the first of equals; rows are in order and each is there."""
    least = np.minimum.reduceat(value, np.searchsorted(row, np.arange(n)))
    hit = np.nonzero(value == least[row])[0]
    return hit[np.searchsorted(row[hit], np.arange(n))]


def _blocks(b: pa.RecordBatch, size: int) -> np.ndarray:
    flat = b.column("ints")
    return flat.flatten().to_numpy().reshape(len(flat), size)


def integers(df: DataFrame, *, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """_id, _label and ints of the rows whose components are all finite numbers, as a written table."""
    vector = F.col(vector_col).cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(vector.isNotNull() & whole).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), vector.alias("_vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("_vector")
            value = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
            if len(value) and np.abs(value).max() >= 1 << 53:
                raise ValueError("components are too large for exact integers")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(vectors.value_lengths())]), pa.int32()), pa.array(value.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), lists], names=["_id", "_label", "ints"])

    kind = dict(rows.dtypes)
    return written(rows.mapInArrow(run, f"_id {kind['_id']}, _label {kind['_label']}, ints array<long>"), "integers")


def _size(rows: DataFrame, parts: int) -> int:
    """The length of all vectors, checked."""
    largest = F.greatest(F.array_max("ints"), -F.array_min("ints"))
    low, high, most = rows.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.max(largest)).first()
    if low is None:
        return 0
    if low != high or low % parts:
        raise ValueError(f"vectors must have one length that {parts} divides, not {low} to {high}")
    if most is not None and (2 * most) ** 2 * (low // parts) >= 1 << 62:
        raise ValueError("components are too large: squared distances would pass 64 bits")
    return low


def fit(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x length) of integer rows."""
    size = _size(rows, parts)
    wide = size // parts
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "ints").select("ints").limit(entries).toArrow().column("ints").to_pylist()
    books = np.array(first, np.int64).reshape(len(first), parts, wide).swapaxes(0, 1)
    if not size or not len(first):
        return books
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books = sent.value
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in batches:
                x = _blocks(b, size)
                for p, book in enumerate(books):
                    own = x[:, p * wide : (p + 1) * wide]
                    code, _ = nearest(own, book)
                    count[p] += np.bincount(code, minlength=len(book))
                    np.add.at(total[p], code, own)
            part, entry = np.nonzero(count)
            flat = total[part, entry].ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * wide, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists], names=["part", "entry", "n", "sums"])

        partial = rows.select("ints").mapInArrow(run, "part long, entry long, n long, sums array<long>")
        sums = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(wide))).alias("sums")
        got = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums).toArrow()  # at most parts x entries rows
        part, entry, n = (got.column(c).to_numpy() for c in ("part", "entry", "n"))
        books = books.copy()
        if len(part):
            books[part, entry] = np.array(got.column("sums").to_pylist(), np.int64) // n[:, None]
        sent.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """_id, _label, code (an index per part) and error (their squared distances together) of integer rows."""
    sent, kind = rows.sparkSession.sparkContext.broadcast(books), dict(rows.dtypes)
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _blocks(b, parts * wide)
            found = [nearest(x[:, p * wide : (p + 1) * wide], book) if wide else (np.zeros(len(x), np.int64),) * 2 for p, book in enumerate(sent.value)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), lists, pa.array(sum(error for _, error in found))], names=["_id", "_label", "code", "error"])

    return rows.mapInArrow(run, f"_id {kind['_id']}, _label {kind['_label']}, code array<int>, error long")


def compress(df: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error and label_error of every kept row; codebooks)."""
    rows = integers(df, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    books = fit(rows, parts=parts, entries=entries, rounds=rounds)
    coded = written(encode(rows, books), "codes")
    sums = written(coded.groupBy(F.col("_label").alias("_same")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = coded.join(small_side(sums), F.col("_label").eqNullSafe(F.col("_same")), "left")
    return found.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
