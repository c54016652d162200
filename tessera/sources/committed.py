"""A sink that shows only what a commit has published: a Spark data source with its own writer.

Tasks buffer rows, keep the last row of each key in a buffer, and write every buffer to a
file that carries the task attempt in its name. The driver publishes one manifest with
the files of the attempts that counted, so files of a failed or repeated attempt are never
read. When a job is given up, the files of its finished tasks can still be published: work done
is kept, and the next run does the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .buckets import newest

FORMAT = "tessera_committed"
#: Rows that a task holds before it writes them.
BUFFER_ROWS = 50_000
#: Files of one manifest are numbered below this.
FLUSHES = 1 << 24


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[str]:
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


def last_wins(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    """The last row of each key, in order of arrival; null is a key."""
    if not keys:
        return table
    placed = table.select(keys).append_column("_at", pa.array(range(len(table)), pa.int64()))
    last = placed.group_by(list(keys), use_threads=False).aggregate([("_at", "max")]).column("_at_max")
    return table.take(last.combine_chunks().sort())


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.rows = int(options.get("bufferrows") or options.get("bufferRows") or BUFFER_ROWS)
        self.keep = (options.get("keepfinished") or options.get("keepFinished") or "false") == "true"
        done = _manifests(self.path)
        self.number = int(done[-1].rsplit("/", 1)[1].split(".")[0]) + 1 if done else 1
        self.token = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        task, held, count, names = TaskContext.get(), [], 0, []

        def flush() -> None:
            nonlocal held, count
            if count:
                table = last_wins(pa.Table.from_batches(held), self.keys)
                place = self.number * FLUSHES + len(names)
                names.append(f"data/{self.token}-{task.partitionId()}-{task.taskAttemptId()}-{len(names)}.parquet")
                with store.open_output_stream(f"{root}/{names[-1]}") as out:
                    pq.write_table(table.append_column("_flush", pa.array([place] * len(table), pa.int64())), out, compression="zstd")
            held, count = [], 0

        for batch in iterator:
            for at in range(0, len(batch), self.rows):
                held.append(part := batch.slice(at, self.rows))
                count += len(part)
                if count >= self.rows:
                    flush()
        flush()
        return Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        names = [n for m in messages if m for n in m.names]
        if not names:
            return
        store.create_dir(f"{root}/_manifests", recursive=True)
        draft = f"{root}/_manifests/.{self.token}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(names).encode())
        store.move(draft, f"{root}/_manifests/{self.number:08d}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.keep:
            return self.commit(messages)
        store, root = _store(self.path)
        for m in messages:
            for n in m.names if m else []:
                store.delete_file(f"{root}/{n}")


class CommittedFiles(DataSource):
    """Options: path, keys (comma-joined), bufferRows, keepFinished."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("this sink only appends")
        return _Writer(dict(self.options))


def save(df: DataFrame, path: str, keys: Sequence[str] = (), buffer_rows: int = BUFFER_ROWS, keep_finished: bool = False) -> None:
    """One job, published as a whole; with `keep_finished` the finished tasks of a failed job are published."""
    df.sparkSession.dataSource.register(CommittedFiles)
    options = {"path": path, "keys": ",".join(keys), "bufferRows": str(buffer_rows), "keepFinished": str(keep_finished).lower()}
    df.write.format(FORMAT).options(**options).mode("append").save()


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Published rows with `_flush` (grows with each buffer of a task, and from run to run); None before the first."""
    store, _ = _store(path)
    names = []
    for m in _manifests(path):
        with store.open_input_stream(m) as f:
            names += json.loads(f.read())
    if not names:
        return spark.createDataFrame([], f"{schema}, _flush long") if schema else None
    reader = spark.read.schema(f"{schema}, _flush long") if schema else spark.read
    return reader.parquet(*(f"{path}/{n}" for n in names))


def flush_latest(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buffer_rows: int = BUFFER_ROWS) -> None:
    """Buffers rows in order and flushes them; a key's rows pass one task, so a later flush of it is newer."""
    save(df.repartition(*keys).sortWithinPartitions(*order), path, keys, buffer_rows)


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The row of each key that was flushed last."""
    return newest(read(spark, path), keys, F.col("_flush")).drop("_flush")


def process_missing(keys: DataFrame, path: str, key_cols: Sequence[str], work: Callable[[DataFrame], DataFrame], tasks: int | None = None) -> int:
    """Restartable: works on keys that the sink lacks, in one job; what its tasks finish is kept even if it fails. Returns the keys it went for."""
    spark = keys.sparkSession
    todo = keys.select(*key_cols).distinct()
    done = read(spark, path)
    if done is not None:
        todo = todo.join(done.select(*key_cols).distinct(), list(key_cols), "left_anti")
    count = todo.count()
    if count:
        save(work(todo.repartition(tasks, *key_cols) if tasks else todo), path, key_cols, keep_finished=True)
    return count
