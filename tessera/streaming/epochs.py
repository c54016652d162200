"""A streaming source over a stored table whose offset is an epoch: each batch holds the rows from the last epoch to the newest row.

The driver reads the time range of each row group from the file footers, so finding the
newest row costs no data; a batch has a task for each row group that meets its range. Offsets
live in the query's checkpoint, so a restarted query goes on where it stopped. With a
look-back, rows that arrive late are read again, and what the sink has is skipped by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.sources import buckets

FORMAT = "tessera_epochs"


def micros(value: datetime | date | int) -> int:
    """Microseconds since 1970; times without a zone count as UTC."""
    if isinstance(value, int):
        return value
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    aware = value if value.tzinfo else value.replace(tzinfo=UTC)
    delta = aware - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    low: int
    high: int


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: Sequence[str]):
        self.path, self.time, self.columns = options["path"], options["time"], list(columns)
        self.start, self.back = int(options.get("start", 0)), int(options.get("lookback", 0))
        self.known: dict[tuple, list[tuple[int, int] | None]] = {}

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def _files(self) -> Iterator[tuple[str, list[tuple[int, int] | None]]]:
        """(file, time range of each row group or None); footers are read once."""
        store, root = self._store()
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for f in found:
            name = f.path.rsplit("/", 1)[-1]
            if f.type != fs.FileType.File or not name.endswith(".parquet") or name.startswith((".", "_")):
                continue
            key = (f.path, f.size, f.mtime_ns)
            if key not in self.known:
                with store.open_input_file(f.path) as raw:
                    self.known[key] = self._ranges(pq.ParquetFile(raw))
            yield f.path, self.known[key]

    def _ranges(self, file: pq.ParquetFile) -> list[tuple[int, int] | None]:
        at, out = file.schema_arrow.names.index(self.time), []
        for g in range(file.metadata.num_row_groups):
            s = file.metadata.row_group(g).column(at).statistics
            if s is not None and s.has_min_max:
                out.append((micros(s.min), micros(s.max)))
            else:  # written without statistics: the one column is read
                both = pc.min_max(file.read_row_group(g, columns=[self.time]).column(0))
                out.append(None if both["min"].as_py() is None else (micros(both["min"].as_py()), micros(both["max"].as_py())))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"epoch": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = [r[1] + 1 for _, ranges in self._files() for r in ranges if r]
        return {"epoch": max([self.start, *ends])}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = max(self.start, start["epoch"] - self.back), end["epoch"]
        return [RowGroup(path, g, low, high) for path, ranges in self._files() for g, r in enumerate(ranges) if r and r[1] >= low and r[0] < high]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as raw:
            table = pq.ParquetFile(raw).read_row_group(partition.group, columns=list(dict.fromkeys([*self.columns, self.time])))
        at = table.column(self.time).cast(pa.timestamp("us"), safe=False).cast(pa.int64())
        if pa.types.is_date(table.schema.field(self.time).type):
            at = table.column(self.time).cast(pa.date32()).cast(pa.int32()).cast(pa.int64())
            at = pc.multiply(at, 86_400_000_000)
        yield from table.filter(pc.and_(pc.greater_equal(at, partition.low), pc.less(at, partition.high))).select(self.columns).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing to give back: rows stay in the table."""


class EpochTable(DataSource):
    """Options: path, time (column), start (epoch, microseconds), lookback (microseconds). The schema names the columns to read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return EpochReader(dict(self.options), schema.names)


def source(spark: SparkSession, path: str, schema: str, time: str, start: int = 0, lookback: int = 0) -> DataFrame:
    """Rows of a parquet table from an epoch on. Rows without a time are in no epoch."""
    spark.dataSource.register(EpochTable)
    options = {"path": path, "time": time, "start": str(start), "lookback": str(lookback)}
    return spark.readStream.format(FORMAT).schema(schema).options(**options).load()


def sync_sink(path: str, state: str, name: str, keys: Sequence[str], time: str, each: Callable[[DataFrame], DataFrame] = lambda df: df, n: int = buckets.BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch: rows whose key the table has are skipped, the rest are inserted, then the epoch of `name` moves past the newest row.

    A batch that runs again inserts nothing and stores the same epoch; the epoch never goes back.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        buckets.insert_new(each(batch), path, keys, n)
        plain = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(`{time}` AS TIMESTAMP_NTZ))")  # as the reader counts
        at = F.unix_micros(time) if dict(batch.dtypes)[time] == "timestamp" else plain
        last = batch.agg((F.max(at) + 1).alias("epoch")).filter("epoch is not null")
        buckets.upsert(last.select(F.lit(name).alias("name"), "epoch", F.lit(number).cast("long").alias("batch")), state, ["name"], "epoch", 1)

    return run


def stored_epoch(spark: SparkSession, state: str, name: str) -> int:
    """Where the next sync starts; 0 before the first."""
    if not buckets.exists(spark, state):
        return 0
    row = buckets.read(spark, state).filter(F.col("name") == name).first()
    return row["epoch"] if row else 0


def missing_parts(spark: SparkSession, first: str, last: str, tables: dict[str, tuple[DataFrame, str]], again: int = 1) -> DataFrame:
    """(day, table) that a sync of first..last must fetch: days a table lacks, and its last `again` days, which may be partial. One anti join for all tables."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    wanted = days.withColumn("table", F.explode(F.array(*map(F.lit, tables))))
    held = None
    for name, (df, day) in tables.items():
        own = df.select(F.to_date(day).alias("day"), F.lit(name).alias("table")).distinct()
        held = own if held is None else held.unionByName(own)
    held = held.filter(F.col("day") <= F.date_sub(F.lit(last).cast("date"), again))
    return wanted.join(held, ["day", "table"], "left_anti")
