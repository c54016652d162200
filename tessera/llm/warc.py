"""WARC archives with a two-level capture index.

Writing: a digest of each payload groups equal ones; the least page id of a group is the
response, the others are revisits that refer to it. Each task writes its pages as one
archive file of gzip members, one per record, straight into the shared folder, and
returns a row per record. Index: rows sorted by reversed-host URL key go into blocks of
lines, one gzip member each; the sparse directory keeps the first key and place of every
block. A look-up binary-searches the directory, reads and scans the blocks it names, and
range-reads the records. Files are written under a temporary name and moved, and each task
writes in order of digest and page, so a task that runs again replaces the same file with
the same bytes. Tasks that read are as many as the bytes of the archive ask for.

Defined results: a null payload is empty; empty payloads are deduplicated like others
unless `least_bytes` is above 0; a null url is an empty key; rows that repeat a page id
each become a record, all of them responses where that id is the least of its payload; a
null key finds nothing; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bytes_of, new_folder, written

BLOCK_LINES = 300
#: Bytes of a directory up to which it is held in each task; beyond, look-ups merge all keys with it in order.
DIRECTORY_BYTES = BROADCAST_BYTES
#: Bytes that one task reads of an archive or index, and the least that is worth a task of its own.
TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
_RECORD = "file string, offset long, size long, surt string, page_id long, record_type string, digest string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _tasks(spark: SparkSession, size: int) -> int:
    return max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))


class _Sink:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root)
        context = TaskContext.get()
        self.final, self.own = f"{root}/{name}", f"{root}/.{name}.{context.taskAttemptId()}"
        self.out, self.at = self.fs.open_output_stream(self.own, compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        start, self.at = self.at, self.at + len(data)
        return start, len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.final)


def surt(url: Column) -> Column:
    """Reversed-host key: com,example,www)/path?query, lower-case, without scheme, user, port 80/443 and fragment."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@|:(80|443)?$", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(tail == "", "/").otherwise(tail))


def _record(kind: str, page: int | None, url: str, digest: str, payload: bytes, refers: int | None) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(payload)}")
    block = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(block) + pack.flush()


def write_archive(pages: DataFrame, folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Writes the records; a written table of (file, offset, size, surt, page_id, record_type, digest)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    digest = F.sha1("html")
    first = (
        rows.filter(F.octet_length("html") >= least_bytes).groupBy(digest.alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_digest", "_first")
    )
    marked = rows.withColumn("_digest", digest).join(first, "_digest", "left").withColumn("surt", surt(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        sink = None
        for b in batches:
            sink = sink or _Sink(folder, name)
            out: list[tuple] = []
            for page, url, text, sha, refers, key in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "_digest", "_first", "surt")), strict=True):
                bare = base64.b32encode(bytes.fromhex(sha)).decode()
                revisit = refers is not None and page != refers
                payload = b"" if revisit else text.encode()
                where = sink.add(_record("revisit" if revisit else "response", page, url.replace("\r", "%0D").replace("\n", "%0A"), bare, payload, refers))
                out.append((name, *where, key, page, "revisit" if revisit else "response", bare))
            if out:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["file", "offset", "size", "surt", "page_id", "record_type", "digest"])
        if sink:
            sink.close()

    manifest = f"{folder}/records"
    ordered = marked.select("page_id", "url", "html", "_digest", "_first", "surt").sortWithinPartitions("_digest", "page_id", "url")
    ordered.mapInArrow(run, _RECORD).write.parquet(manifest)
    return pages.sparkSession.read.schema(_RECORD).parquet(manifest)


def _escaped(field: object) -> str:
    """A field of an index line, without tabs and line ends; `_unescaped` gives it back."""
    text = "" if field is None else str(field)
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _unescaped(field: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), field) if "\\" in field else field


def write_index(records: DataFrame, folder: str, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted blocks of capture lines; the sparse directory (first_key, block_file, block_offset, block_size, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():06d}.cdx.gz"
        sink, lines, first, out = None, [], None, []

        def close_block() -> None:
            nonlocal first
            where = sink.add(gzip.compress("\n".join(lines).encode(), 6, mtime=0))
            out.append((first, name, *where, len(lines)))
            lines.clear()
            first = None

        for b in batches:
            sink = sink or _Sink(folder, name)
            for row in zip(*(b.column(c).to_pylist() for c in ("surt", "page_id", "record_type", "digest", "file", "offset", "size")), strict=True):
                first = row[0] if first is None else first
                lines.append("\t".join(map(_escaped, row)))
                if len(lines) == block_lines:
                    close_block()
        if sink:
            if lines:
                close_block()
            sink.close()
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["first_key", "block_file", "block_offset", "block_size", "lines"])

    schema = "first_key string, block_file string, block_offset long, block_size long, lines long"
    rows = records.select("surt", "page_id", "record_type", "digest", "file", "offset", "size")
    tasks = _tasks(records.sparkSession, bytes_of(records))
    ordered = rows.repartitionByRange(tasks, "surt", "page_id", "file", "offset").sortWithinPartitions("surt", "page_id", "file", "offset")
    path = f"{folder}/directory"
    ordered.mapInArrow(run, schema).write.parquet(path)
    return records.sparkSession.read.schema(schema).parquet(path)


def _capture_schema() -> str:
    return "surt string, page_id long, record_type string, digest string, file string, offset long, size long"


def _captures(blocks: DataFrame, folder: str) -> DataFrame:
    """The capture lines of the blocks named by (block_file, block_offset, block_size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["surt", "page_id", "record_type", "digest", "file", "offset", "size"]
        for b in batches:
            for name, offset, size in zip(*(b.column(c).to_pylist() for c in ("block_file", "block_offset", "block_size")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    text = gzip.decompress(f.read_at(size, offset)).decode()
                rows = [[_unescaped(v) for v in x.split("\t")] for x in text.split("\n")]
                cols = [[(int(v) if v else None) if pa.types.is_int64(t) else v for v in c] for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return blocks.select("block_file", "block_offset", "block_size").mapInArrow(run, _capture_schema())


def _merged_blocks(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks that may hold a wanted key: those that start with it, and the last that starts before it.

    Keys and block starts are sorted together; the last start is carried forward, from
    partition to partition by the partitions' own last starts, of which there is one each.
    """
    place = F.struct("block_file", "block_offset", "block_size")
    starts = directory.groupBy(F.col("first_key").alias("key")).agg(F.max(place).alias("block")).withColumn("turn", F.lit(1))
    asked = wanted.select(F.col("surt").alias("key"), F.lit(None).cast(dict(starts.dtypes)["block"]).alias("block"), F.lit(0).alias("turn"))
    rows = starts.unionByName(asked).repartitionByRange("key", "turn").sortWithinPartitions("key", "turn")
    placed = written(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33).cast("int")), "merged")
    ends = sorted(placed.groupBy("_part").agg(F.max(F.when(F.col("block").isNotNull(), F.struct("_row", "block"))).alias("end")).collect(), key=lambda r: r["_part"])  # one row per partition
    carried, last = [], None
    for part, end in ends:
        carried.append((part, last))
        last = tuple(end["block"]) if end else last
    carry = directory.sparkSession.createDataFrame(carried, "_part int, carried struct<block_file:string,block_offset:bigint,block_size:bigint>")
    w = Window.partitionBy("_part").orderBy("_row")
    before = placed.withColumn("last", F.last("block", ignorenulls=True).over(w)).filter("turn = 0").join(carry, "_part").select(F.coalesce("last", "carried").alias("b"))
    same = directory.join(wanted, directory.first_key == wanted.surt, "left_semi").select("block_file", "block_offset", "block_size")
    return before.filter("b is not null").select("b.*").union(same).distinct()


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Captures whose surt is among keys.surt: binary search of the directory, then only the blocks it names."""
    directory = spark.read.parquet(f"{folder}/directory")
    index = directory.agg(F.sum("block_size")).first()[0] or 0
    directory = directory.select("first_key", "block_file", "block_offset", "block_size")
    wanted = keys.select("surt").filter("surt is not null").distinct()
    if bytes_of(directory) <= DIRECTORY_BYTES:
        held = sorted(tuple(r) for r in directory.collect())
        sent = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts = [x[0] for x in sent.value]
            for b in batches:
                hits = set()
                for key in b.column("surt").to_pylist():
                    hits.update(range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)))
                cols = list(zip(*(sent.value[i][1:] for i in sorted(hits)), strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["block_file", "block_offset", "block_size"])

        blocks = wanted.mapInArrow(search, "block_file string, block_offset long, block_size long").distinct()
    else:
        blocks = _merged_blocks(directory, wanted)
    spread = blocks.repartition(_tasks(spark, 8 * index), "block_file", "block_offset")  # lines are about eight times their packed size
    return _captures(spread, folder).join(wanted, "surt", "left_semi")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range-reads and parses the records: page_id, record_type, refers_to, url, digest, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        handle, opened = None, None
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:None>" else None
        for b in batches:
            out: list[tuple] = []
            for name, offset, size in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                if name != opened:
                    if handle:
                        handle.close()
                    handle, opened = fs.open_input_file(f"{root}/{name}"), name
                block = zlib.decompress(handle.read_at(size, offset), 31)
                head, _, rest = block.partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                payload = rest[: int(fields["Content-Length"])]
                out.append((number(fields["WARC-Record-ID"]), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "record_type", "refers_to", "url", "digest", "payload"])

    schema = "page_id long, record_type string, refers_to long, url string, digest string, payload binary"
    spark = captures.sparkSession
    size = spark.read.schema(_RECORD).parquet(f"{folder}/records").agg(F.sum("size")).first()[0] or 0
    tasks = _tasks(spark, size)
    # Stretches of a file stay together, so that a task reads onwards.
    stretch = F.floor(F.col("offset") / F.lit(max(LEAST_BYTES, size // (4 * tasks))))
    ordered = captures.repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "size").mapInArrow(run, schema)


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Archive and index the pages, then look every page's key up in the index and read the records that it names."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    records = write_archive(pages, folder, least_bytes=least_bytes)
    write_index(records, folder)
    return read_records(lookup(spark, folder, records.select("surt")), folder)
