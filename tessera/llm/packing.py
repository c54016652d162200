"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs its own documents as they come (no shuffle, no global state). A
document fills whole windows first; what remains goes to the open fill level that
minimises the sum of squared counts of partially filled windows, read from an array
with one count per level. At the end of a task the windows still open are cut anew
into full ones, and the last tokens into power-of-two sequences, which need no padding.
Sequence ids carry the task in their high bits, so they are unique and reruns agree.

Defined results: null or empty text is the end token alone; rows that repeat an id
are packed each for itself; null ids are kept; other columns are ignored; an empty table gives no rows.
A text of any length is tokenised whole, about 40 bytes for each of its bytes; one with a long run of white
space goes through the slower encoder, which gives the same ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of

WINDOW = 2048
END_TOKEN = 1
Piece = tuple  # (document, start, ids, tokens of the document)
#: The fast encoder's regex engine keeps a state for each blank of a run, and panics at a million.
BLANKS = 50_000
_BLANK_RUN = re.compile(rf"\s{{{BLANKS}}}")


def make_encoder(path: str | None = None):
    """text -> list of ids of the byte-level BPE file at `path`.

    The ids are those of the `tokenizers` library; the ranks of the same vocabulary in
    `tiktoken`, where its file lies beside, give the same ids several times faster.
    """
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow: list = []

    def plain(text: str) -> list[int]:
        if not slow:  # loaded when it is needed
            slow.append(Tokenizer.from_file(path))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return plain
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) >= BLANKS and _BLANK_RUN.search(text):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except (ValueError, OverflowError, RuntimeError):  # a run that its regex engine gives up on
            return plain(text)

    return encode


class SumOfSquares:
    """Open windows by fill level; `place` returns windows that are complete."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def place(self, piece: Piece) -> list[list[Piece]]:
        size, counts = len(piece[2]), self.counts
        top = self.window - size
        # Leaving level h costs 1 - 2 counts[h], entering level g costs 1 + 2 counts[g]; a full window costs nothing.
        leave, enter = counts[1 : top + 1], counts[size + 1 : self.window + 1]
        best, level = 1 + 2 * counts[size], 0
        if len(leave):
            cost = np.where(leave > 0, 2 - 2 * leave + 2 * enter, np.iinfo(np.int64).max)
            cost[-1] -= leave[-1] > 0
            at = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[at] <= best:
                level = at + 1
        pieces = self.open[level].pop() if level else []
        counts[level] -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            return [pieces]
        counts[level + size] += 1
        self.open[level + size].append(pieces)
        return []

    def finish(self) -> list[list[Piece]]:
        """What is still open, cut anew: full windows, then power-of-two ends."""
        rest = [piece for level in reversed(self.open) for pieces in level for piece in pieces]
        left, out, own, room = sum(len(p[2]) for p in rest), [], [], 0
        for doc, start, ids, total in rest:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    out.append(own := [])
                take = min(room, len(ids) - at)
                own.append((doc, start + at, ids[at : at + take], total))
                at, room, left = at + take, room - take, left - take
        self.__init__(self.window)
        return out


def pack(df: DataFrame, *, tokenizer: str | None = None, window: int = WINDOW, end_token: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the token ids."""
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(tokenizer)
        packer, out, sequence = SumOfSquares(window), [], TaskContext.get().partitionId() << 32
        id_type = None

        def emit(windows: list[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in windows:
                at = 0
                for doc, start, ids, total in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, at, ids if with_ids else ids[:0]))
                    at += len(ids)
                sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            out.clear()
            empty = np.empty(0, np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[7])]), pa.int32()), pa.array(np.concatenate([empty, *cols[7]]).astype(np.int32)))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), lists]
            return pa.RecordBatch.from_arrays(arrays, names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            id_type = b.column("_id").type
            for doc, raw in zip(b.column("_id").to_pylist(), b.column("_text").cast(pa.binary()), strict=True):
                ids = np.array([*encode(raw.as_buffer().to_pybytes().decode("utf-8", "replace")), end_token], np.uint32)
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    emit([[(doc, start, ids[start : start + window], len(ids))]])
                if whole < len(ids):
                    emit(packer.place((doc, whole, ids[whole:], len(ids))))
                if len(out) >= 1000:
                    yield flush()
        emit(packer.finish())
        if out:
            yield flush()
        del encode, packer
        K.give_back()

    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    packed = rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return packed if with_ids else packed.drop("ids")
