"""Secret scans: an Aho-Corasick automaton finds keywords, anchored patterns run only where one was found, embedded checksums are validated.

The automaton reads the lower-cased UTF-8 bytes once. Its keywords are the names and
prefixes of the kinds, and for hex runs every four hex digits, one of which starts any such
run. Where a keyword ends, the kind's pattern is matched at the keyword's start and nowhere
else. Keywords of one kind never hold each other, so matches come in order of their start,
and a match that fails its test still uses up its text, as in a plain search.

Kinds: assign, access and hex need only their lengths. github and npm tokens end in the
base-62 CRC-32 of their body, age keys in a bech32 checksum, xprv keys in a base-58 check;
private_key blocks must hold base-64 whose DER length (or OpenSSH magic) is right.

Defined results: null or empty text has no spans; null ids and repeated rows give a row
each; other columns are ignored; an empty table gives no rows; a text of any length takes
about three times its bytes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "age", "xprv", "private_key")
#: Lower-case keywords by kind; hex has all runs of HEX_GRAM digits besides.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "age": ("age-secret-key-1",),
    "xprv": ("xprv",),
    "private_key": ("-----begin ",),
}
HEX_GRAM = 4
#: Matched where a keyword starts. Bytes patterns: case and classes are ASCII.
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]++"),
    "hex": re.compile(rb"[0-9a-f]++"),
    "github": re.compile(rb"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"),
    "npm": re.compile(rb"(?<![A-Za-z0-9_])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"),
    "age": re.compile(rb"(?<![A-Za-z0-9])AGE-SECRET-KEY-1([A-Z0-9]{58})(?![A-Za-z0-9])"),
    "xprv": re.compile(rb"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"),
    "private_key": re.compile(rb"-----BEGIN ([A-Z ]{0,20})PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = b"QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
_BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base62_crc32(body: bytes) -> bytes:
    """The CRC-32 in six base-62 digits."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit : digit + 1] + out
    return out


def bech32_holds(prefix: bytes, data: bytes) -> bool:
    """BIP 173: the checksum over the prefix and the data part is 1."""
    values = [_BECH32.find(c) for c in data]
    if min(values) < 0:
        return False
    low = prefix.lower()
    state = 1
    for v in [*(c >> 5 for c in low), 0, *(c & 31 for c in low), *values]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(_BECH32_STEPS):
            state ^= step if top >> i & 1 else 0
    return state == 1


def base58_holds(key: bytes) -> bool:
    """The last 4 of 82 bytes start the double SHA-256 of the rest."""
    value = 0
    for c in key:
        value = value * 58 + _BASE58.index(c)
    if value >> 656:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def key_block_holds(body: bytes) -> bool:
    """Base-64 of an OpenSSH key, or of a DER sequence that is as long as it says."""
    try:
        raw = base64.b64decode(b"".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    wide = raw[1] & 0x7F if raw[1] & 0x80 else 0
    return len(raw) == 2 + wide + (int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1])


def holds(kind: str, m: re.Match) -> bool:
    """Whether the match is as long as its kind asks, and its checksum right."""
    if kind in LEAST:
        return len(m[1] if kind == "assign" else m[0]) >= LEAST[kind]
    if kind in ("github", "npm"):
        return base62_crc32(m[1]) == m[2]
    if kind == "age":
        return bech32_holds(b"age-secret-key-", m[1])
    return base58_holds(m[0]) if kind == "xprv" else key_block_holds(m[2])


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for k in keys:
            a.add_word(k, (kind, len(k)))
    for k in product("0123456789abcdef", repeat=HEX_GRAM):
        a.add_word("".join(k), ("hex", HEX_GRAM))
    a.make_automaton()
    return a


def scan(raw: bytes) -> list[tuple[int, int, str, int]]:
    """(start, order of the kind, kind, end) of each span, as byte offsets, sorted."""
    used, found = dict.fromkeys(KINDS, 0), []
    for last, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")):  # a character a byte
        start = last - size + 1
        if start < used[kind]:
            continue
        m = PATTERNS[kind].match(raw, start)
        if m:
            used[kind] = m.end()
            if holds(kind, m):
                found.append((start, KINDS.index(kind), kind, m.end()))
    return sorted(found)


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and found: array<struct<start, order, kind, end, checked, match>> in order of start, then kind; positions in code points."""
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in K.text_slices(b.column("_text")):
                cut, found, raw, spots = [0], [], data.tobytes(), offsets.tolist()
                for x, y in zip(spots[:-1], spots[1:], strict=True):
                    own = raw[x:y]
                    spans = scan(own)
                    points = np.concatenate([[0], np.cumsum((data[x:y] & 0xC0) != 0x80)]).tolist() if spans and not own.isascii() else range(len(own) + 1)
                    found += [(points[s], order, kind, points[e], kind not in BASE_KINDS, own[s:e].decode("utf-8", "replace")) for s, order, kind, e in spans]
                    cut.append(len(found))
                names, kinds = ("start", "order", "kind", "end", "checked", "match"), (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string())
                items = pa.StructArray.from_arrays([pa.array([f[i] for f in found], kinds[i]) for i in range(len(names))], names=names)
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(first, last - first), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items)], names=["_id", "found"])

    schema = f"_id {dict(rows.dtypes)['_id']}, found array<struct<start:int,order:int,kind:string,end:int,checked:boolean,match:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
