"""Digests of contents: SHA-256 in the JVM by default, BLAKE3 where it is asked for."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MASK = 0xFFFFFFFF
# Fixed values of the published BLAKE3 specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(cv: tuple, block: tuple, counter: int, length: int, flags: int) -> list[int]:
    v = [*cv, *_IV[:4], counter & _MASK, counter >> 32, length, flags]
    m = list(block)

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & _MASK
            t = v[d] ^ v[a]
            v[d] = (t >> r1 | t << (32 - r1)) & _MASK
            v[c] = (v[c] + v[d]) & _MASK
            t = v[b] ^ v[c]
            v[b] = (t >> r2 | t << (32 - r2)) & _MASK

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, number: int, root: bool) -> list[int]:
    cv: tuple = _IV
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        flags = _CHUNK_START * (i == 0) | _CHUNK_END * (i == len(blocks) - 1) | _ROOT * (root and i == len(blocks) - 1)
        cv = tuple(_compress(cv, struct.unpack("<16I", b.ljust(64, b"\0")), number, len(b), flags))
    return list(cv)


def blake3(data: bytes) -> str:
    """BLAKE3 of ``data``, 64 hex digits."""
    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]

    def tree(lo: int, hi: int, root: bool) -> list[int]:
        if hi - lo == 1:
            return _chunk(chunks[lo], lo, root)
        left = 1 << ((hi - lo - 1).bit_length() - 1)
        pair = tree(lo, lo + left, False) + tree(lo + left, hi, False)
        return _compress(_IV, tuple(pair), 0, 64, _PARENT | _ROOT * root)

    return struct.pack("<8I", *tree(0, len(chunks), True)).hex()


@F.pandas_udf(StringType())
def blake3_hex(content: pd.Series) -> pd.Series:
    """BLAKE3 of binary values; far slower than SHA-256, for manifests that need it."""
    return content.map(lambda b: None if b is None else blake3(bytes(b)))


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a whole content."""
    return blake3_hex(content) if algorithm == "blake3" else F.sha2(content, 256)


def little_endian(number: Column) -> Column:
    """Eight bytes, the lowest first."""
    text = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*(F.substring(text, 15 - 2 * i, 2) for i in range(8))))


def partial_hash(content: Column, end_bytes: int = 4 << 20) -> Column:
    """Digest of size, first and last ``end_bytes`` of a content over twice that, else of the whole."""
    size = F.octet_length(content).cast("long")
    ends = F.concat(little_endian(size), F.substring(content, F.lit(1), F.lit(end_bytes)), F.substring(content, size.cast("int") - end_bytes + 1, F.lit(end_bytes)))
    return F.when(size > 2 * end_bytes, F.sha2(ends, 256)).otherwise(F.sha2(content, 256))


def path_key(path: Column) -> Column:
    """Sixteen hex digits that name a path's own files."""
    return F.substring(F.sha2(path, 256), 1, 16)
