"""Texts over a size limit cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "paragraph", "sentence", "word", "character")
#: Where each level but the last may cut: at the end of a match, for words also at its start.
_CUTS = (
    regex.compile(r"\n(?=[ ]{0,3}#{1,6} )|\f|\n(?=(?:-{3,}|={3,}|\*{3,})[ \t]*\r?\n)|\n(?=— ?\d+ ?—)"),
    regex.compile(r"\n[ \t\r]*\n[ \t\r\n]*"),
    regex.compile(r"[.!?…؟।]+[\p{Pe}\p{Pf}\"]*[ \t\r\n]+|[。！？]+(?:[\p{Pe}\p{Pf}]+(?=[ \t\r\n]))?[ \t\r\n]*"),
    regex.compile(r"[ \t\n\r]+|[。！？]"),
)


class _Text:
    """A text with its byte offsets and, found when needed, its cuts by level."""

    def __init__(self, text: str):
        self.text = text
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) == len(text):
            self.bytes_at = None
        else:
            lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            self.bytes_at = np.append(np.flatnonzero(lead), len(raw))
        self._cuts: dict[int, list[int]] = {}

    def size(self, a: int, b: int) -> int:
        return b - a if self.bytes_at is None else int(self.bytes_at[b] - self.bytes_at[a])

    def reach(self, a: int, size: int) -> int:
        """The furthest end whose span from ``a`` has at most ``size`` bytes."""
        return min(a + size, len(self.text)) if self.bytes_at is None else int(np.searchsorted(self.bytes_at, self.bytes_at[a] + size, "right")) - 1

    def back(self, b: int, size: int) -> int:
        """The first start whose span up to ``b`` has at most ``size`` bytes."""
        return max(b - size, 0) if self.bytes_at is None else int(np.searchsorted(self.bytes_at, self.bytes_at[b] - size, "left"))

    def cuts(self, level: int) -> list[int]:
        if level not in self._cuts:
            found = {m.end() for m in _CUTS[level].finditer(self.text)}
            if level == 3:
                found |= {m.start() for m in _CUTS[3].finditer(self.text) if m.group() not in "。！？"}
            self._cuts[level] = sorted(found)
        return self._cuts[level]

    def atoms(self, a: int, b: int, level: int, room: int, limit: int, ends: int) -> Iterator[tuple[int, int, int]]:
        """Spans of at most ``room`` bytes and the level of the cut that ends each; a word may have up to ``limit``."""
        if self.size(a, b) <= room or (level == 4 and self.size(a, b) <= limit):
            yield a, b, ends
        elif level == 4:
            if self.text[b - 1] in "。！？" and self.size(a, b - 1) <= limit:
                yield a, b - 1, 3
                a = b - 1
            while a < b:
                e = min(max(self.reach(a, room), a + 1), b)
                yield a, e, 4 if e < b else ends
                a = e
        else:
            cuts = self.cuts(level)
            inner = cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]
            for x, y in zip([a, *inner], [*inner, b]):
                yield from self.atoms(x, y, level + 1, room, limit, ends if y == b else level)


def pieces(text: str, limit: int, overlap: int, least: int = 0) -> list[tuple[int, int, int, int]]:
    """(start, fresh, end, level): each piece covers start to end, of which start to fresh repeats its forerunner.

    ``level`` is the index in LEVELS of the cut that ends the piece, -1 for the last one.
    """
    t = _Text(text)
    if t.size(0, len(text)) <= limit:
        return [(0, 0, len(text), -1)]
    overlap = max(0, min(overlap, limit // 2))
    room = max(limit - overlap, 1)
    out: list[tuple[int, int, int, int]] = []
    start = fresh = end = 0
    level = -1
    words = t.cuts(3)
    for a, b, ends in t.atoms(0, len(text), 0, room, limit, -1):
        if end > fresh and t.size(start, b) > limit:
            out.append((start, fresh, end, level))
            tail = min(overlap, limit - t.size(a, b))
            start = end
            if tail > 0:
                start = max(t.back(end, tail), fresh)
                i = bisect_left(words, start)
                if i < len(words) and words[i] < end:
                    start = words[i]
            fresh = end
        end, level = b, ends
    out.append((start, fresh, end, -1))
    if len(out) > 1 and t.size(out[-1][1], end) < least:
        prior, last = out[-2], out[-1]
        if t.size(prior[0], end) <= limit:
            out[-2:] = [(prior[0], prior[1], end, -1)]
        else:
            out[-1] = (min(last[0], max(t.back(end, min(limit, max(least, overlap))), prior[1])), last[1], end, -1)
    return out


def split_texts(documents: DataFrame, key: str, text: str, limit: Column, overlap: Column, least: Column | None = None, with_text: bool = True) -> DataFrame:
    """``key``, piece, start_pos, fresh_pos, end_pos, n_bytes, cut (and content) for every text over its limit.

    A hierarchy of separators is tried in turn: sections, paragraphs, sentences, words, characters; only a
    part that is still too large is cut at the next level, and the parts are packed greedily up to ``limit``
    UTF-8 bytes, with up to ``overlap`` trailing bytes of the forerunner repeated in front, from a word's
    start where there is one. The fresh parts of the pieces, start to end, make up the whole text. A word of
    more than limit - overlap bytes stays whole and gets less overlap; only one longer than ``limit`` is
    cut between characters, which ``cut`` then says of the piece that ends there.

    A map without shuffle; texts within their limit are dropped before they reach Python. Defined results:
    NULL keys pass, NULL and empty texts give nothing; a NULL limit, or one below 1, is 1024, a NULL overlap
    none; overlap is at most half the limit; repeated rows give their pieces again; a final piece with fewer
    fresh bytes than ``least`` is joined to its forerunner where that fits, else it overlaps more.
    A limit smaller than one character gives one character a piece. Other columns are never read.
    """
    size = F.when(limit >= 1, limit).otherwise(F.lit(1024)).cast("long")
    rows = documents.select(
        documents[key].alias("key"),
        documents[text].alias("text"),
        size.alias("limit"),
        F.coalesce(overlap, F.lit(0)).cast("long").alias("overlap"),
        F.coalesce(least if least is not None else F.lit(0), F.lit(0)).cast("long").alias("least"),
    ).where(F.octet_length("text") > F.col("limit"))
    kind = dict(rows.dtypes)["key"]
    names = ["key", "piece", "start_pos", "fresh_pos", "end_pos", "n_bytes", "cut"] + ["content"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, (t, n, o, m) in enumerate(zip(batch.column("text"), batch.column("limit"), batch.column("overlap"), batch.column("least"))):
                t = t.as_py()
                for p, (start, fresh, end, level) in enumerate(pieces(t, n.as_py(), o.as_py(), m.as_py())):
                    content = t[start:end]
                    row = [i, p, start, fresh, end, len(content.encode("utf-8", "surrogatepass")), LEVELS[level] if level >= 0 else "end"]
                    for c, v in zip(cols, row + [content] * with_text):
                        c.append(v)
            kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(cols[0], pa.int32())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:]))], names=names)

    schema = f"key {kind}, piece int, start_pos long, fresh_pos long, end_pos long, n_bytes long, cut string" + ", content string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
