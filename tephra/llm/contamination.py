"""Passages of held-out test items inside a corpus, whole or with small edits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROPPED = regex.compile(r"[^\p{L}\p{Nd}]+")
#: Normalised characters of test items that one pass over the corpus carries in its closure.
BLOCK_CHARS = 4_000_000


def letters_and_digits(text: str) -> str:
    """Lower case, letters (L) and decimal digits (Nd) only."""
    return _DROPPED.sub("", text.lower())


def myers_distance(pattern: str, text: str, limit: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; over ``limit``, some number over it.

    Bit-parallel: one column of the dynamic-programming matrix per character, as two bit vectors.
    """
    m = len(pattern)
    if m == 0:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
            if best == 0:
                break
    return best if best <= limit else limit + 1


def piece_length(run: int, errors: int) -> int:
    """Longest grid step with which every run of ``run`` characters holds errors + 1 whole pieces, so that one is untouched."""
    return (run + 1) // (errors + 2)


def _reach(doc: str, i: int, item: str, j: int, step: int, errors: int) -> list[int]:
    """How many characters of the item, going by ``step``, align with the document within 0, 1, ... errors: the furthest row of each diagonal, error by error."""
    n, m = (len(doc) - i, len(item) - j) if step > 0 else (i + 1, j + 1)
    rows: dict[int, int] = {}
    out: list[int] = []
    for e in range(errors + 1):
        now: dict[int, int] = {}
        for d in range(-e, e + 1):
            r = 0 if e == 0 else max(rows.get(d, -2) + 1, rows.get(d - 1, -2), rows.get(d + 1, -2) + 1)
            if r < 0:
                continue
            r = min(r, m, n - d)
            while 0 <= r + d < n and r < m and doc[i + step * (r + d)] == item[j + step * r]:
                r += 1
            now[d] = r
        rows = now
        out.append(max(rows.values()))
    return out


def _shared(doc: str, at: int, item: str, off: int, q: int, run: int, errors: int) -> bool:
    """Whether some ``run`` characters of the item around an exact piece hit lie in the document within ``errors`` edits."""
    left = _reach(doc, at - 1, item, off - 1, -1, errors)
    right = _reach(doc, at + q, item, off + q, 1, errors)
    for e in range(errors + 1):
        if left[e] + q + right[errors - e] >= run:
            start = max(off - left[e], off + q - run)
            lead = off - start
            return myers_distance(item[start : start + run], doc[max(0, at - lead - errors) : at - lead + run + errors], errors) <= errors
    return False


def leaks_in(doc: str, automaton, items: dict, q: int, run: int, errors: int) -> set:
    """The items that share a run with one normalised document."""
    found = set()
    for end, places in automaton.iter(doc):
        for item, off in places:
            if item not in found and _shared(doc, end - q + 1, items[item], off, q, run, errors):
                found.add(item)
    return found


def _automaton(items: dict, q: int):
    import ahocorasick

    places: dict[str, list] = {}
    for item, text in items.items():
        for off in range(0, len(text) - q + 1, q):
            places.setdefault(text[off : off + q], []).append((item, off))
    a = ahocorasick.Automaton()
    for piece, at in places.items():
        a.add_word(piece, at)
    a.make_automaton()
    return a


def leaked(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text", run: int = 40, errors: int = 0) -> DataFrame:
    """``doc, item`` for every document and test item that share ``run`` characters within ``errors`` edits.

    Both texts are lower-cased and reduced to letters and digits. By the pigeonhole principle a run with at
    most ``errors`` edits keeps one of errors + 1 pieces of the item untouched; exact hits of all pieces are
    found in one pass over each document, extended as far as the errors allow, and what is then long enough is
    verified with Myers' bit-parallel distance. The corpus is only mapped, never shuffled or collected, and whole
    texts are searched. The test items, the stated query set, go to the tasks in blocks of at most
    BLOCK_CHARS characters, each block one pass.

    Defined results: a pair comes once, however often it is shared or its rows are repeated; NULL ids or texts
    and texts with fewer than ``run`` letters and digits give nothing; items that share their id but not their
    text all count for it. Other columns are never read.
    """
    q = piece_length(run, errors)
    if q < 1:
        raise ValueError("run is too short for this many errors")
    kinds = dict(documents.dtypes)[doc], dict(items.dtypes)[item]
    blocks: list[dict] = [{}]
    load = 0
    wanted = items.select(items[item].alias("i"), items[text].alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    for row in wanted.toLocalIterator():
        bare = letters_and_digits(row["t"])
        if len(bare) < run:
            continue
        if load + len(bare) > BLOCK_CHARS and blocks[-1]:
            blocks.append({})
            load = 0
        blocks[-1][(row["i"], len(blocks[-1]))] = bare
        load += len(bare)
    corpus = documents.select(documents[doc].alias("d"), documents[text].alias("t")).where(F.col("d").isNotNull() & (F.length("t") >= run))

    def search(block: dict):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block, q)
            for batch in batches:
                row, hit = [], []
                if block:
                    for i, t in enumerate(batch.column("t")):
                        for found in sorted({k[0] for k in leaks_in(letters_and_digits(t.as_py()), automaton, block, q, run, errors)}):
                            row.append(i)
                            hit.append(found)
                yield pa.RecordBatch.from_arrays([batch.column("d").take(pa.array(row, pa.int32())), pa.array(hit, types[1])], names=["d", "i"])

        return go

    types = [pa.int64() if k == "bigint" else pa.int32() if k == "int" else pa.string() for k in kinds]
    out = None
    for block in blocks:
        part = corpus.mapInArrow(search(block), f"d {kinds[0]}, i {kinds[1]}")
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.col("d").alias(doc), F.col("i").alias(item))
