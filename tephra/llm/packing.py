"""Texts put together into windows of a fixed number of tokens."""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, written

#: How the vocabularies in use split a text before merging (a fixed, public value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def tokenizer(path: str, pattern: str = PATTERN):
    """The byte-level BPE of a file of ranks (base64 token and rank a line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_to_windows(text: str, tokens: list[int], capacity: int, coder) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of parts of at most ``capacity`` tokens, counted on the part alone; cuts fall between characters."""
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    out, start = [], 0
    while start < len(text):
        rest = text[start : start + capacity * 64] if out else text
        ids = coder.encode_ordinary(rest) if out else tokens
        if len(ids) <= capacity and start + len(rest) == len(text):
            out.append((start, len(text), len(ids)))
            break
        take = min(capacity, len(ids))
        size = max(len(coder.decode_bytes(ids[:take]).decode("utf-8", "ignore")), 1)
        while size > 1 and (n := len(coder.encode_ordinary(rest[:size]))) > capacity:
            size = max(1, size - max(1, (n - capacity) // 2))
        out.append((start, start + size, len(coder.encode_ordinary(rest[:size]))))
        start += size
    return out


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the part, of ``k`` of near-equal sums, that each item goes to.

    The two partial partitions of greatest imbalance are merged, the largest parts of one with the smallest
    of the other, until one is left. A partial partition keeps its parts that aren't empty, by falling
    sum less the smallest one.
    """
    n = len(sizes)
    up = np.full(2 * n, -1)  # each part points to the part it became a half of
    made = n
    # An entry: sums of its non-empty parts, falling, and the numbers of these parts.
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, parts = np.concatenate([a, b]), np.concatenate([at, bt])
        else:
            # Of k places, a fills the first and b, turned round, the last: ``over`` of them are in both.
            la, lb = len(a) - over, len(b) - over
            both = np.arange(made, made + over)
            up[at[la:]] = both
            up[bt[lb:][::-1]] = both
            made += over
            sums = np.concatenate([a[:la], a[la:] + b[lb:][::-1], b[:lb]])
            parts = np.concatenate([at[:la], both, bt[:lb]])
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], parts[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        turn += 1
        heapq.heappush(heap, (-int(sums[0]), turn, sums, parts))
    window = np.full(2 * n, -1)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for part in range(made - 1, -1, -1):  # what a part became is numbered after it
        if up[part] >= 0:
            window[part] = window[up[part]]
    return window[:n]


def repaired(sizes: np.ndarray, window: np.ndarray, k: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows over ``capacity`` mended by moving an item to another, or exchanging it for a smaller one there.

    Gives the windows and the items for which no place was found (-1). Of the moves that mend a window, or
    else take most off it, the one that leaves the least room goes first.
    """
    window = window.copy()
    load = np.bincount(window, sizes, k).astype(np.int64)
    out: list[int] = []
    for w in np.argsort(load).tolist():
        while load[w] > capacity:
            over = load[w] - capacity
            mine = np.flatnonzero(window == w)
            room = capacity - load
            best = None
            for i in mine[np.argsort(-sizes[mine], kind="stable")].tolist():
                # Moved whole.
                fits = np.flatnonzero((room >= sizes[i]) & (room >= 0))
                if len(fits):
                    u = int(fits[np.argmin(room[fits])])
                    score = (min(int(sizes[i]), int(over)), -int(room[u] - sizes[i]))
                    best = max(best, (score, i, u, -1)) if best else (score, i, u, -1)
                # Exchanged.
                gain = sizes[i] - sizes
                there = np.flatnonzero((gain > 0) & (window >= 0) & (window != w) & (gain <= room[window]))
                if len(there):
                    worth = np.minimum(gain[there], over) * (1 << 32) - (room[window[there]] - gain[there])
                    j = int(there[np.argmax(worth)])
                    score = (min(int(gain[j]), int(over)), -int(room[window[j]] - gain[j]))
                    best = max(best, (score, i, int(window[j]), j)) if best else (score, i, int(window[j]), j)
            if best is None:
                i = int(mine[np.argmin(np.where(sizes[mine] >= over, sizes[mine], np.iinfo(np.int64).max))]) if (sizes[mine] >= over).any() else int(mine[np.argmax(sizes[mine])])
                window[i] = -1
                load[w] -= sizes[i]
                out.append(i)
                continue
            _, i, u, j = best
            window[i] = u
            load[w] -= sizes[i]
            load[u] += sizes[i]
            if j >= 0:
                window[j] = w
                load[u] -= sizes[j]
                load[w] += sizes[j]
    # What found no place takes the nearest room, or that of a smaller item, which then looks for one itself.
    left = []
    heap = [(-int(sizes[i]), i) for i in out]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        room = capacity - load
        fits = np.flatnonzero(room >= sizes[i])
        if len(fits):
            u = int(fits[np.argmin(room[fits])])
            window[i] = u
            load[u] += sizes[i]
            continue
        gain = sizes[i] - sizes
        there = np.flatnonzero((gain > 0) & (window >= 0))
        there = there[gain[there] <= room[window[there]]]
        if not len(there):
            left.append(i)
            continue
        j = int(there[np.argmax(gain[there])])
        window[i], window[j] = window[j], -1
        load[window[i]] += gain[j]
        heapq.heappush(heap, (-int(sizes[j]), j))
    return window, np.array(left, np.int64)


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items in few windows of at most ``capacity``: differencing into the least number possible, then repairs by moves.

    Where items find no place the number of windows rises by as many as differencing needs for them.
    """
    size = np.array(sizes, np.int64)
    if len(size) and size.max() > capacity:
        raise ValueError("an item exceeds the capacity")
    out: list[list[int]] = []
    rest = np.arange(len(size))
    while len(rest):
        some = size[rest]
        k = max(1, math.ceil(int(some.sum()) / capacity), int((some * 2 > capacity).sum()))
        window, left = repaired(some, differencing(some, k), k, capacity)
        order = np.argsort(window, kind="stable")
        order = order[window[order] >= 0]
        out += [rest[p].tolist() for p in np.split(order, np.flatnonzero(np.diff(window[order])) + 1)]
        rest = rest[left]
    return out


def pack(
    documents: DataFrame,
    key: str,
    text: str,
    source: str,
    capacity: Column,
    vocabulary: str,
    pattern: str = PATTERN,
    block_items: int = 1024,
) -> DataFrame:
    """``source``, block, window, capacity, ``key``, part, start_pos, end_pos, tokens: which texts share a window.

    Texts are measured in tokens of a public vocabulary, whose path is given and must be readable by all
    executors. A text goes whole into one window, unless it alone has more than ``capacity`` tokens; then
    it is cut into parts that don't. Windows hold texts of one source, filled by Karmarkar-Karp multiway
    differencing; windows that come out over their capacity are mended by moving or exchanging items, and while
    an item finds no place the number of windows rises.

    A source of more than ``block_items`` texts and parts is dealt by hash to blocks of about that number,
    each packed in one task, so that a source with a third of all rows is no larger task than others; a
    block leaves less than a window of room more than one pass over the source would. Texts are measured when
    this function is called; only keys, positions and counts are written and shuffled, never texts.

    Defined results: NULL texts and keys don't count; an empty text is an item of no tokens; NULL is a source
    as any other; a NULL capacity or one below 16 is 2048; repeated rows are repeated items. Other columns
    are never read.
    """
    size = F.when(capacity >= 16, capacity).otherwise(F.lit(2048)).cast("long")
    rows = documents.select(documents[key].alias("key"), documents[source].cast("string").alias("source"), size.alias("capacity"), documents[text].alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    kind = dict(rows.dtypes)["key"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary, pattern)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for i, (t, c) in enumerate(zip(batch.column("text").to_pylist(), batch.column("capacity").to_pylist())):
                for part, (a, b, n) in enumerate(cut_to_windows(t, coder.encode_ordinary(t), c, coder)):
                    for col, v in zip(cols, (i, part, a, b, n)):
                        col.append(v)
            index = pa.array(cols[0], pa.int32())
            given = [batch.column(c).take(index) for c in ("key", "source", "capacity")]
            yield pa.RecordBatch.from_arrays([*given, pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["key", "source", "capacity", "part", "start_pos", "end_pos", "tokens"])

    # Measured once and written, without texts, so that blocks can follow the number of parts.
    items, _ = written(rows.mapInArrow(measure, f"key {kind}, source string, capacity long, part int, start_pos long, end_pos long, tokens long"), "measured")
    counts = items.groupBy(F.col("source").alias("of"), F.col("capacity").alias("at")).agg(F.ceil(F.count("*") / F.lit(block_items)).cast("int").alias("blocks"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("capacity") == F.col("at"))
    dealt = items.join(counts, same).withColumn("block", F.pmod(F.xxhash64("key", "part"), F.col("blocks")).cast("int")).select("source", "capacity", "key", "part", "start_pos", "end_pos", "tokens", "block")
    # As many tasks as asked for: packing costs time by items, not by bytes, so few bytes are no reason to merge tasks.
    dealt = dealt.repartition(max(parallelism(documents.sparkSession), documents.sparkSession.sparkContext.defaultParallelism), "source", "capacity", "block")

    def fill(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("part").to_numpy(), np.array(table.column("key").to_pylist())))
        table = table.take(pa.array(order))
        window = np.zeros(table.num_rows, np.int32)
        for w, members in enumerate(windows(table.column("tokens").to_pylist(), table.column("capacity")[0].as_py())):
            window[members] = w
        return table.append_column("window", pa.array(window))

    schema = f"source string, capacity long, key {kind}, part int, start_pos long, end_pos long, tokens long, block int, window int"
    packed = dealt.groupBy("source", "capacity", "block").applyInArrow(fill, schema)
    return packed.select(F.col("source").alias(source), "block", "window", "capacity", F.col("key").alias(key), "part", "start_pos", "end_pos", "tokens")
