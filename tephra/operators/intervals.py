"""Overlapping, touching and gapped integer intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, written

_LAST = (1 << 63) - 1
_RANGES = "pid int, entity string, lo long, hi long, before long"


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extents ``[lo, hi)`` cut into their canonical dyadic blocks: start and level, by start, of equal starts the largest first.

    At level k an extent owns at most a left block, where ceil(lo / 2^k) is odd, and a right one,
    where floor(hi / 2^k) is odd.
    """
    starts, levels = [], []
    l, r, k = lo, hi, 0
    while len(l):
        for own, at in ((l & 1 == 1, l), (r & 1 == 1, r - 1)):
            starts.append(at[own] << k)
            levels.append(np.full(len(starts[-1]), k, np.int64))
        # What is left between the two begins and ends at even places.
        l, r, k = (l + 1) >> 1, r >> 1, k + 1
        rest = l < r
        l, r = l[rest], r[rest]
    start, level = np.concatenate(starts or [lo]), np.concatenate(levels or [lo])
    order = np.lexsort((-level, start))
    return start[order], level[order]


def merge_siblings(start: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint blocks in order, with every pair of siblings made their parent, upward to the top."""
    k, top = (int(level.min()), 62) if len(level) else (0, 0)
    while k < top and len(level):
        even = (level[:-1] == k) & (level[1:] == k) & ((start[:-1] >> k) & 1 == 0) & (start[1:] - start[:-1] == np.int64(1) << np.int64(k))
        at = np.flatnonzero(even)
        if len(at):
            level = level.copy()
            level[at] += 1
            stay = np.ones(len(level), bool)
            stay[at + 1] = False
            start, level = start[stay], level[stay]
        rest = level[level > k]
        k = int(rest.min()) if len(rest) else top
    return start, level


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted extents of one partition to its covered ranges, by way of their blocks; memory is that of a batch."""
    pid = TaskContext.get().partitionId()
    entity, lo, hi, before = None, None, None, None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["pid", "entity", "lo", "hi", "before"])

    for batch in batches:
        names = batch.column("entity").dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        los = batch.column("lo").to_numpy(zero_copy_only=False)
        his = batch.column("hi").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            name = names.dictionary[int(codes[a])].as_py()
            if name != entity:
                if entity is not None:
                    out.append((pid, entity, lo, hi, before))
                entity, lo, hi, before = name, None, None, None
            s, k = dyadic_blocks(los[a:b], his[a:b])
            e = s + (np.int64(1) << k)
            floor = np.int64(hi) if hi is not None else np.iinfo(np.int64).min
            prior = np.maximum.accumulate(np.concatenate([[floor], e[:-1]]))
            own = e > prior  # a block is covered by an ancestor exactly if something before it reaches its end
            s, k = merge_siblings(s[own], k[own])
            if not len(s):
                continue
            e = s + (np.int64(1) << k)
            opens = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
            for x, y in zip(s[opens].tolist(), e[np.append(opens[1:], len(s)) - 1].tolist()):
                if hi is not None and x <= hi:
                    hi = max(hi, y)
                    continue
                if hi is not None:
                    out.append((pid, entity, lo, hi, before))
                lo, before, hi = x, hi, y
        if len(out) > 20_000:
            yield flush()
    if entity is not None:
        out.append((pid, entity, lo, hi, before))
    if out:
        yield flush()


def _carried(last: list) -> list[tuple]:
    """What flows into each partition: the range open at its left border."""
    flows, state = [], None
    for r in sorted(last, key=lambda r: r["pid"]):
        if state:
            flows.append((r["pid"], *state))
        entity, lo, hi = r["entity"], r["last"]["lo"], r["last"]["hi"]
        state = (entity, state[1], max(state[2], hi)) if state and state[0] == entity and lo <= state[2] else (entity, lo, hi)
    return flows


def coverage(df: DataFrame, entity: str, offset: str, size: str) -> DataFrame:
    """Continuous covered periods and the gaps between them: ``entity``, kind, start_offset, end_offset.

    The extents ``[offset, offset + size)`` are range-partitioned by (entity, offset), so one entity with a
    third of all rows spreads over many tasks, and each task sweeps its sorted extents once, batch by batch:
    it decomposes them into canonical dyadic blocks, removes blocks covered by an ancestor, merges sibling
    pairs upward and coalesces adjacent blocks. Extents are shuffled, never blocks. Ranges that cross a border
    between tasks are stitched with one row per task (its open range), which is all that reaches the driver.
    The sweep runs when this function is called; the stitching is lazy.

    Defined results: rows with NULL entity, offset or size, or a size of zero or less, don't count; repeated
    rows change nothing; ranges that touch are one; an end beyond BIGINT is cut to its largest value;
    no rows in, no rows out. Other columns are never read.
    """
    spark = df.sparkSession
    extents = (
        df.select(df[entity].cast("string").alias("entity"), df[offset].cast("long").alias("lo"), df[size].cast("long").alias("n"))
        .where("entity IS NOT NULL AND lo IS NOT NULL AND n > 0")
        .select("entity", "lo", F.coalesce(F.expr("try_add(lo, n)"), F.lit(_LAST)).alias("hi"))
        .where("lo < hi")
    )
    swept = extents.repartitionByRange(parallelism(spark), "entity", "lo").sortWithinPartitions("entity", "lo").mapInArrow(_sweep, _RANGES)
    ranges, _ = written(swept, "ranges")
    ends = F.max_by(F.struct("lo", "hi"), F.struct("entity", "lo"))
    last = ranges.groupBy("pid").agg(F.max("entity").alias("entity"), ends.alias("last")).collect()  # one row per task
    flows = spark.createDataFrame(_carried(last), "flow_pid int, flow_entity string, flow_lo long, flow_hi long")
    met = ranges.join(F.broadcast(flows), (F.col("pid") == F.col("flow_pid")) & (F.col("entity") == F.col("flow_entity")), "left")
    opened = met.select(
        "entity",
        "lo",
        "hi",
        F.coalesce(F.col("lo") <= F.col("flow_hi"), F.lit(False)).alias("absorbed"),
        "flow_lo",
        F.greatest("before", "flow_hi").alias("before"),
    )
    covered = (
        opened.groupBy("entity", F.when(F.col("absorbed"), F.col("flow_lo")).otherwise(F.col("lo")).alias("start_offset"))
        .agg(F.max("hi").alias("end_offset"))
        .select("entity", F.lit("covered").alias("kind"), "start_offset", "end_offset")
    )
    gaps = opened.where("NOT absorbed AND before IS NOT NULL").select("entity", F.lit("gap").alias("kind"), F.col("before").alias("start_offset"), F.col("lo").alias("end_offset"))
    return covered.unionByName(gaps).withColumnRenamed("entity", entity)
