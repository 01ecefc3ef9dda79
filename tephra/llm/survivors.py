"""One surviving record for each group of duplicate records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOTE = "decimal(38,0)"
#: What a rank, and what a known field, outweighs in ``standing``: more than any time in microseconds, than any rank.
_RANK, _KNOWN = 1 << 64, 1 << 100


@dataclass(frozen=True)
class Candidate:
    """What one copy offers for a field.

    ``value`` is what the survivor gets; ``usable`` says whether the copy may vote; ``vote`` is its vote, a whole
    number; votes of copies whose ``same`` is equal are summed (NULL: the copy stands for itself alone).
    """

    field: str
    value: Column
    usable: Column
    vote: Column
    same: Column | None = None


def _whole(n: int, digits: int) -> Column:
    return F.lit(str(n)).cast(f"decimal({digits},0)")


def standing(rank: Column, seen: Column, known: Column | None = None) -> Column:
    """Logarithm of trust times recency times completeness, exact for every rank of an INT and every time.

    Trust falls by a constant factor with each ``rank`` and recency by one with each microsecond of age, so their
    logarithms are -rank * 2^64 and the time itself: the product of a copy outweighs that of any copy of a worse
    rank, and among equal ranks that of any older one. ``known``, a small number, is worth 2^100 each. A NULL rank
    comes after all others, a NULL time before all.
    """
    ranks = F.coalesce(rank.cast("long"), F.lit(1 << 31)).cast("decimal(11,0)") * _whole(_RANK, 20)
    times = F.coalesce(F.unix_micros(seen), F.lit(-(1 << 63) + 1)).cast("decimal(20,0)")
    vote = times - ranks
    if known is not None:
        vote = vote + known.cast("decimal(2,0)") * _whole(_KNOWN, 31)
    return vote.cast(_VOTE)


def shared_vote(rank: Column, seen: Column, as_of: Column) -> Column:
    """Trust 10^9 / (1 + rank) times recency 10^6 / (1 + days of age), both as whole numbers of at least 1: sums are exact in any order.

    A NULL or negative rank has trust 1, a NULL time recency 1; a time after ``as_of`` has no age.
    """
    trust = F.greatest(F.coalesce(F.when(rank >= 0, F.floor(F.lit(1_000_000_000) / (rank.cast("long") + 1))), F.lit(1)), F.lit(1))
    days = F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(seen)) / F.lit(86_400_000_000)), F.lit(0))
    recency = F.greatest(F.coalesce(F.floor(F.lit(1_000_000) / (days + 1)), F.lit(1)), F.lit(1))
    return (trust.cast("decimal(10,0)") * recency.cast("decimal(7,0)")).cast(_VOTE)


def survivors(copies: DataFrame, group: str, record: str, candidates: Sequence[Candidate]) -> DataFrame:
    """``group``, copies, and per field a struct (value, record, vote): the surviving record.

    Fields are unpivoted to long rows; the votes, trust times recency, are summed per normalised value; each
    field's winner is taken by max_by and the winners are pivoted back. Equal sums are decided by the greatest
    single vote, then the smallest ``record``. Both steps aggregate partially before their shuffle, and the first
    is keyed by value, so a group with a third of all copies never meets in one task before it is reduced to one
    row per value.

    Defined results: rows with NULL group or record don't count; rows of a (group, record) repeated are one
    copy; a field no copy can supply is NULL; a NULL vote counts as none at all; a group of one copy survives as
    it is; empty in, empty out. Columns not named are never read, so any extra names are fine.
    """
    none = F.lit(None).cast("string")
    wide = copies.where(copies[group].isNotNull() & copies[record].isNotNull()).select(
        copies[group].alias("g"),
        copies[record].alias("r"),
        *(
            F.when(
                F.coalesce(c.usable, F.lit(False)) & c.vote.isNotNull(),
                F.struct(
                    F.lit(c.field).alias("field"),
                    c.value.cast("string").alias("value"),
                    (c.same.cast("string") if c.same is not None else none).alias("same"),
                    c.vote.cast(_VOTE).alias("vote"),
                ),
            ).alias(f"c{i}")
            for i, c in enumerate(candidates)
        ),
    )
    one = wide.dropDuplicates(["g", "r"])
    present = F.struct(F.lit("").alias("field"), none.alias("value"), none.alias("same"), F.lit(0).cast(_VOTE).alias("vote"))
    long = one.select("g", "r", F.explode(F.array_compact(F.array(present, *(F.col(f"c{i}") for i in range(len(candidates)))))).alias("c"))
    alone = F.when(F.col("c.same").isNull(), F.col("r"))
    votes = long.groupBy("g", F.col("c.field").alias("field"), F.col("c.same").alias("same"), alone.alias("alone")).agg(
        F.sum("c.vote").cast(_VOTE).alias("vote"),
        F.max(F.struct(F.col("c.vote").alias("most"), (-F.col("r")).alias("first"), F.col("r").alias("record"), F.col("c.value").alias("value"))).alias("top"),
    )
    winner = F.struct(F.col("top.value").alias("value"), F.col("top.record").alias("record"), F.col("vote").alias("vote"))
    score = F.struct("vote", "top.most", "top.first")
    pivoted = votes.groupBy("g").agg(
        F.count_if(F.col("field") == "").alias("copies"),
        *(F.max_by(F.when(F.col("field") == c.field, winner), F.when(F.col("field") == c.field, score)).alias(c.field) for c in candidates),
    )
    return pivoted.withColumnRenamed("g", group)


def pick_columns(survivor: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Long form of ``survivors``: ``group``, field, record that supplies it."""
    picks = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}.record").alias("record")) for f in fields))
    return survivor.select(group, F.explode(picks).alias("p")).where("p.record IS NOT NULL").select(group, "p.field", "p.record")
