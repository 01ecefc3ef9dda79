"""Differences between two copies of a dataset."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Normaliser = Callable[[Column], Column]


def slashes(c: Column) -> Column:
    """Windows separators as ``/``."""
    return F.translate(c, "\\", "/")


def bare_hash(c: Column) -> Column:
    """A hash without case and outer blanks."""
    return F.lower(F.trim(c))


def whole_seconds(c: Column) -> Column:
    """A timestamp cut to its second."""
    return F.date_trunc("second", c)


def blank_as_null(c: Column) -> Column:
    """NULL for a string of nothing but blanks."""
    return F.when(F.trim(c) != "", c)


def _side(df: DataFrame, keys: Sequence[str], fields: Sequence[str], rules: dict[str, Normaliser], version: str | None) -> DataFrame:
    """One normalised row per key: the latest version, among equals the greatest by fields."""
    named = lambda c: rules[c](df[c]) if c in rules else df[c]
    ks, fs = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]
    seen = [df[version].alias("version")] if version else []
    rows = df.select(*(named(c).alias(a) for c, a in zip(keys, ks)), *seen, *(named(c).alias(a) for c, a in zip(fields, fs)))
    best = rows.groupBy(*ks).agg(F.max(F.struct(*(["version"] if version else []), *fs)).alias("row"))
    return best.select(*ks, *(F.col(f"row.{a}").alias(a) for a in fs))


def differences(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    rules: dict[str, Normaliser] | None = None,
    left_version: str | None = None,
    right_version: str | None = None,
    only_left: str = "missing_in_right",
    only_right: str = "missing_in_left",
) -> DataFrame:
    """Rows missing on either side and fields that differ: ``keys``, field, left_value, right_value.

    Both copies are normalised by ``rules`` (column name to expression). EXCEPT ALL is taken in both
    directions at once, as one signed count of equal normalised rows: a positive count is what
    left EXCEPT ALL right leaves, a negative one what right EXCEPT ALL left leaves. The two residues,
    small where the copies agree, are then full-joined by key. Everything is keyed by the whole key,
    so that a manifest with a third of all rows spreads over all tasks; repeats are reduced before
    each shuffle.

    Defined results: NULL equals NULL only, in keys too. Rows repeated word for word are one. Of several
    different rows of a key the one with the latest version counts (NULL versions are the oldest), among
    equal versions, or without a version column, the greatest by the order of ``fields``. A key that one
    side lacks gives one row, named by ``only_left`` or ``only_right``, with NULL values. An empty side
    makes every key of the other one-sided. Columns not named are never read, whatever they are called.
    """
    rules = rules or {}
    a = _side(left, keys, fields, rules, left_version)
    b = _side(right, keys, fields, rules, right_version)
    every = a.columns
    ks = every[: len(keys)]
    signed = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    residue = signed.groupBy(*every).agg(F.sum("side").alias("net")).where("net <> 0")
    x = residue.where("net > 0").drop("net").withColumn("there", F.lit(True)).alias("x")
    y = residue.where("net < 0").drop("net").withColumn("there", F.lit(True)).alias("y")
    same = F.lit(True)
    for k in ks:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    both = x.join(y, same, "full_outer")
    text = lambda c: c.cast("string")
    found = []
    for i, name in enumerate(fields):
        l, r = F.col(f"x.f{i}"), F.col(f"y.f{i}")
        found.append(F.when(F.col("x.there") & F.col("y.there") & ~l.eqNullSafe(r), F.struct(F.lit(name).alias("field"), text(l).alias("left_value"), text(r).alias("right_value"))))
    none = F.lit(None).cast("string")
    for there, label in ((F.col("y.there"), only_left), (F.col("x.there"), only_right)):
        found.append(F.when(there.isNull(), F.struct(F.lit(label).alias("field"), none.alias("left_value"), none.alias("right_value"))))
    there = F.col("x.there").isNotNull()
    listed = both.select(
        *(F.when(there, F.col(f"x.{k}")).otherwise(F.col(f"y.{k}")).alias(n) for k, n in zip(ks, keys)),
        F.explode(F.array_compact(F.array(*found))).alias("d"),
    )
    return listed.select(*keys, "d.field", "d.left_value", "d.right_value")
