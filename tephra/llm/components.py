"""Groups of records that pairwise matches link directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import forget, written

#: At most so many keys of a join are looked up by broadcast: those with more than 1 / HOT_NODES of its rows.
HOT_NODES = 1000
#: With fewer rows than this a key is not hot.
HOT_LINKS = 100_000


def _kept(df: DataFrame, tag: str, **counts) -> tuple[DataFrame, str, dict[str, int]]:
    """``df`` written to the shared folder and read back, with sums that are taken while it is written."""
    seen = Observation()
    taken = [F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items())]
    kept, at = written(df.observe(seen, *taken), tag)
    return kept, at, seen.get


def _looked_up(rows: DataFrame, n: int, end: str, found: DataFrame) -> DataFrame:
    """``rows`` (about ``n``) with what ``found`` (node, root; one row per node) has for the column ``end``, as column root.

    A key with more than its share of 1 / HOT_NODES of the rows, and more than HOT_LINKS, is looked up by
    broadcast; by the pigeonhole principle there are at most HOT_NODES of them, and their rows stay where they are.
    """

    def met(some: DataFrame, where: DataFrame) -> DataFrame:
        return some.join(where, F.col(end) == F.col("node"), "left").drop("node")

    by_node = found.select("node", "root")
    if n <= HOT_LINKS:
        return met(rows, by_node)
    hot = F.broadcast(rows.groupBy(F.col(end).alias("hot")).count().where(F.col("count") > max(HOT_LINKS, n // HOT_NODES)).select("hot"))
    busy = met(rows.join(hot, F.col(end) == F.col("hot"), "left_semi"), F.broadcast(by_node.join(hot, F.col("node") == F.col("hot"), "left_semi")))
    return busy.unionByName(met(rows.join(hot, F.col(end) == F.col("hot"), "left_anti"), by_node))


def _jumped(parents: DataFrame, n: int) -> DataFrame:
    """Each node's root replaced by that one's own root; ``moved`` where it had one."""
    once = _looked_up(parents.select(F.col("node").alias("from"), F.col("root").alias("to")), n, "to", parents)
    return once.select(F.col("from").alias("node"), F.coalesce("root", "to").alias("root"), F.col("root").isNotNull().alias("moved"))


def components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node of a pair of two different nodes; component is its smallest node.

    Each round gives every node the smallest label among its neighbours, follows the labels to their roots
    by pointer jumping, and replaces the ends of the edges by what was reached; edges within a group vanish and
    parallel ones become one, so rounds shrink quickly. Jumping goes on while over a tenth of the nodes move; the
    edges of those few whose root isn't reached yet lie in the next round between the places they came to, so no
    link is lost. A round in which no edge is left changes no label and ends the work. Then the maps of the rounds
    are composed from the last to the first, two at a time, and written, so what is returned reads one table
    however many rounds there were. Every step goes to the shared folder and is deleted once the next stands;
    nothing is kept in executors and only counts, taken while a step is written, reach the driver. The work is
    done when this function is called.

    Minima are taken partially before the shuffle. A node of very many links, or a root of very many nodes, is
    looked up by broadcast, of at most HOT_NODES rows by the pigeonhole principle, so its rows never meet in one task.

    Defined results: pairs with a NULL end or of a node with itself link nothing and bring no node; order and
    repetition of pairs are immaterial; no pairs, no rows. Other columns are never read.
    """
    spark = pairs.sparkSession
    a, b = pairs[left].cast("long"), pairs[right].cast("long")
    edges, edges_at, seen = _kept(pairs.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    maps: list[tuple[DataFrame, str, int]] = []
    while n := seen["rows"]:
        # The root of a smallest node is itself and isn't kept.
        parents, m = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), n
        at, moving = None, True
        while moving:
            jumped, at_last = _jumped(_jumped(parents, m), m), at
            parents, at, seen = _kept(jumped, "parents", moved=F.col("moved"))
            if at_last:
                forget(spark, at_last)
            m, moving = seen["rows"], seen["moved"] * 10 > seen["rows"]
        maps.append((parents.select("node", "root"), at, m))
        moved = edges
        for end in ("a", "b"):
            moved = _looked_up(moved, n, end, maps[-1][0]).withColumn(end, F.coalesce("root", end)).drop("root")
        at_last = edges_at
        edges, edges_at, seen = _kept(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        forget(spark, at_last)
    forget(spark, edges_at)
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    whole, whole_at, _ = maps.pop()
    while maps:
        taken, both = [whole_at], whole
        for earlier, at, m in (maps.pop() for _ in range(min(2, len(maps)))):
            taken.append(at)
            through = _looked_up(earlier.select(F.col("node").alias("from"), F.col("root").alias("to")), m, "to", both)
            both = through.select(F.col("from").alias("node"), F.coalesce("root", "to").alias("root")).unionByName(both).groupBy("node").agg(F.min("root").alias("root"))
        whole, whole_at, _ = _kept(both, "labels")
        for at in taken:
            forget(spark, at)
    roots = whole.select(F.col("root").alias("node"), "root").distinct()
    return whole.unionByName(roots).select("node", F.col("root").alias("component"))
