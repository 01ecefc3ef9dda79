"""Search, selection and statistics over a file index. Every function takes and gives DataFrames; nothing runs until asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, texts


def entries(files: DataFrame) -> DataFrame:
    """``files`` with name, ext, kind (type by extension) and media derived from the path."""
    ext = names.extension(F.col("path"))
    return files.withColumns({"name": names.file_name(F.col("path")), "ext": ext, "kind": names.file_type(ext), "media": names.media_type(ext)})


def by_type(files: DataFrame, asked: str) -> DataFrame:
    """Entries of the type that ``asked`` is a name of; none for a name unknown."""
    kind = next((k for k, aliases in names.TYPE_ALIASES.items() if asked.lower() in aliases.split()), None)
    return files.where(F.col("kind") == kind) if kind else files.where(F.lit(False))


def subsequence(files: DataFrame, text: str) -> DataFrame:
    """Entries whose name holds the characters of ``text`` in order, best first: ``score`` rewards early, short and unbroken matches.

    The score is this engine's own: 1000 less the length and place of the shortest leftmost match, 500 more for an unbroken one.
    """
    low, wanted = F.lower(F.col("name")), text.lower()
    lazy = ".*?".join(names.re.escape(c) for c in wanted)
    found = F.regexp_extract(low, f"({lazy})", 1)
    score = F.lit(1000) - F.length(found) - F.instr(low, found) + F.when(F.contains(low, F.lit(wanted)), 500).otherwise(0)
    return files.where(low.rlike(names.subsequence_pattern(text))).withColumn("score", score)


def glob(files: DataFrame, pattern: str) -> DataFrame:
    """Entries whose name a glob matches, case and all."""
    return files.where(F.col("name").rlike(names.glob_pattern(pattern)))


def regex(files: DataFrame, pattern: str) -> DataFrame:
    """Entries in whose path a regular expression is found."""
    return files.where(F.col("path").rlike(pattern))


def exact(files: DataFrame, text: str) -> DataFrame:
    """Entries whose name contains ``text``, in any case."""
    return files.where(F.contains(F.lower(F.col("name")), F.lit(text.lower())))


SEARCHES = {"subsequence": subsequence, "glob": glob, "regex": regex, "exact": exact}


def search(
    files: DataFrame,
    pattern: str,
    how: str = "exact",
    kind: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    after: str | None = None,
    before: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """A search with filters that all must hold; entries without a modification time pass the date filters.

    Filters on size and date compare plain columns, so they reach the scan. ``limit`` keeps the first by path.
    """
    out = SEARCHES[how](files, pattern)
    if kind:
        out = by_type(out, kind)
    if min_size is not None:
        out = out.where(F.col("size") >= min_size)
    if max_size is not None:
        out = out.where(F.col("size") <= max_size)
    if after:
        out = out.where(F.col("modified").isNull() | (F.col("modified") >= texts.day_start(F.lit(after))))
    if before:
        out = out.where(F.col("modified").isNull() | (F.col("modified") <= texts.day_end(F.lit(before))))
    return out.orderBy("path").limit(limit) if limit is not None else out


def scan_filter(files: DataFrame, root: Column, extensions: Sequence[str] = (), hidden: bool = False, max_depth: int | None = None) -> DataFrame:
    """What a scan of ``root`` keeps: extensions in any case and with or without dot, hidden parts below the root, depth."""
    relative = F.expr("substring(path, length(__root) + 1)")
    out = files.withColumn("__root", root)
    if extensions:
        out = out.where(F.col("ext").isin([e.lower().lstrip(".") for e in extensions]))
    if not hidden:
        out = out.where(~names.is_hidden(relative))
    if max_depth is not None:
        out = out.where(names.depth(relative) <= max_depth)
    return out.drop("__root")


# What each occasion of a scan keeps: hidden files, extensions (none: all), depth (none: any).
SCENARIOS: dict[str, tuple[bool, str, int | None]] = {
    "deleted_files": (True, "", None),
    "corrupted_drive": (True, "", None),
    "lost_photos": (False, "jpg jpeg png gif heic heif raw cr2 nef arw dng mp4 mov avi", None),
    "backup_drive": (False, "", 10),
    "scan_everything": (True, "", None),
}


def scenario(files: DataFrame, root: Column, name: str) -> DataFrame:
    """What a scan for an occasion keeps."""
    hidden, extensions, depth = SCENARIOS[name]
    return scan_filter(files, root, extensions.split(), hidden, depth)


def summary(files: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Files and bytes per kind, of the selected paths or all."""
    chosen = files.join(selection.select("path").distinct(), "path", "left_semi") if selection is not None else files
    return chosen.groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def statistics(files: DataFrame) -> DataFrame:
    """Files, bytes and unreadable files per kind, and over all in the row ALL, from one aggregation."""
    by = files.rollup("kind").agg(
        F.count("*").alias("files"),
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
        F.count_if(F.coalesce("has_bad_sectors", F.lit(False))).alias("bad_files"),
        F.grouping("kind").alias("whole"),
    )
    return by.select(F.when(F.col("whole") == 1, "ALL").otherwise(F.col("kind")).alias("kind"), "files", "bytes", "bad_files")


def distribution(files: DataFrame, bar: int = 40) -> DataFrame:
    """Share of each kind in whole percent and a bar against the largest. The windows run over one row per kind."""
    by = summary(files)
    every = Window.partitionBy()
    return by.select(
        "kind",
        "files",
        "bytes",
        F.floor(F.lit(100) * F.col("files") / F.sum("files").over(every)).cast("long").alias("percent"),
        F.floor(F.lit(bar) * F.col("files") / F.max("files").over(every)).cast("long").alias("bar"),
    )


def selected_bytes(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Number and bytes of the selected files."""
    return files.join(selection.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def inverted(files: DataFrame, selection: DataFrame) -> DataFrame:
    """The files that aren't selected."""
    return files.join(selection.select("path").distinct(), "path", "left_anti")


def united(*selections: DataFrame) -> DataFrame:
    """Every path of any selection, once."""
    out = selections[0].select("path")
    for s in selections[1:]:
        out = out.unionByName(s.select("path"))
    return out.distinct()


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row written of each key, whole: aggregated before the shuffle, so a key with a third of all rows is no burden."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("row"))
    return best.select(key, *(F.col("row")[c].alias(c) for c in [*order, *rest]))


def lookup(files: DataFrame, path: str) -> DataFrame:
    """One entry by its path, pushed to the scan."""
    return files.where(F.col("path") == path)


def tree(files: DataFrame) -> DataFrame:
    """Rows of a flat tree: path, name, depth."""
    return files.select("path", names.file_name(F.col("path")).alias("label"), F.size(F.filter(F.split("path", r"[/\\]"), lambda p: p != "")).alias("depth"))


def page(files: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of the files in order of path."""
    return files.orderBy("path").offset(number * size).limit(size)


def top_kinds(files: DataFrame, n: int = 6) -> DataFrame:
    """The kinds with most files."""
    return summary(files).orderBy(F.desc("files"), "kind").limit(n)


def around(rows: DataFrame, order: str, selected, height: int) -> DataFrame:
    """The ``height`` rows around the selected one, in order, with their number from 0.

    Rows before it are counted by an aggregate and the window is cut by two limits, so nothing is numbered in one task.
    """
    before = rows.where(F.col(order) < selected).count()
    first = max(0, before - height // 2)
    page_ = rows.orderBy(order).offset(first).limit(height)
    return page_.withColumn("n", (F.row_number().over(Window.orderBy(order)) + first - 1).cast("int"))


def first_by_path(files: DataFrame, n: int = 100) -> DataFrame:
    """The first files by path, as a scan of sectors takes them."""
    return files.orderBy("path").limit(n)
