"""Command line: index, search, dedup, carve, verify, report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import runtime
from .operators import carve, dedup, proof, search
from .sources import directory, images, sinks, stores


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tephra")
    c = p.add_subparsers(dest="command", required=True)
    for name, words in {"index": ["source", "index"], "search": ["index", "pattern"], "dedup": ["index"], "carve": ["image", "out"], "export": ["index", "dest"], "verify": ["manifest"], "report": ["index", "out"]}.items():
        q = c.add_parser(name)
        for w in words:
            q.add_argument(w)
        if name == "search":
            q.add_argument("--how", default="exact", choices=sorted(search.SEARCHES))
            q.add_argument("--kind")
        if name == "dedup":
            q.add_argument("--keep", default="newest", choices=dedup.KEEP)
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "index":
        found = directory.scan(spark, a.source)
        found.withColumn("has_bad_sectors", F.col("read_error").isNotNull()).write.mode("overwrite").parquet(a.index)
    elif a.command == "search":
        search.search(search.entries(spark.read.parquet(a.index)), a.pattern, a.how, a.kind).select("path", "size", "modified").show(100, truncate=False)
    elif a.command == "dedup":
        hashed = sinks.file_states(spark.read.parquet(a.index), "path").select(F.col("dest_path").alias("path"), "hash")
        files = spark.read.parquet(a.index).join(hashed, "path")
        dedup.exact_groups(files, a.keep).orderBy(F.desc("wasted_bytes"), "master").show(100, truncate=False)
    elif a.command == "carve":
        options = carve.CarveOptions()
        blocks = images.image_blocks(spark, [a.image])
        found = carve.carve_files(carve.hits(blocks, "image", F.col("content"), F.col("base"), F.col("owned"), options), "image", options)
        named = found.withColumn("name", carve.carved_name(F.col("offset") * 0, F.col("offset"), F.col("extension")))
        done, kept = runtime.written(sinks.extract_carved(named, a.out, [a.image]), "carved")  # in full: show alone stops at its rows
        done.orderBy("name").show(100, truncate=False)
        runtime.forget(spark, kept)
    elif a.command == "export":
        done = sinks.export(spark.read.parquet(a.index), a.dest, [])
        stores.save_manifest(done.withColumn("exported_at", F.current_timestamp()), f"{a.dest}/manifest", "", a.dest)
    elif a.command == "verify":
        entries = stores.load_manifest(spark, a.manifest)
        status = proof.verified(entries, sinks.file_states(entries, "dest_path"), ["dest_path"], "size", "hash")
        bad = status.where("status <> 'Ok'")
        bad.show(100, truncate=False)
        return int(bad.limit(1).count() > 0)
    else:
        files = search.entries(spark.read.parquet(a.index))
        errors = files.where("read_error IS NOT NULL").select(F.col("read_error").alias("error"))
        with open(a.out, "w") as f:
            f.writelines(sinks.html_parts("Files", search.summary(files), errors, {"index": a.index}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
