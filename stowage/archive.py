"""Archives: create from a tree, list, validate against a store, extract with errors as rows.

An archive is a folder with ``entries`` and ``header`` tables; contents live once in a chunk store.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.dims import IGNORE_DEFAULTS
from stowage.functions import paths
from stowage.operators import store
from stowage.sources import fsentries
from stowage.sources.chunkstore import ChunkStore


def scan(spark: SparkSession, root: str, ignore=IGNORE_DEFAULTS, **options: str) -> DataFrame:
    """Typed entries of a tree, without ignored paths."""
    fsentries.register(spark)
    reader = spark.read.format("fsentries").option("path", root)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().where(~paths.ignored(F.col("path"), ignore))


def create(spark: SparkSession, root: str, archive: str, chunks: ChunkStore, ignore=IGNORE_DEFAULTS, embed_system: bool = False, **options: str) -> dict:
    """Write the archive and the new chunks; returns its statistics."""
    files = scan(spark, root, ignore, contents="true", **options)
    kind = F.when(F.col("kind").isin("file", "directory", "symlink"), F.col("kind")).otherwise("special")
    hashed = files.select(
        "path", kind.alias("type"), F.when(F.col("kind") == "file", F.col("size")).alias("size"), F.when(F.col("kind") == "file", F.sha2("content", 256)).alias("hash"), "target",
        F.when(kind == "special", F.col("kind")).alias("special_kind"), F.lpad(F.conv(F.col("mode").bitwiseAND(0o7777).cast("string"), 10, 8), 4, "0").alias("mode"),
        ((F.col("kind") == "file") & paths.should_embed(F.col("path"), F.col("kind"), embed_system)).alias("embedded"), F.col("content"),
    )
    chunks.write(hashed.where("type = 'file' and not embedded").select("hash", "size", "content"))
    # positions follow path order; counted by range partitions, not in one task
    ranged = hashed.withColumn("content", F.when(F.col("embedded"), F.col("content"))).repartitionByRange("path").sortWithinPartitions("path").withColumn("pos", F.monotonically_increasing_id())
    ranged.write.mode("overwrite").parquet(f"{archive}/entries")
    entries = spark.read.parquet(f"{archive}/entries")
    stats = store.archive_stats(entries)
    stats.write.mode("overwrite").parquet(f"{archive}/header")
    return spark.read.parquet(f"{archive}/header").first().asDict()


def entries(spark: SparkSession, archive: str) -> DataFrame:
    return spark.read.parquet(f"{archive}/entries")


def contents(spark: SparkSession, archive: str) -> DataFrame:
    return entries(spark, archive).select("path", "type", "size", "hash")


def load_metadata(spark: SparkSession, archive: str) -> dict:
    return spark.read.parquet(f"{archive}/header").first().asDict()


def validate(spark: SparkSession, archive: str, chunks: ChunkStore) -> dict:
    return store.validate(entries(spark, archive).where("not embedded"), chunks.chunks()).first().asDict()


def _write(output: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content, target, mode, error in zip(*(batch[c] for c in ("path", "type", "content", "target", "mode", "error")), strict=True):
                place = os.path.normpath(os.path.join(output, path))
                try:
                    if os.path.isabs(path) or not place.startswith(os.path.normpath(output) + os.sep):
                        raise ValueError("path leaves the output folder")
                    if error is not None:
                        raise LookupError(error)
                    os.makedirs(place if kind == "directory" else os.path.dirname(place), exist_ok=True)
                    if kind == "symlink":
                        if os.path.lexists(place):
                            os.remove(place)
                        os.symlink(target, place)
                    elif kind == "file":
                        with open(place, "wb") as f:
                            f.write(content)
                        os.chmod(place, int(mode, 8))
                    rows.append((path, True, None))
                except (OSError, ValueError, LookupError) as e:
                    rows.append((path, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ok", "error"])

    return run


def extract(spark: SparkSession, archive: str, chunks: ChunkStore, output: str) -> DataFrame:
    """Write the archive's tree below ``output`` (a folder all executors share); one row an entry tells how it went."""
    listed = entries(spark, archive)
    held = listed.where("embedded").withColumn("error", F.lit(None).cast("string"))
    stored = store.extract(listed.where("not embedded").drop("content"), chunks.chunks())
    columns = ["path", "type", "content", "target", "mode", "error"]
    return held.select(*columns).unionByName(stored.select(*columns)).mapInPandas(_write(output), "path string, ok boolean, error string")


def with_positions(frame: DataFrame, order: str) -> DataFrame:
    """Gapless positions in order: counted in range partitions, then shifted by the counts before."""
    ranged = frame.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_place", place).join(before, "_part").withColumn("pos", F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")
