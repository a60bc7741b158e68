"""Chunk store operators: registry, metadata merge, validation, extraction, mirrors, hash cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.dims import HASH_SIZES
from stowage.functions import types
from stowage.functions.hashing import hash_hex

def registry(entries: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """One row a hash: size, algorithm and the first position that has it. Content never enters the shuffle."""
    return entries.where("hash is not null").groupBy("hash").agg(F.max("size").alias("size"), F.min("pos").alias("first_pos"), F.count("*").alias("copies")).withColumn("algorithm", F.lit(algorithm))


def first_occurrence(entries: DataFrame) -> DataFrame:
    """The entry that registers its hash; an aggregate, so a hot hash costs one row a task."""
    columns = [c for c in entries.columns if c != "hash"]
    return entries.groupBy("hash").agg(F.min_by(F.struct(*columns), "pos").alias("e")).select("hash", *[f"e.{c}" for c in columns])


def archive_stats(entries: DataFrame) -> DataFrame:
    """Counts of files, directories and stored hashes, and the bytes of every file."""
    is_file = F.col("type") == "file"
    return entries.agg(
        F.count_if(is_file).alias("file_count"),
        F.count_if(F.col("type") == "directory").alias("directory_count"),
        F.countDistinct(F.when(is_file & ~F.col("embedded"), F.col("hash"))).alias("unique_hash_count"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).cast("long").alias("total_size"),
    )


def dedup_report(entries: DataFrame) -> DataFrame:
    held = registry(entries)
    return held.agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("bytes_before"), F.sum("size").cast("long").alias("bytes_after"), F.sum("copies").cast("long").alias("files"), F.count("*").alias("chunks"))


def merge_metadata(rows: DataFrame) -> DataFrame:
    """Sidecar merge of each hash in write order: the last size, the first type and name, all paths, least and greatest times."""
    return rows.groupBy("hash").agg(
        F.max_by("size", "seq").alias("size"),
        F.expr("min_by(content_type, seq) filter (where content_type is not null)").alias("content_type"),
        F.expr("min_by(original_filename, seq) filter (where original_filename is not null)").alias("original_filename"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("original_paths", F.array().cast("array<string>")))))).alias("original_paths"),
        F.min("created").alias("created"),
        F.max("modified").alias("modified"),
    )


def found(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    return entries.join(chunks.select("hash"), "hash", "left_semi")


def missing(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    return entries.join(chunks.select("hash"), "hash", "left_anti")


def exists(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    held = chunks.select("hash").distinct().withColumn("_held", F.lit(True))
    return ids.join(held, "hash", "left").withColumn("found", F.coalesce("_held", F.lit(False))).drop("_held")


def validate(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: whether all files exist, how many do and do not, and the distinct missing hashes' number."""
    rows = exists(entries.where("type = 'file' and hash is not null"), chunks)
    return rows.agg(
        F.coalesce(F.bool_and("found"), F.lit(True)).alias("all_exist"),
        F.count("*").alias("total_files"),
        F.count_if("found").alias("files_found"),
        F.count_if(~F.col("found")).alias("files_missing"),
        F.countDistinct(F.when(~F.col("found"), F.col("hash"))).alias("missing_hashes"),
    )


def extract(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries with their chunk; an unmatched hash becomes an error, not a failure."""
    joined = entries.join(chunks.select("hash", "content"), "hash", "left")
    error = F.when((F.col("type") == "file") & F.col("content").isNull(), F.concat(F.lit("hash not found: "), F.coalesce("hash", F.lit(""))))
    return joined.withColumn("error", error)


def error_summary(errors: DataFrame, message: str = "error", first: int = 5) -> DataFrame:
    """Number of errors and the first messages; the list is cut by a top-k, never collected whole."""
    rows = errors.where(F.col(message).isNotNull())
    top = rows.orderBy(message).limit(first).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    n = rows.agg(F.count("*").alias("error_count"))
    return n.select("error_count", top.scalar().alias("messages"), F.greatest(F.col("error_count") - first, F.lit(0)).alias("more"))


def mirrored(stores: list[DataFrame]) -> DataFrame:
    """First store in order that has a hash wins."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("store", F.lit(k)) for k, s in enumerate(stores)])
    return rows.groupBy("hash").agg(F.min("store").alias("store"), F.min_by("size", "store").alias("size"))


def cached_hashes(listing: DataFrame, cache: DataFrame, algorithm: str = "sha256", tolerance_us: int = 1_000_000) -> DataFrame:
    """Listing rows with the cached hash where path, size, algorithm and (within the tolerance) time agree."""
    latest = cache.where(F.col("algorithm") == algorithm).groupBy("path").agg(F.max_by(F.struct("size", "hash"), F.struct("mtime", "hash")).alias("e"), F.max("mtime").alias("_mtime"))
    held = latest.select("path", F.col("e.size").alias("_size"), "_mtime", F.col("e.hash").alias("_hash"))
    rows = listing.join(held, "path", "left")
    hit = F.coalesce((F.col("_size") == F.col("size")) & (F.abs(F.col("_mtime") - F.col("mtime")) < tolerance_us), F.lit(False))
    return rows.withColumn("hit", hit).withColumn("hash", F.when(hit, F.col("_hash")).otherwise(hash_hex(F.col("content"), algorithm))).drop("_size", "_mtime", "_hash", "content")


def cache_stats(looked_up: DataFrame) -> DataFrame:
    hits, n = F.count_if("hit"), F.count("*")
    return looked_up.agg(hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hit_rate"))


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries used last: a distributed top-k."""
    return cache.orderBy(F.desc("last_access"), "path").limit(most)


def _differs(content: Column, hashed: Column, algorithm: Column) -> Column:
    """Whether the digest that the algorithm makes is another; unknown algorithms are judged elsewhere."""
    found = F.lit(False)
    for name in HASH_SIZES:
        found = F.when(F.lower(algorithm) == name, F.lower(hashed) != hash_hex(content, name)).otherwise(found)
    return found


def read_validity(content: Column, hashed: Column, algorithm: Column, size: Column) -> Column:
    """struct(is_valid, errors, warnings) of a chunk that was read: a wrong digest gives two errors, another size than known a warning."""
    wrong = _differs(content, hashed, algorithm)
    errors = F.array_compact(F.array(F.when(hashed == "", "hash is empty"), F.when(~hashed.rlike("^[0-9a-fA-F]*$"), "hash contains non-hex characters"), F.when(wrong, "hash mismatch"), F.when(wrong, "content is not what was stored")))
    warnings = F.array_compact(F.array(F.when(size != F.octet_length(content), "size differs from the metadata")))
    return F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"))


def validity(content: Column, hashed: Column, algorithm: Column, allowed=("sha256",), least: int = 0, most: int | None = None) -> Column:
    """struct(is_valid, errors, warnings) of a chunk and its identifier; sizes are bytes, of text too."""
    errors = [
        F.when(hashed == "", "hash is empty"),
        F.when(~hashed.rlike("^[0-9a-fA-F]*$"), "hash contains non-hex characters"),
        F.when(~F.lower(algorithm).isin(*allowed), "algorithm not allowed"),
        F.when(F.octet_length(content) < least, "content too small"),
        F.when(_differs(content, hashed, algorithm), "hash mismatch"),
    ]
    if most is not None:
        errors.append(F.when(F.octet_length(content) > most, "content too large"))
    wrong = F.array_compact(F.array(*errors))
    digits = types.lookup(F.lower(algorithm), {k: 2 * v for k, v in HASH_SIZES.items()}, 64)
    warnings = F.array_compact(F.array(F.when(F.length(hashed) != digits, F.concat(F.lit("hash length "), F.length(hashed).cast("string")))))
    return F.struct((F.size(wrong) == 0).alias("is_valid"), wrong.alias("errors"), warnings.alias("warnings"))


def embedded_offsets(records: DataFrame, start: int, hash_length: int = 64) -> DataFrame:
    """Offset of each embedded record in position order.

    Lengths are summed by blocks of positions first, so no task holds more than one block in order.
    """
    sized = records.withColumn("length", F.lit(4 + hash_length + 8) + F.col("size")).withColumn("block", F.floor(F.col("pos") / 4096))
    inside = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("block").agg(F.sum("length").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    rows = sized.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(before, "block")
    return rows.withColumn("offset", (F.lit(start + 4) + F.col("before") + F.col("inside")).cast("long")).drop("length", "block", "inside", "before")


def running_progress(entries: DataFrame) -> DataFrame:
    """Files and bytes up to each position, summed by blocks of positions."""
    blocked = entries.withColumn("block", F.floor(F.col("pos") / 4096))
    inside = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = sums.select("block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(order), F.lit(0)).alias("s0"))
    rows = blocked.select("block", "pos", F.count("*").over(inside).alias("n1"), F.sum("size").over(inside).alias("s1")).join(before, "block")
    return rows.select("pos", (F.col("n0") + F.col("n1")).alias("files_done"), (F.col("s0") + F.col("s1")).cast("long").alias("bytes_done"))


def joined_offsets(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Embedded entries with the offset of their hash; of several the last by position."""
    last = offsets.groupBy("hash").agg(F.max_by("offset", "pos").alias("offset"))
    found = entries.join(last, "hash", "left")
    return found.withColumn("offset", F.when(F.col("embedded"), F.col("offset")))


def join_postings(postings: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata of the hashes of a posting list; hashes without any are dropped."""
    return postings.join(meta, "hash")
