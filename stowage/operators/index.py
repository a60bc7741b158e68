"""Chunk metadata index: build, look-ups, search, and its policy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_path(meta: DataFrame, path: str) -> DataFrame:
    return meta.where(F.array_contains("original_paths", path))


def by_path_prefix(meta: DataFrame, prefix: str) -> DataFrame:
    """A hash once for each of its paths that starts with the prefix."""
    return meta.withColumn("path", F.explode("original_paths")).where(F.col("path").startswith(prefix))


def by_size(meta: DataFrame, low: int, high: int) -> DataFrame:
    return meta.where((F.col("size") >= low) & (F.col("size") < high))


def by_content_type(meta: DataFrame, content_type: str) -> DataFrame:
    return meta.where(F.col("content_type") == content_type)


def get(meta: DataFrame, hashed: str) -> DataFrame:
    return meta.where(F.col("hash") == hashed)


def postings(meta: DataFrame, key: str) -> DataFrame:
    """(key, hash) rows of an inverted index: relational, so that no key's list is ever one row."""
    column = F.explode("original_paths") if key == "path" else F.col(key)
    return meta.select(column.alias(key), "hash").where(F.col(key).isNotNull()).distinct()


def stats(meta: DataFrame) -> DataFrame:
    paths = meta.select(F.explode("original_paths").alias("path")).agg(F.countDistinct("path"))
    return meta.agg(F.count("*").alias("entries"), F.countDistinct("size").alias("sizes"), F.countDistinct("content_type").alias("content_types")).withColumn("paths", paths.scalar())


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same hash."""
    return old.join(new.select("hash"), "hash", "left_anti").unionByName(new)


def search(images: DataFrame, *, hash: str | None = None, filename: str | None = None, filename_contains: str | None = None, all_tags=(), any_tag=(), length: int | None = None, min_length: int | None = None, max_length: int | None = None, title_contains: str | None = None, publisher: str | None = None, developer: str | None = None) -> DataFrame:
    """Conjunction of the criteria given; a null never meets one."""
    tests = []
    for column, value in (("hash", hash), ("filename", filename), ("length", length), ("publisher", publisher), ("developer", developer)):
        if value is not None:
            tests.append(F.col(column) == value)
    for column, value in (("filename", filename_contains), ("title", title_contains)):
        if value is not None:
            tests.append(F.contains(F.lower(column), F.lit(value.lower())))
    if all_tags:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, all_tags)), "tags")) == 0)
    if any_tag:
        tests.append(F.arrays_overlap(F.array(*map(F.lit, any_tag)), "tags"))
    if min_length is not None:
        tests.append(F.col("length") >= min_length)
    if max_length is not None:
        tests.append(F.col("length") <= max_length)
    for test in tests:
        images = images.where(test)
    return images


def available_locations(locations: DataFrame) -> DataFrame:
    """Locations that exist and are writable, by priority."""
    return locations.where("present and writable").orderBy("priority", "path")


def primary_location(locations: DataFrame) -> DataFrame:
    return available_locations(locations).orderBy((F.col("type") != "primary").cast("int"), "priority", "path").limit(1)


def mirror_plan(locations: DataFrame) -> DataFrame:
    """Role of each usable location: the primary, mirrors (mirror or secondary), glaciers."""
    first = primary_location(locations).select(F.col("path").alias("first"))
    rows = available_locations(locations).withColumn("first", first.scalar())
    role = F.when(F.col("path") == F.col("first"), "primary").when(F.col("type") == "glacier", "glacier").otherwise("mirror")
    return rows.select("path", "type", "priority", role.alias("role"))
