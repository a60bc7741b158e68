"""Registries as dimension tables: file types, extensions, file systems, archive items, storage locations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import paths, types

TYPES = "type_id string, short_id string, extensions array<string>, magic array<struct<offset:int,bytes:binary>>, version string, category string, pos int"
# File system formats with capacity, sub-folders, first year and whether they are still in use.
FILE_SYSTEMS = (
    ("iso9660", 737280000, True, 1988, True), ("fat32", 1073741824, True, 1996, True), ("ntfs", 10737418240, True, 1993, True), ("exfat", 10737418240, True, 2006, True),
    ("apple-dos-3.3", 143360, False, None, False), ("prodos", 143360, True, None, False), ("ucsd-pascal", 0, True, None, False), ("c64-1541", 174848, False, None, False),
    ("c64-1581", 819200, False, None, False), ("atari-dos20", 92160, False, None, False), ("atari-dos25", 92160, False, None, False), ("cpm-22", 184320, False, None, False),
    ("msdos-fat12", 1474560, True, None, False), ("msdos-fat16", 10485760, True, None, False),
)
# Elements of an archive item's description.
ITEM_FIELDS = ("identifier", "description", "emulator", "emulator_ext", "language", "mediatype", "scanner", "title", "publicdate", "uploader", "addeddate", "backup_location", "notes")
ITEM_IMAGES = {"iso": 1, "dmg": 2, "img": 3, "vhd": 4}


def file_types(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Registered file types in the order of registration; a later row of the same id replaces the earlier."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate({r[0]: r for r in rows}.values())], TYPES)


def file_systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILE_SYSTEMS, "format string, capacity long, subdirectories boolean, inception int, in_use boolean").withColumn("display_name", F.upper("format"))


def _magic_matches(content: Column, magic: Column) -> Column:
    """Whether any magic (offset, bytes) stands in the content; an empty one matches nothing."""
    return F.exists(magic, lambda m: (F.length(m["bytes"]) > 0) & (F.hex(F.substring(content, m["offset"] + 1, F.length(m["bytes"]))) == F.hex(m["bytes"])))


def find_types(registered: DataFrame, probe: str) -> DataFrame:
    """Types whose id, short id (in lower case) or extension is ``probe``."""
    low = probe.lower().lstrip(".")
    return registered.where((F.col("type_id") == probe) | (F.col("short_id") == low) | F.array_contains("extensions", low)).orderBy("pos")


def full_id(type_id: Column, version: Column) -> Column:
    """The id with its version, unless it already ends with one."""
    return F.when(version.isNull() | type_id.rlike(r"\.v[0-9.]+$"), type_id).otherwise(F.concat(type_id, F.lit(".v"), version))


def types_by_extension(files: DataFrame, registered: DataFrame) -> DataFrame:
    """Files (file, extension) with every type of their extension: an equi-join on the normalised extension."""
    kinds = registered.select("type_id", "pos", "magic", F.explode("extensions").alias("extension"))
    return files.withColumn("extension", paths.normalize_extension(F.col("extension"))).join(F.broadcast(kinds), "extension", "left")


def detect_by_data(files: DataFrame, registered: DataFrame) -> DataFrame:
    """First registered type whose magic matches the content of (file, content)."""
    kinds = registered.agg(F.array_sort(F.collect_list(F.struct("pos", "type_id", "magic"))).alias("kinds"))  # the registry, some hundred rows
    hit = F.filter("kinds", lambda k: _magic_matches(F.col("content"), k["magic"]))
    return files.crossJoin(F.broadcast(kinds)).select("file", F.get(F.transform(hit, lambda k: k["type_id"]), F.lit(0)).alias("type_id"))


def detect(files: DataFrame, registered: DataFrame) -> DataFrame:
    """By extension; of several candidates the first whose magic matches, else the first."""
    found = types_by_extension(files, registered).withColumn("hit", F.coalesce(_magic_matches(F.col("content"), F.col("magic")), F.lit(False)))
    return found.groupBy("file").agg(F.min_by("type_id", F.struct((~F.col("hit")).alias("miss"), "pos")).alias("type_id"))


def registry_sets(extensions: DataFrame) -> DataFrame:
    """(kind, name, extensions) of a table (extension, type, category): all extensions of each type and category, and of everything."""
    by = lambda kind, column: extensions.groupBy(F.col(column).alias("name")).agg(F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("extensions")).select(F.lit(kind).alias("kind"), "name", "extensions")
    whole = extensions.agg(F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("extensions")).select(F.lit("all").alias("kind"), F.lit("").alias("name"), "extensions")
    return by("type", "type").unionByName(by("category", "category")).unionByName(whole)


def register(extensions: DataFrame, more: DataFrame) -> DataFrame:
    """The table with ``more`` registered: an extension registered anew leaves nothing of its former type."""
    key = paths.normalize_extension(F.col("extension"))
    more = more.withColumn("extension", key).dropDuplicates(["extension"])
    return extensions.withColumn("extension", key).join(more.select("extension"), "extension", "left_anti").unionByName(more)


def unregister(extensions: DataFrame, gone: list[str]) -> DataFrame:
    return extensions.where(~F.col("extension").isin([g.lower().lstrip(".") for g in gone]))


def by_name(rows: DataFrame, category: str | None = None, tag: str | None = None) -> DataFrame:
    """Registry rows (name, category, tags) of a category and a tag, by name."""
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    return rows.orderBy("name")


def first_answer(*answers: Column) -> Column:
    """First provider that answers; also how detectors of bootability are asked, whose "unknown" is no answer."""
    return F.coalesce(*answers)


def bootability(specific: Column, *general: Column) -> Column:
    known = [F.nullif(a, F.lit("unknown")) for a in (specific, *general)]
    return F.coalesce(*known, F.lit("unknown"))


# ---- archive items


def is_item_folder(entries: DataFrame) -> DataFrame:
    """Folders (folder, is_item): named ``*.archiveorg``, or with a disk image at any depth."""
    is_image = F.lower(paths.extension(F.col("path"))).isin(*ITEM_IMAGES)
    by_parent = entries.groupBy(paths.parent(F.col("path")).alias("parent")).agg(F.bool_or(is_image).alias("held"))
    above = by_parent.select(F.explode(F.array_union(F.array("parent"), paths.ancestors(F.col("parent")))).alias("folder"), "held")
    return above.groupBy("folder").agg(F.bool_or("held").alias("held")).select("folder", (F.col("held") | F.endswith(F.lower("folder"), F.lit(".archiveorg"))).alias("is_item"))


def main_images(files: DataFrame) -> DataFrame:
    """Main image of each folder (folder, path, extension, size): by extension, then the larger, then by path."""
    rank = types.lookup(F.col("extension"), ITEM_IMAGES)
    return files.where(rank.isNotNull()).groupBy("folder").agg(F.min_by(F.struct("path", "size"), F.struct(rank, -F.col("size"), "path")).alias("m")).select("folder", "m.path", "m.size")


def item_metadata(text: Column) -> Column:
    """Struct of an item's description in XML; blank values are null, ``collection`` repeats, what is no XML is null."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    one = lambda name: clean(F.xpath_string(text, F.lit(f"/metadata/{name}")))
    collections = F.filter(F.transform(F.xpath(text, F.lit("/metadata/collection/text()")), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(text.rlike(r"(?s)^\s*(<\?xml.*\?>)?\s*<metadata[ >].*</metadata>\s*$"), F.struct(*[one(n).alias(n) for n in ITEM_FIELDS], collections.alias("collections")))


# ---- storage locations


def storage_speed(path: Column, network: Column, external: Column, ssd: Column, thunderbolt: Column, usb3: Column) -> Column:
    """Speed class of a volume; network paths of cloud services are the slowest. Fixed values."""
    low = F.lower(path)
    cloud = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ("google drive", "googledrive", "dropbox", "onedrive", "icloud")])
    outside = F.when(ssd, F.when(thunderbolt, "very-fast").when(usb3, "fast").otherwise("medium")).otherwise("medium")
    return F.when(network, F.when(cloud, "very-slow").otherwise("slow")).when(external, outside).when(ssd, "very-fast").otherwise("medium")


def validate_config(locations: DataFrame, fail_if_unavailable: bool = False) -> DataFrame:
    """One row (is_valid, issues, warnings) for locations (path, label, priority, required, present, writable); the first by priority is the primary one."""
    place = F.row_number().over(Window.orderBy("priority", "path"))  # a configuration, some rows
    primary = F.col("place") == 1
    must = F.col("required") | (primary & F.lit(fail_if_unavailable))
    problem = F.when(~F.col("present"), "unavailable").when(~F.col("writable"), "not writable")
    name = F.when(primary, "Primary storage location").when(F.col("present"), "Storage location").otherwise("Optional storage location")
    rows = locations.withColumn("place", place).withColumn("problem", problem)
    issue = F.when(F.col("problem").isNotNull() & must, F.concat(F.when(F.col("present"), "storage not writable: ").otherwise("required storage missing: "), "path"))
    warning = F.when(F.col("problem").isNotNull() & ~must, F.concat(name, F.lit(" "), "problem", F.lit(": "), "path"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("place", c.alias("text"))))), lambda x: x["text"])
    found = rows.agg(listed(issue).alias("issues"), listed(warning).alias("warnings"), F.count_if(F.col("problem").isNull()).alias("usable"), F.count("*").alias("n"))
    none = (F.col("n") > 0) & (F.col("usable") == 0) & F.lit(fail_if_unavailable)
    issues = F.concat("issues", F.when(none, F.array(F.lit("no storage available"))).otherwise(F.array().cast("array<string>")))
    return found.select((F.size(issues) == 0).alias("is_valid"), issues.alias("issues"), "warnings")


def match_mirrors(mirrors: DataFrame, locations: DataFrame) -> DataFrame:
    """Mirror names with the first location of that path or label, else the name as a path."""
    keyed = locations.select(F.explode(F.array_distinct(F.array("path", "label"))).alias("name"), "path", "priority").where("name is not null")
    first = keyed.groupBy("name").agg(F.min_by("path", F.struct("priority", "path")).alias("found"))
    return mirrors.join(first, "name", "left").select("name", F.coalesce("found", "name").alias("path"), F.col("found").isNotNull().alias("configured"))


def with_default(locations: DataFrame, path: str) -> DataFrame:
    """Usable locations by priority; a default row of priority 999 where none is configured. A missing required one raises when read."""
    guard = F.when(F.col("required") & ~(F.col("present") & F.col("writable")), F.raise_error(F.concat(F.lit("required storage missing: "), "path")).cast("boolean")).otherwise(F.col("present") & F.col("writable"))
    usable = locations.where(guard).select("path", "priority")
    nothing = locations.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(path).alias("path"), F.lit(999).alias("priority"))
    return usable.unionByName(nothing).orderBy("priority", "path")
