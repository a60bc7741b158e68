"""Trees of entries by path: roll-ups, listings, navigation, traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths


def with_ancestors(entries: DataFrame) -> DataFrame:
    """Entries (path, kind, size) and the folders above them that no row names."""
    folders = entries.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).where("path <> ''").distinct()
    missing = folders.join(entries.select("path"), "path", "left_anti").select("path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("size"))
    return entries.select("path", "kind", "size").unionByName(missing)


def folder_sizes(entries: DataFrame) -> DataFrame:
    """Bytes and files under every folder, the root as ''; files are summed by their folder before its ancestors are listed."""
    direct = entries.where("kind <> 'directory'").groupBy(paths.parent(F.col("path")).alias("own")).agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    above = F.when(F.col("own") == "", F.array(F.lit(""))).otherwise(F.concat(paths.ancestors(F.col("own")), F.array("own")))
    rows = direct.select(F.explode(above).alias("folder"), "size", "files")
    return rows.groupBy("folder").agg(F.sum("size").cast("long").alias("size"), F.sum("files").cast("long").alias("files"))


def folder_contents(entries: DataFrame) -> DataFrame:
    """Direct children of every folder, by kind."""
    rows = entries.withColumn("folder", paths.parent(F.col("path")))
    return rows.groupBy("folder").agg(F.count_if(F.col("kind") != "directory").alias("files"), F.count_if(F.col("kind") == "directory").alias("folders"))


def children(entries: DataFrame, folder: str, kind: str | None = None) -> DataFrame:
    rows = entries.where(paths.parent(F.col("path")) == folder)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def with_parent(entries: DataFrame) -> DataFrame:
    """Entry and its parent folder's kind: a self equi-join."""
    above = entries.where("kind = 'directory'").select(F.col("path").alias("parent"), F.col("size").alias("parent_size"))
    return entries.withColumn("parent", paths.parent(F.col("path"))).join(above, "parent", "left")


def traverse(entries: DataFrame) -> DataFrame:
    """Pre-order place of each entry as its path's components: sorting by it is the walk."""
    return entries.withColumn("depth", F.size(F.split("path", "/"))).withColumn("walk", F.split("path", "/"))


def navigate(entries: DataFrame, base: str, path: str) -> DataFrame:
    """The entry that ``path`` names from ``base``; none if there is none."""
    asked = paths.resolve(F.lit(base), F.lit(path))
    return entries.where(F.col("path") == asked)


def file_at(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Files that (folder, name) name; a leading slash of the folder does not count."""
    keyed = asked.withColumn("path", F.concat_ws("/", F.nullif(F.ltrim("folder", F.lit("/")), F.lit("")), "name"))
    return keyed.join(entries.where("kind <> 'directory'"), "path", "left").select("folder", "name", "path", "kind", "size")


def rooted(entries: DataFrame, root: str) -> DataFrame:
    """Entries with their absolute path below ``root``, and the root's name."""
    return entries.withColumns({"absolute": F.concat_ws("/", F.lit("/" + root.strip("/")), "path"), "root": F.lit(root.strip("/"))})


def add_child(entries: DataFrame, folder: str, name: str, kind: str, size: int) -> DataFrame:
    """The tree with one more entry; one of the same path is replaced."""
    path = "/".join(x for x in (folder.strip("/"), name) if x)
    row = entries.sparkSession.createDataFrame([(path, kind, size)], "path string, kind string, size long")
    return entries.where(F.col("path") != path).select("path", "kind", "size").unionByName(row)


def remove_child(entries: DataFrame, path: str) -> DataFrame:
    """The tree without an entry and all below it."""
    return entries.where((F.col("path") != path) & ~F.col("path").startswith(f"{path}/"))


def count_files(entries: DataFrame, patterns=()) -> DataFrame:
    """Number of files that are neither hidden nor ignored."""
    seen = (F.col("kind") == "file") & ~paths.is_hidden(F.col("path")) & ~paths.ignored(F.col("path"), patterns)
    return entries.agg(F.count_if(seen).alias("files"))


def entry_metadata(entries: DataFrame) -> DataFrame:
    """Entries as generic metadata: what is known beyond path, kind and size goes to a map without nulls and false values."""
    known = [c for c in entries.columns if c not in ("path", "kind", "size")]
    value = lambda c: F.when(F.col(c).cast("string") != "false", F.col(c).cast("string"))
    attributes = F.map_filter(F.create_map(*[x for c in known for x in (F.lit(c), value(c))]), lambda _, v: v.isNotNull()) if known else F.create_map().cast("map<string,string>")
    return entries.select("path", paths.name(F.col("path")).alias("name"), "kind", "size", attributes.alias("attributes"))


def fs_entries(entries: DataFrame) -> DataFrame:
    return entries.where("kind <> 'directory'")


def fs_folders(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'directory'")
