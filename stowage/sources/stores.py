"""Stores that the chunk store is put together from: layouts, mirrors, handles, the hash cache, a metadata table by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.functions import binary, paths
from stowage.sources.chunkstore import ChunkStore


# ---- layouts: where a chunk's file lies below the store, and which hash a path names


def git_path(hashed: Column, depth: int = 2) -> Column:
    return paths.storage_path(hashed, depth)


def snug_path(hashed: Column) -> Column:
    """Two levels of two characters; hashes of less than four lie flat."""
    return F.when(F.length(hashed) < 4, hashed).otherwise(F.concat_ws("/", F.substring(hashed, 1, 2), F.substring(hashed, 3, 2), hashed))


def flat_path(hashed: Column) -> Column:
    return hashed


def is_valid_path(path: Column, layout: str = "git") -> Column:
    """Whether a path can name a chunk: its last part (flat: the whole path) is at least 32 hexadecimal digits."""
    tested = path if layout == "flat" else paths.name(path)
    return F.coalesce(tested.rlike("^[0-9a-fA-F]{32,}$"), F.lit(False))


LAYOUTS = {"git": git_path, "snug": snug_path, "flat": flat_path}


class Store:
    """A chunk store of one layout; operations take and give DataFrames, so a batch of any size is one job."""

    def __init__(self, spark: SparkSession, path: str, layout: str = "snug") -> None:
        self.held, self.layout = ChunkStore(spark, path), LAYOUTS[layout]

    def place(self, ids: DataFrame) -> DataFrame:
        return ids.withColumn("place", self.layout(F.col("hash")))

    def exists(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.held.chunks().select("hash", F.lit(True).alias("_held")).distinct(), "hash", "left").withColumn("found", F.coalesce("_held", F.lit(False))).drop("_held")

    def read(self, ids: DataFrame) -> DataFrame:
        """``ids`` with their content, null where there is none."""
        return ids.join(self.held.chunks().select("hash", "content"), "hash", "left")

    def read_range(self, ids: DataFrame) -> DataFrame:
        """``ids`` (hash, offset, length) with the bytes in that range; null outside."""
        return self.read(ids).withColumn("content", binary.cut(F.col("content"), F.col("offset"), F.col("length")))

    def size(self, ids: DataFrame) -> DataFrame:
        """Sizes alone: content is not read."""
        return ids.join(self.held.chunks().select("hash", "size"), "hash", "left")

    def write(self, files: DataFrame) -> int:
        return self.held.write(files)

    def write_files(self, files: DataFrame) -> int:
        """Files (content) as chunks under their SHA-256, with the metadata every file gets."""
        rows = files.select(F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size"), "content")
        new = self.held.write(rows)
        meta = rows.select("hash", F.lit(0).cast("long").alias("seq"), "size", F.lit("application/octet-stream").alias("content_type"), F.lit(None).cast("string").alias("original_filename"), F.array().cast("array<string>").alias("original_paths"), F.lit(None).cast("long").alias("created"), F.lit(None).cast("long").alias("modified"))
        self.held.merge_metadata(meta)
        return new

    def update(self, metadata: DataFrame) -> None:
        """New metadata of held chunks; their bytes never change."""
        self.held.merge_metadata(metadata.join(self.held.chunks().select("hash").distinct(), "hash", "left_semi"))

    def open(self, hashed: str) -> Handle:
        return Handle(self, hashed)


class Handle:
    """One chunk, read by ranges until it is closed."""

    def __init__(self, store: Store, hashed: str) -> None:
        rows = store.held.chunks().where(F.col("hash") == hashed)
        if rows.select("hash").isEmpty():
            raise KeyError(hashed)
        self.rows, self.closed = rows, False

    def read(self, offset: int = 0, length: int | None = None) -> bytes:
        if self.closed:
            raise ValueError("the handle is closed")
        size = F.length("content")
        data = F.substring(F.col("content"), F.lit(offset + 1), size if length is None else F.lit(length))
        return bytes(self.rows.select(data.alias("d")).first()["d"])

    def close(self) -> None:
        self.closed = True


class Mirrored:
    """Stores in order: reads take the first that has a chunk, writes go to all, a store that fails is reported."""

    def __init__(self, *stores: Store) -> None:
        self.stores = stores

    def _held(self, columns: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.held.chunks().select(*columns).withColumn("store", F.lit(k)) for k, s in enumerate(self.stores)])

    def exists(self, ids: DataFrame) -> DataFrame:
        return self.size(ids).select(*ids.columns, F.col("size").isNotNull().alias("found"))

    def size(self, ids: DataFrame) -> DataFrame:
        first = self._held(["hash", "size"]).groupBy("hash").agg(F.min_by("size", "store").alias("size"))
        return ids.join(first, "hash", "left")

    def read(self, ids: DataFrame) -> DataFrame:
        """Which store has each chunk is decided without content; only the chosen copy is read."""
        first = self._held(["hash"]).join(ids.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.min("store").alias("store"))
        return ids.join(first.join(self._held(["hash", "content"]), ["hash", "store"]), "hash", "left")

    def read_range(self, ids: DataFrame) -> DataFrame:
        return self.read(ids).withColumn("content", binary.cut(F.col("content"), F.col("offset"), F.col("length")))

    def write(self, files: DataFrame) -> list[int | str]:
        """New chunks in each store; a mirror's failure is its message, the first store's is raised."""
        out: list[int | str] = [self.stores[0].write(files)]
        for store in self.stores[1:]:
            try:
                out.append(store.write(files))
            except Exception as e:
                out.append(f"{type(e).__name__}: {e}")
        return out

    def delete(self, ids: DataFrame, into: list[str]) -> Mirrored:
        fresh = []
        for store, path in zip(self.stores, into, strict=True):
            own = Store(store.held.spark, path)
            own.held, own.layout = store.held.delete(ids, path), store.layout
            fresh.append(own)
        return Mirrored(*fresh)


class HashCache:
    """Hashes of files by path, for one algorithm, the last used kept; written as a whole in one table."""

    SCHEMA = "path string, size long, mtime long, hash string, algorithm string, last_access long"

    def __init__(self, rows: DataFrame, algorithm: str = "sha256", most: int = 100_000) -> None:
        self.algorithm, self.most = algorithm, most
        self.rows = rows

    @classmethod
    def load(cls, spark: SparkSession, path: str, algorithm: str = "sha256", most: int = 100_000) -> HashCache:
        """Entries of the algorithm alone, the ``most`` used last; a table that can't be read is an empty cache."""
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.schema(cls.SCHEMA).parquet(path)
        except AnalysisException:
            rows = spark.createDataFrame([], cls.SCHEMA)
        return cls(rows.where(F.col("algorithm") == algorithm).orderBy(F.desc("last_access"), "path").limit(most), algorithm, most)

    def get(self, listing: DataFrame, tolerance_us: int = 1_000_000) -> DataFrame:
        from stowage.operators import store

        return store.cached_hashes(listing, self.rows, self.algorithm, tolerance_us)

    def set(self, fresh: DataFrame) -> HashCache:
        """``fresh`` replaces what the cache has of the same paths; the least used go beyond the limit."""
        own = fresh.withColumn("algorithm", F.lit(self.algorithm)).dropDuplicates(["path"])
        kept = self.rows.join(own.select("path"), "path", "left_anti").unionByName(own.select(*self.rows.columns))
        return HashCache(kept.orderBy(F.desc("last_access"), "path").limit(self.most), self.algorithm, self.most)

    def remove(self, gone: DataFrame) -> HashCache:
        return HashCache(self.rows.join(gone.select("path"), "path", "left_anti"), self.algorithm, self.most)

    def clear(self) -> HashCache:
        return HashCache(self.rows.limit(0), self.algorithm, self.most)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)


def save_index(meta: DataFrame, path: str) -> None:
    """Metadata sorted by hash, so a look-up reads few row groups; written once for all look-ups."""
    meta.repartitionByRange("hash").sortWithinPartitions("hash").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The saved index; where there is none, an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def rate_and_eta(done: DataFrame, total: int) -> DataFrame:
    """Rows (finished, seconds) with their running number, rate a second and seconds left, by finishing order in blocks of a minute."""
    blocked = done.withColumn("block", F.floor(F.col("seconds") / 60))
    inside = Window.partitionBy("block").orderBy("seconds", "finished").rowsBetween(Window.unboundedPreceding, 0)
    before = blocked.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    n = F.col("n0") + F.count("*").over(inside)
    rows = blocked.join(before, "block").withColumn("completed", n)
    rate = F.when(F.col("seconds") > 0, F.col("completed") / F.col("seconds"))
    return rows.select("finished", "seconds", "completed", rate.alias("rate"), F.when(rate > 0, (F.lit(total) - F.col("completed")) / rate).alias("eta"))
