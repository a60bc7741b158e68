"""Chunk stores as Parquet tables partitioned by the first two characters of the hash.

Chunks are written once: rows whose hash the store has are left out by an anti join. Metadata is merged by hash and replaces the
former table. Both work for any number of chunks; content is joined last and only where it is asked for.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import store
from stowage.schemas import CHUNK, CHUNK_META


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}").select(*[c.strip().split(" ")[0] for c in schema.split(", ")])
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK)

    def metadata(self) -> DataFrame:
        versions = self._versions()
        return self._read(f"metadata-{versions[-1]}", CHUNK_META) if versions else self.spark.createDataFrame([], CHUNK_META)

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        named = [s.getPath() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("metadata-")]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("-")[1]) for p in named if fs.exists(done(p, "_SUCCESS")))  # a job that died leaves no version

    def write(self, files: DataFrame) -> int:
        """Add chunks of ``files`` (hash, size, content) that are not held; returns how many were new."""
        new = files.select("hash", "size", "content").join(self.chunks().select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        counted = new.withColumn("shard", F.substring("hash", 1, 2))
        before = self.chunks().count()
        counted.write.mode("append").partitionBy("shard").parquet(f"{self.path}/chunks")
        return self.chunks().count() - before

    def merge_metadata(self, rows: DataFrame) -> None:
        """Merge sidecar rows into the held ones; the former version stays until the new one is whole."""
        versions = self._versions()
        merged = store.merge_metadata(self.metadata().select(*rows.columns).unionByName(rows)).withColumn("seq", F.lit(-1).cast("long"))
        merged.select(*self.metadata().columns).write.mode("overwrite").parquet(f"{self.path}/metadata-{versions[-1] + 1 if versions else 0}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in versions[:-1]:  # the version before stays for readers that have begun
            path = hadoop(f"{self.path}/metadata-{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def delete(self, ids: DataFrame, into: str) -> ChunkStore:
        """A store at ``into`` without the given hashes."""
        rest = self.chunks().join(ids.select("hash"), "hash", "left_anti")
        rest.withColumn("shard", F.substring("hash", 1, 2)).write.partitionBy("shard").parquet(f"{into}/chunks")
        return ChunkStore(self.spark, into)
