"""Incremental ingest: sidecar merges and index upserts as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators import store
from stowage.sources.chunkstore import ChunkStore


def merged_stream(rows: DataFrame) -> DataFrame:
    """The sidecar merge as a streaming aggregate; run it in ``update`` or ``complete`` mode."""
    return store.merge_metadata(rows)


def upsert_stream(spark: SparkSession, rows: DataFrame, chunks: ChunkStore, checkpoint: str):
    """Merge each micro-batch of sidecar rows into the store's metadata; restarts resume from the checkpoint."""

    def merge(batch: DataFrame, _: int) -> None:
        chunks.merge_metadata(batch)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last row of each key: the final state of an upsert stream."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
