"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ID_BITS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only on one machine where it is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stowage/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables whose dependents are materialised too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the hashed ids, ``2 ** ID_BITS`` bits whatever their number: it lets through every id and few others."""
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << ID_BITS))
    words = ids.select(at.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("b")).toArrow()
    bitmap = np.zeros(1 << ID_BITS - 6, np.int64)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
    return bitmap


def split_by_filter(rows: DataFrame, ids: DataFrame, column: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose whole number ``key`` is surely not in ``ids``, all others); the filter travels in 2 ** 16 pieces at most, once to each executor."""
    bits = id_filter(ids, column).astype("<i8").view(np.uint8).reshape(-1, 64)
    held = np.flatnonzero(bits.any(axis=1))
    pieces = pa.table({"_piece": pa.array(held, pa.int64()), "_bits": pa.array([bits[k].tobytes() for k in held], pa.binary())})
    pieces = materialize(rows.sparkSession.createDataFrame(pieces), "id-filter")
    at = F.pmod(F.xxhash64(key.cast("long")), F.lit(1 << ID_BITS))
    marked = rows.withColumn("_at", at).withColumn("_piece", F.floor(F.col("_at") / 512)).join(F.broadcast(pieces), "_piece", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_at") / 8) % 64).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(~hit).select(*columns), marked.where(hit).select(*columns)


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def in_sample(doc_id: str, asked: int, rows: int) -> Column:
    """Whether the id's hash draws it into a sample of about ``asked`` of ``rows`` rows; the share is told in parts of 2**62, so it is no zero at any size."""
    share = (1 << 62) * min(asked, max(rows, 1)) // max(rows, 1)
    return F.shiftrightunsigned(F.xxhash64(doc_id), 2) < F.lit(share)
