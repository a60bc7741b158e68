"""Hashes of binary or string columns, and their identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.dims import HASH_SIZES


def hash_hex(content: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex digest; the name is case-insensitive and an unknown one raises."""
    name = algorithm.lower()
    if name == "sha256":
        return F.sha2(content, 256)
    if name == "sha1":
        return F.sha1(content)
    if name == "md5":
        return F.md5(content)
    if name == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def hash_named(content: Column, algorithm: Column) -> Column:
    """The digest named by a column; an unknown name raises where the row is read."""
    found = F.raise_error(F.concat(F.lit("unknown hash algorithm: "), algorithm)).cast("string")
    for name in HASH_SIZES:
        found = F.when(F.lower(algorithm) == name, hash_hex(content, name)).otherwise(found)
    return found


def hash_bytes(content: Column, algorithm: str = "sha256") -> Column:
    return F.unhex(hash_hex(content, algorithm))


def identifier(content: Column, algorithm: str = "sha256") -> Column:
    return F.concat(F.lit(f"{algorithm}:"), hash_hex(content, algorithm))


def overhead_mb(algorithm: str, n: int) -> float:
    return n * HASH_SIZES[algorithm] / 2**20
