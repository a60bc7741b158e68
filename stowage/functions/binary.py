"""Integers, slices and headers inside binary columns; geometry of disk images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.dims import FLOPPY


def cut(content: Column, offset, length) -> Column:
    """Bytes [offset, offset + length), clipped at the end; null if the offset lies outside."""
    offset, length = (F.lit(x) if isinstance(x, int) else x for x in (offset, length))
    return F.when((offset >= 0) & (offset < F.length(content)), F.substring(content, offset.cast("int") + 1, length.cast("int")))


def cut_strict(content: Column, offset, length) -> Column:
    """The same, but null unless all of it lies inside."""
    offset, length = (F.lit(x) if isinstance(x, int) else x for x in (offset, length))
    return F.when(offset + length <= F.length(content), cut(content, offset, length))


def magic(content: Column) -> Column:
    return F.substring(content, 1, 16)


def header(content: Column) -> Column:
    return F.substring(content, 1, 512)


def tail(content: Column) -> Column:
    return F.substring(content, F.greatest(F.length(content) - 511, F.lit(1)), F.lit(512))


def unsigned(content: Column, offset: int, width: int, little: bool = False) -> Column:
    """Unsigned integer of up to seven bytes; null where the bytes are missing."""
    at = range(width) if not little else reversed(range(width))
    codes = [F.conv(F.hex(F.substring(content, offset + k + 1, 1)), 16, 10).cast("long") for k in at]
    return F.when(F.length(content) >= offset + width, reduce(lambda acc, c: acc * 256 + c, codes))


def unsigned_64(content: Column, offset: int, little: bool = False) -> Column:
    """Unsigned integer of eight bytes, as a decimal."""
    high, low = (unsigned(content, offset + k, 4, little).cast("decimal(20,0)") for k in ((4, 0) if little else (0, 4)))
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(20,0)")


def matches_magic(content: Column, offset: int, expected: bytes, mask: list[int] | None = None) -> Column:
    """Bytes at ``offset`` equal; a mask of the same length says which of them count. Empty magic matches nothing."""
    if not expected or (mask is not None and len(mask) != len(expected)):
        return F.lit(False)
    if mask is None:
        return F.coalesce(F.substring(content, offset + 1, len(expected)) == F.lit(expected), F.lit(False))
    same = [F.substring(content, offset + k + 1, 1) == F.lit(expected[k : k + 1]) for k, used in enumerate(mask) if used == 1]
    return reduce(lambda a, b: a & b, same, F.length(content) >= offset + len(expected))


def can_read(content: Column) -> dict[str, Column]:
    """Whether each image format accepts the content."""
    size = F.length(content)
    return {
        "dmg": (size >= 512) & (F.substring(content, -512, 4) == F.lit(b"koly")),
        "iso": (size >= 34816) & (F.substring(content, 32770, 5) == F.lit(b"CD001")),
        "vhd": (size >= 512) & (F.substring(content, -512, 8) == F.lit(b"conectix")),
        "img": size.between(360 * 1024, 10 * 1024 * 1024) & (size % 512 == 0),
        "raw": size.cast("long").between(64 * 1024, 10 * 1024**3),
    }


def raw_sector_size(size: Column) -> Column:
    return F.when(size % 2048 == 0, 2048).when(size % 512 == 0, 512).when(size % 256 == 0, 256).otherwise(512)


def floppy_geometry(sectors: Column) -> Column:
    """struct(tracks, heads, sectors_per_track) of a floppy with so many sectors of 512 bytes."""
    side = F.floor(sectors / 2)
    other = F.when(
        sectors % 2 == 0,
        F.when(side % 40 == 0, F.struct(F.lit(40).alias("tracks"), F.lit(2).alias("heads"), F.floor(side / 40).cast("int").alias("sectors_per_track")))
        .when(side % 80 == 0, F.struct(F.lit(80).alias("tracks"), F.lit(2).alias("heads"), F.floor(side / 80).cast("int").alias("sectors_per_track")))
        .otherwise(F.struct(F.ceil(side / 9).cast("int").alias("tracks"), F.lit(2).alias("heads"), F.lit(9).alias("sectors_per_track"))),
    ).otherwise(F.struct(F.ceil(sectors / 9).cast("int").alias("tracks"), F.lit(1).alias("heads"), F.lit(9).alias("sectors_per_track")))
    for known, (tracks, heads, per_track) in FLOPPY.items():
        other = F.when(sectors == known, F.struct(F.lit(tracks).alias("tracks"), F.lit(heads).alias("heads"), F.lit(per_track).alias("sectors_per_track"))).otherwise(other)
    return other


def sector_places(sector: Column, heads: int, per_track: int) -> dict[str, Column]:
    """Track, side and sector of a running number."""
    return {"track": F.floor(sector / (heads * per_track)).cast("long"), "side": (F.floor(sector / per_track) % heads).cast("long"), "sector": (sector % per_track).cast("long")}
