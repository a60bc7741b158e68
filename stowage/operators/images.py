"""Disk images as DataFrames: layouts, metadata, sectors and writers for five formats.

``images`` has the columns ``image`` and ``content`` (binary). A layout is a struct (error, offset, sectors, sector_size, tracks, sides,
per_track, title, image_date); content that is no image of the format gets an error in it, never an exception. Sectors are cut
inside an array function before they are exploded, so no row carries the whole image for each of its sectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import binary

FORMATS = ("dmg", "iso", "vhd", "img", "raw")
TRAILER = 512
# Places inside the UDIF trailer, big-endian.
UDIF_32 = {"version": 4, "header_size": 8, "flags": 12}
UDIF_64 = {"running_offset": 16, "data_offset": 24, "data_length": 32, "rsrc_offset": 40, "rsrc_length": 48, "xml_offset": 200, "xml_length": 208, "sector_count": 424}
PVD = 32768


def _tail(content: Column) -> Column:
    return F.substring(content, -TRAILER, TRAILER)


def udif_trailer(content: Column) -> Column:
    """Fields of the trailer of a DMG image, or null."""
    tail = _tail(content)
    fields = [binary.unsigned(tail, at, 4).alias(k) for k, at in UDIF_32.items()] + [binary.unsigned_64(tail, at).alias(k) for k, at in UDIF_64.items()]
    return F.when(binary.can_read(content)["dmg"], F.struct(*fields))


def vhd_footer(content: Column) -> Column:
    """Geometry, type and time of a VHD image by the published layout, or null."""
    tail = _tail(content)
    fields = F.struct(
        binary.unsigned(tail, 56, 2).alias("cylinders"), binary.unsigned(tail, 58, 1).alias("heads"), binary.unsigned(tail, 59, 1).alias("sectors_per_track"),
        binary.unsigned(tail, 60, 4).alias("disk_type"), vhd_timestamp(binary.unsigned(tail, 24, 4)).alias("created"),
    )
    return F.when(binary.can_read(content)["vhd"], fields)


def vhd_timestamp(seconds: Column) -> Column:
    """Seconds since 2000 as a time."""
    return F.timestamp_seconds(F.lit(946684800) + seconds)


def iso_volume_date(text: Column) -> Column:
    """Time of a volume descriptor's digits, UTC; null if they are none."""
    return F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss"))


def iso_record_date(content: Column, offset: int = 0) -> Column:
    """Time of a directory record: one byte each for year since 1900, month, day, hour, minute, second."""
    part = [binary.unsigned(content, offset + k, 1).cast("int") for k in range(6)]
    return F.try_make_timestamp(part[0] + 1900, *part[1:])


def _ascii(content: Column, start: Column | int, length: int) -> Column:
    return F.decode(F.substring(content, start + 1, length), "US-ASCII")


def iso_pvd_fields(content: Column) -> Column:
    """Volume identifier, size in blocks and creation time of the primary volume descriptor, or null."""
    valid = (F.length(content) >= PVD + 2048) & (F.substring(content, PVD + 1, 6) == F.lit(b"\x01CD001"))
    fields = F.struct(F.trim(_ascii(content, PVD + 40, 32), F.lit(" \0")).alias("volume_id"), binary.unsigned(content, PVD + 80, 4, little=True).alias("blocks"), iso_volume_date(_ascii(content, PVD + 813, 17)).alias("created"))
    return F.when(valid, fields)


def _geometry(tracks, sides, per_track, sector_size) -> dict[str, Column]:
    named = {"tracks": tracks, "sides": sides, "per_track": per_track, "sector_size": sector_size}
    return {k: (F.lit(v) if isinstance(v, int) else v).cast("long") for k, v in named.items()}


def geometry_dmg(sector_count: Column) -> dict[str, Column]:
    return _geometry(F.greatest(F.floor(sector_count / 63), F.lit(1)), 1, 63, 512)


def geometry_raw(size: Column) -> dict[str, Column]:
    sector = binary.raw_sector_size(size)
    n = F.floor(size / sector)
    floppy = n <= 2880
    return _geometry(F.when(floppy, 80).otherwise(F.greatest(F.floor(n / 63), F.lit(1))), 1, F.when(floppy, 18).otherwise(63), sector)


def geometry_img(size: Column) -> dict[str, Column]:
    g = binary.floppy_geometry(F.floor(size / 512))
    return _geometry(g["tracks"], g["heads"], g["sectors_per_track"], 512)


def capacity(tracks: Column, sides: Column, per_track: Column, sector_size: Column) -> Column:
    """Bytes of a geometry; an unknown one counts as 35 tracks of 16 sectors of 256 bytes."""
    return F.coalesce(tracks * sides * per_track * sector_size, F.lit(35 * 16 * 256)).cast("long")


def layout(content: Column, kind: str) -> Column:
    """Struct of where the sectors of an image lie and how they are addressed."""
    size, zero = F.length(content).cast("long"), F.lit(0).cast("long")
    no_text, no_time = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    error = F.when(content.isNull() | ~binary.can_read(content)[kind], "invalid format")
    offset, title, date = zero, no_text, no_time
    if kind == "dmg":
        trailer = udif_trailer(content)
        geometry = geometry_dmg(trailer["sector_count"].try_cast("long"))
        offset, length = trailer["data_offset"].try_cast("long"), trailer["data_length"].try_cast("long")
        outside = trailer["data_offset"] + trailer["data_length"] > size  # decimals: no sum of them overflows
        error = F.when(error.isNotNull(), error).when(outside | (length < 512), "invalid data")
        sectors = F.floor(length / 512)
    elif kind == "iso":
        error = F.when(content.isNull() | (size < 2048), "invalid format")
        sectors = F.floor(size / 2048)
        geometry = _geometry(1, 1, sectors, 2048)
        fields = iso_pvd_fields(content)
        title, date = F.coalesce(fields["volume_id"], F.lit("Hybrid Disc")), fields["created"]
    elif kind == "vhd":
        footer = vhd_footer(content)
        geometry = _geometry(footer["cylinders"], footer["heads"], footer["sectors_per_track"], 512)
        sectors, date = F.floor((size - TRAILER) / 512), footer["created"]
    elif kind == "img":
        geometry = geometry_img(size)
        sectors = F.floor(size / 512)
    else:
        geometry = geometry_raw(size)
        sectors = F.floor(size / geometry["sector_size"])
    addressed = F.when(sectors.isNotNull(), F.least(sectors, geometry["tracks"] * geometry["sides"] * geometry["per_track"])).cast("long")
    return F.struct(error.alias("error"), offset.alias("offset"), addressed.alias("sectors"), *[v.alias(k) for k, v in geometry.items()], title.alias("title"), date.alias("image_date"))


def metadata(images: DataFrame, kind: str) -> DataFrame:
    """Title, time and geometry of each image, without its sectors."""
    found = images.select("image", layout(F.col("content"), kind).alias("l"))
    return found.select("image", "l.error", *[F.when(F.col("l.error").isNull(), F.col(f"l.{k}")).alias(k) for k in ("title", "image_date", "tracks", "sides", "per_track", "sector_size", "sectors")])


def read(images: DataFrame, kind: str) -> DataFrame:
    """Sectors (image, number, track, side, sector, data, flags) of the images that have no error.

    The generator keeps the optimiser from moving what makes the content into the function that cuts each sector.
    """
    held = images.select("image", F.explode(F.array("content")).alias("content"))
    found = held.select("image", "content", layout(F.col("content"), kind).alias("l")).where("l.error is null and l.sectors > 0")
    cuts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("l.sectors") - 1), lambda n: F.struct(n.alias("number"), F.substring(F.col("content"), (F.col("l.offset") + n * F.col("l.sector_size") + 1).cast("int"), F.col("l.sector_size").cast("int")).alias("data")))
    rows = found.select("image", F.col("l.sides").alias("sides"), F.col("l.per_track").alias("per_track"), F.explode(cuts).alias("s"))
    number, sides, per_track = F.col("s.number"), F.col("sides"), F.col("per_track")
    return rows.select("image", number.alias("number"), F.floor(number / (sides * per_track)).cast("long").alias("track"), (F.floor(number / per_track) % sides).cast("long").alias("side"), (number % per_track).cast("long").alias("sector"), F.col("s.data").alias("data"), F.lit(0).alias("flags"))


def sector_flags(flags: Column) -> dict[str, Column]:
    """What the bits of a sector's flags say. Fixed values."""
    return {name: flags.bitwiseAND(bit) != 0 for name, bit in {"deleted": 1, "weak": 2, "damaged": 4}.items()}


def tracks(sectors: DataFrame) -> DataFrame:
    """Sectors of each track and side, in order."""
    return sectors.groupBy("image", "track", "side").agg(F.count("*").alias("sectors"), F.sum(F.length("data")).cast("long").alias("bytes"), F.min("number").alias("first"))


def write(sectors: DataFrame, sector_size: int | None = None) -> DataFrame:
    """(image, content): all sectors of an image by track, side and sector; with a size each is padded with zeros or cut to it.

    An image is one value, so its sectors meet in one task: the formats bound them to some MB.
    """
    hexed = F.hex("data") if sector_size is None else F.rpad(F.hex("data"), 2 * sector_size, "0")
    parts = F.array_sort(F.collect_list(F.struct("track", "side", "sector", hexed.alias("h"))))
    return sectors.groupBy("image").agg(F.unhex(F.array_join(F.transform(parts, lambda s: s["h"]), "")).alias("content"))


def entry_read(entries: DataFrame, images: DataFrame) -> DataFrame:
    """Bytes of entries (image, path, offset, length) in their image; out of range is an error as a row."""
    joined = entries.join(images, "image", "left")
    data = binary.cut_strict(F.col("content"), F.col("offset"), F.col("length"))
    return joined.select("image", "path", data.alias("data"), F.when(F.col("content").isNull(), "image not found").when(data.isNull(), "invalid data").alias("error"))
