"""Versions, type identifiers, type detection, groups, permissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.dims import CATEGORY_GROUPS, CODEC_EXTENSIONS, DEVICE_KINDS, IMAGE_TYPES, TYPE_GROUPS, ZIP_NAMES


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table."""
    found = F.lit(default)
    for k, v in reversed(table.items()):
        found = F.when(key == F.lit(k), F.lit(v)).otherwise(found)
    return found


def version(text: Column) -> Column:
    """struct(major, minor, patch, suffix, build), or null if there are not two leading numbers."""
    clean = F.trim(text)
    build = F.nullif(F.regexp_extract(clean, r"^[^+]*\+(.+)$", 1), F.lit(""))
    head = F.regexp_extract(clean, r"^([^+]*)", 1)
    suffix = F.nullif(F.regexp_extract(head, r"^[^-]*-(.+)$", 1), F.lit(""))
    numbers = F.filter(F.split(F.regexp_extract(head, r"^([^-]*)", 1), r"\."), lambda x: x != "")
    part = lambda k: F.get(numbers, F.lit(k)).try_cast("int")
    whole = F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"), suffix.alias("suffix"), build.alias("build"))
    return F.when(part(0).isNotNull() & part(1).isNotNull(), whole)


def version_key(v: Column) -> Column:
    """What versions are ordered by: suffix and build do not count."""
    return F.when(v.isNotNull(), F.struct(v["major"], v["minor"], F.coalesce(v["patch"], F.lit(0))))


def version_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.concat(F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string")), F.coalesce(F.concat(F.lit("-"), v["suffix"]), F.lit("")), F.coalesce(F.concat(F.lit("+"), v["build"]), F.lit(""))))


def format_name(text: Column) -> Column:
    low = F.lower(text)
    dos = F.concat(F.lit("dos"), F.coalesce(F.nullif(F.replace(F.regexp_extract(low, r"(3\.[0-9]+)", 1), F.lit("."), F.lit("")), F.lit("")), F.lit("33")))
    plain = F.regexp_replace(low, "apple-|apple|-|_", "")
    return F.when(low.startswith("apple-dos-"), dos).when(low == "ucsd-pascal", "pascal").when(low == "apple-ii-cpm", "cpm").when(low == "iso-9660", "iso9660").when(low.isin("2mg", "twomg"), "2mg").otherwise(plain)


def version_name(text: Column) -> Column:
    clean = F.trim(text)
    return F.replace(F.concat(F.when(clean.startswith("v"), "").otherwise("v"), clean), F.lit("-"), F.lit("."))


def image_identifier(image: Column, system: Column, system_version: Column) -> Column:
    dos = F.when((system == "apple-dos-3.3") & system_version.startswith("3."), F.concat(F.lit("dos3"), F.substring(system_version, F.lit(3), F.length(system_version))))
    last = F.when(system.isNotNull() & (F.coalesce(system_version, F.lit("")) != ""), version_name(system_version))
    return F.concat_ws(".", F.lit("com.apple.disk-image"), format_name(image), F.coalesce(dos, format_name(system)), last)


def image_type(extension: Column) -> Column:
    """struct(type, content_type) by extension alone."""
    found = lookup(extension, IMAGE_TYPES)
    return F.struct(F.when(found.isNotNull(), "disk-image").otherwise("file").alias("type"), found.alias("content_type"))


def detect_type(extension: Column, content: Column) -> Column:
    """struct(type, content_type): the extension leads, an ISO descriptor at sector 16 decides for ``img``."""
    descriptor = (F.length(content) > 32768) & ((F.substring(content, 32769, 1) == F.lit(b"\1")) | (F.substring(content, 32770, 5) == F.lit(b"CD001")))
    found = F.when((extension == "img") & descriptor, IMAGE_TYPES["iso"]).when(extension.isin("dmg", "iso", "img", "vhd"), lookup(extension, IMAGE_TYPES))
    return F.struct(F.when(found.isNotNull(), "disk-image").otherwise("file").alias("type"), found.alias("content_type"))


def type_group(extension: Column) -> Column:
    table: dict[str, str] = {}
    for group, extensions in TYPE_GROUPS.items():
        for e in extensions:
            table.setdefault(e, group)
    return lookup(F.lower(extension), table, "unknown")


def category_group(category: Column) -> Column:
    return lookup(F.lower(category), CATEGORY_GROUPS, "unknown")


def codec(extension: Column) -> Column:
    return lookup(F.trim(F.lower(extension), F.lit(".")), CODEC_EXTENSIONS)


def permissions(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(0o7777).cast("string"), 10, 8), 4, "0")


def parse_octal(text: Column) -> Column:
    return F.when(text.rlike("^[0-7]+$"), F.conv(text, 8, 10).cast("int"))


def device_kind(mode: Column) -> Column:
    return lookup(mode.bitwiseAND(0o170000), DEVICE_KINDS)


def address(*lines: Column) -> Column:
    """Street lines, then city, state and zip joined by commas; empty parts are left out."""
    *head, city, state, code = (F.nullif(F.trim(x), F.lit("")) for x in lines)
    return F.concat_ws("\n", *head, F.nullif(F.concat_ws(", ", city, state, code), F.lit("")))


def version_or(text: Column, default: str) -> Column:
    """The version, or the default where the text is none."""
    return F.coalesce(version(text), version(F.lit(default)))


def type_version(text: Column) -> Column:
    """struct(major, minor, patch) of ``x.y`` or ``x.y.z``, null of anything else; structs of three numbers compare in order."""
    part = lambda k: F.regexp_extract(text, r"^([0-9]+)\.([0-9]+)(?:\.([0-9]+))?$", k)
    return F.when(text.rlike(r"^[0-9]+\.[0-9]+(\.[0-9]+)?$"), F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)).alias("patch")))


def os_version_display(system: Column, text: Column) -> Column:
    """Version with the name that the system's versions go by."""
    prefix = F.when(system == "apple-dos-3.3", "DOS ").when(system == "prodos", "ProDOS ").when(system == "sos", "SOS ").when(system == "ucsd-pascal", "UCSD Pascal ").otherwise("")
    return F.concat(prefix, text)


def app_version_display(name: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(text, F.lit("")))


def file_version_display(text: Column) -> Column:
    return F.concat(F.when(text.startswith("v"), "").otherwise("v"), text)


def file_identifier(category: Column, system: Column, system_version: Column) -> Column:
    """Identifier of a file by category, file system and version; assembly counts as binary, no category as data."""
    kind = F.when(F.lower(category) == "assembly", "binary").otherwise(F.coalesce(F.nullif(F.lower(category), F.lit("")), F.lit("data")))
    last = F.when(system.isNotNull() & (F.coalesce(system_version, F.lit("")) != ""), version_name(system_version))
    return F.concat_ws(".", F.lit("com.apple.file"), kind, format_name(system), last)


def entry_identifier(name: Column, category: Column, image: Column, system: Column, system_version: Column) -> Column:
    """Identifier of an entry: of the image where it is one, else of the file; without a category its name's group decides."""
    group = type_group(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(F.when(image.isNotNull(), image_identifier(image, system, system_version)), file_identifier(F.coalesce(category, F.nullif(group, F.lit("unknown"))), system, system_version))


def zip_method(method: Column) -> Column:
    """struct(name, era) of a compression method."""
    name = lookup(method, {k: v[0] for k, v in ZIP_NAMES.items()}, "Unknown")
    return F.struct(name.alias("name"), lookup(method, {k: v[1] for k, v in ZIP_NAMES.items() if v[1]}).alias("era"))


def zip_metadata(content: Column) -> Column:
    """struct(version_needed, method, name, era) of content that begins with a local file header, or null."""
    from stowage.functions import binary

    method = binary.unsigned(content, 8, 2, little=True)
    found = zip_method(method)
    return F.when((F.length(content) >= 30) & (F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")), F.struct(binary.unsigned(content, 4, 1).alias("version_needed"), method.alias("method"), found["name"].alias("name"), found["era"].alias("era")))
