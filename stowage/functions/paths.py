"""Path expressions: normal form, parts, hidden and system names, ignore patterns, storage layout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage.dims import SYSTEM_PARTS


def normalize(path: Column) -> Column:
    r"""``\`` to ``/``, ``//`` to ``/`` in one pass, outer slashes off, a leading one kept."""
    clean = F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("//"), F.lit("/"))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.trim(clean, F.lit("/")))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    items = F.split(path, "/")
    return F.array_join(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"\.([^.]+)$", 1))


def normalize_extension(text: Column) -> Column:
    return F.trim(F.lower(text), F.lit("."))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith(".") & ~x.isin(".", ".."))


def is_system(path: Column) -> Column:
    found = F.lit(False)
    for part in SYSTEM_PARTS:
        found = found | F.contains(path, F.lit(part))
    return found


def should_embed(path: Column, kind: Column, embed_system: bool) -> Column:
    return F.lit(embed_system) & (kind.isin("block-device", "character-device", "socket", "fifo") | is_hidden(path) | is_system(path))


def _pattern(path: Column, pattern: str) -> Column:
    if pattern.endswith("/"):
        own = pattern[:-1]
        return path.startswith(f"{own}/") | (path == own) | F.array_contains(F.split(path, "/"), own)
    if "*" in pattern or "?" in pattern:
        expression = pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".")
        try:
            re.compile(expression)
        except re.error:
            return F.lit(False)
        return path.rlike(expression)
    return (path == pattern) | path.endswith(f"/{pattern}")


def matches_pattern(path: Column, pattern: str) -> Column:
    return _pattern(F.replace(path, F.lit("\\"), F.lit("/")), pattern)


def ignored(path: Column, patterns) -> Column:
    """Ordered patterns, the first that matches decides; ``!`` keeps; the default keeps."""
    found = F.lit(False)
    for pattern in reversed([p.strip() for p in patterns if p.strip() and not p.strip().startswith("#")]):
        keep = pattern.startswith("!")
        found = F.when(matches_pattern(path, pattern.removeprefix("!")), F.lit(not keep)).otherwise(found)
    return found


def storage_path(hashed: Column, depth: int = 2) -> Column:
    """Two characters a level, then the hash; short hashes lie flat."""
    depth = min(4, max(1, depth))
    levels = [F.substring(hashed, 2 * k + 1, 2) for k in range(depth)]
    return F.when(F.length(hashed) < 2 * depth, hashed).otherwise(F.concat_ws("/", *levels, hashed))


def path_identifier(path: Column) -> Column:
    """The hash that a storage path names, or null."""
    last = name(path)
    return F.when(last.rlike("^[0-9a-fA-F]{32,}$"), last)


def resolve(base: Column, path: Column) -> Column:
    """Absolute components of ``path`` seen from ``base``, with ``.`` and ``..`` resolved."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))

    def step(acc, part):
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All proper ancestor folders of a relative path, the root as ''."""
    items = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda n: F.array_join(F.slice(items, F.lit(1), n), "/"))


def relative(path: Column, base: Column, prefix: str = "") -> Column:
    """``path`` seen from the folder ``base``, below ``prefix``; null outside it. Compared part by part."""
    whole, root = parts(normalize(path)), parts(normalize(base))
    inside = F.slice(whole, F.lit(1), F.size(root)) == root
    rest = F.array_join(F.slice(whole, F.size(root) + 1, F.size(whole)), "/")
    return F.when(inside, F.concat_ws("/", F.nullif(F.lit(prefix), F.lit("")), F.nullif(rest, F.lit(""))))


def ignored_below(path: Column, base: Column, patterns) -> Column:
    """Whether the path, seen from ``base``, is ignored; paths outside are judged as they are."""
    return ignored(F.coalesce(relative(path, base), path), patterns)
