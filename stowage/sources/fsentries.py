"""Python data source ``fsentries``: a recursive listing with directories, links, special files and empty files.

One partition for each entry right under the root, or a level deeper where these are few, so large trees are listed in parallel.
Options: path (the root), hidden, special, followlinks, followfolders, insideonly, contents, erroronbrokenlinks, skippermissionerrors
(all ``true``/``false``). Hidden entries are skipped unless asked for. A followed link to a file is listed with the file's facts under the
link's path; one to a folder is left out, or with followfolders walked there unless the walk is inside it already. With insideonly, links
to targets outside the root are left out when followed. Broken links are listed as links, or raise if asked to. What may not be read
raises, or is left out if asked to; what vanishes during the walk is left out.
"""

from __future__ import annotations

import grp
import os
import pwd
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, kind string, size long, mode int, owner string, grp string, created timestamp, modified timestamp, target string, content binary"
_KINDS = ((stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "symlink"), (stat.S_ISBLK, "block-device"), (stat.S_ISCHR, "character-device"), (stat.S_ISSOCK, "socket"), (stat.S_ISFIFO, "fifo"))


def kind_of(mode: int) -> str:
    return next((k for test, k in _KINDS if test(mode)), "unknown")


def _name(look_up, number: int) -> str:
    try:
        return look_up(number)[0]
    except KeyError:
        return str(number)


FEW = 16  # entries right under the root, below which partitions are made a level deeper


class Subtree(InputPartition):
    def __init__(self, name: str, deep: bool = True) -> None:
        self.name, self.deep = name, deep


class FsEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fsentries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FsReader(dict(self.options))


class FsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        asked = lambda key: options.get(key, "false").lower() == "true"
        self.root = os.path.realpath(options["path"])
        self.hidden, self.special, self.follow, self.contents = asked("hidden"), asked("special"), asked("followlinks"), asked("contents")
        self.folders, self.inside = asked("followfolders"), asked("insideonly")
        self.strict, self.lenient = asked("erroronbrokenlinks"), asked("skippermissionerrors")

    def _names(self, folder: str) -> list[str]:
        try:
            return [n for n in sorted(os.listdir(folder)) if self.hidden or not n.startswith(".")]
        except FileNotFoundError:
            return []
        except PermissionError:
            if self.lenient:
                return []
            raise

    def partitions(self) -> list[InputPartition]:
        names = self._names(self.root)
        if len(names) < FEW:  # the folders themselves, and each entry in them
            inner = [f"{n}/{m}" for n in names if os.path.isdir(os.path.join(self.root, n)) and not os.path.islink(os.path.join(self.root, n)) for m in self._names(os.path.join(self.root, n))]
            return [Subtree(n, deep=False) for n in names] + [Subtree(n) for n in inner] or [Subtree("")]
        return [Subtree(n) for n in names]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if partition.name:
            yield from self._walk(partition.name, frozenset(), partition.deep)

    def _walk(self, path: str, above: frozenset, deep: bool = True) -> Iterator[tuple]:
        full = os.path.join(self.root, path)
        try:
            facts, target = os.lstat(full), None
            if stat.S_ISLNK(facts.st_mode):
                target = os.readlink(full)
                if not os.path.exists(full):
                    if self.strict:
                        raise ValueError(f"broken link: {path}")
                elif self.follow:
                    real = os.path.realpath(full)
                    if real in above or f"{os.path.realpath(os.path.dirname(full))}/".startswith(f"{real}/"):
                        return  # the walk is inside it
                    if (os.path.isdir(real) and not self.folders) or (self.inside and os.path.commonpath([real, self.root]) != self.root):
                        return
                    facts, target, deep = os.stat(full), None, True
                    above = above | {real}
        except FileNotFoundError:
            return
        except PermissionError:
            if self.lenient:
                return
            raise
        kind = kind_of(facts.st_mode)
        if kind not in ("directory", "file", "symlink") and not self.special:
            return
        when = lambda s: datetime.fromtimestamp(s, timezone.utc)
        content = None
        if self.contents and kind == "file":
            try:
                with open(full, "rb") as f:
                    content = f.read()
            except PermissionError:
                if not self.lenient:
                    raise
        yield (path, os.path.basename(path), kind, facts.st_size, facts.st_mode & 0o177777, _name(pwd.getpwuid, facts.st_uid), _name(grp.getgrgid, facts.st_gid), when(facts.st_ctime), when(facts.st_mtime), target, content)
        if kind == "directory" and deep:
            for name in self._names(full):
                yield from self._walk(f"{path}/{name}", above)


def register(spark) -> None:
    spark.dataSource.register(FsEntries)
