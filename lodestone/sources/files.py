"""A directory tree as a table, in batch and as a stream of changes.

Spark's own file source hides names that begin with `_` or `.`, so `__init__.py` would be
missing; this Python data source lists the tree itself.  Oversized files are never read.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MOST_BYTES = 5 * 1024 * 1024
PROBE = 8192
FILES = "file_id long, rel string, path string, mtime_ns long, len long, content string"
CHANGES = "rel string, path string, ts timestamp, deleted boolean"


class Rules:
    """The patterns of one ignore file, relative to its folder."""

    def __init__(self, folder: str, text: str):
        self.folder, self.patterns = folder, []
        for raw in text.splitlines():
            line = raw.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.patterns.append((keep, only_dirs, re.compile(_glob(line.lstrip("/"), anchored))))

    def ignores(self, rel: str, is_dir: bool) -> bool | None:
        """True or False by the last pattern that matches, None if none does."""
        out = None
        inner = rel[len(self.folder) :].lstrip("/") if self.folder else rel
        for keep, only_dirs, pattern in self.patterns:
            if (is_dir or not only_dirs) and pattern.fullmatch(inner):
                out = not keep
        return out


def _glob(pattern: str, anchored: bool) -> str:
    out = "" if anchored else "(?:.*/)?"
    k = 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif pattern[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif pattern[k] == "?":
            out, k = out + "[^/]", k + 1
        elif pattern[k] == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out, k = out + re.sub(r"^\(\?s:|\)\\[Zz]$", "", fnmatch.translate(pattern[k : end + 1])), end + 1
        else:
            out, k = out + re.escape(pattern[k]), k + 1
    return out


def excludes_file(home: str | None = None, config: str | None = None) -> str:
    """The user's own ignore file: core.excludesFile of the git configuration, or the
    place it has by default."""
    home = os.path.expanduser("~") if home is None else home
    config = config or os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for path in (os.path.join(home, ".gitconfig"), os.path.join(config, "git", "config")):
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                section = re.search(r"(?ims)^\s*\[core\]([^\[]*)", f.read())
        except OSError:
            continue
        found = re.search(r"(?im)^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", section[1]) if section else None
        if found:
            return os.path.join(home, found[1][2:]) if found[1].startswith("~/") else found[1]
    return os.path.join(config, "git", "ignore")


class Ignores:
    """Which paths of a tree are left out: hidden ones, those that ignore files name (only
    inside a repository), and those under given prefixes (an engine's own files).

    Ignore files are the user's own, the repository's info/exclude, and the .gitignore of
    each folder from the repository's root down, which may lie above the tree."""

    def __init__(self, root: str, own: tuple[str, ...] = (), excludes: str | None = None):
        self.root = os.path.abspath(root)
        self.own = tuple(os.path.abspath(p) for p in own)
        self.base = next((d for d in self._upward(self.root) if os.path.exists(os.path.join(d, ".git"))), None)
        self.cache: dict[str, Rules | None] = {}
        self.common: list[Rules] = []
        if self.base is not None:
            above = os.path.relpath(self.root, self.base).replace(os.sep, "/")
            self.above = [] if above == "." else above.split("/")
            for path in (excludes or excludes_file(), os.path.join(self.base, ".git", "info", "exclude")):
                rules = self._read(path, "")
                self.common += [rules] if rules else []

    @staticmethod
    def _upward(folder: str) -> Iterator[str]:
        while True:
            yield folder
            if os.path.dirname(folder) == folder:
                return
            folder = os.path.dirname(folder)

    @staticmethod
    def _read(path: str, folder: str) -> Rules | None:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return Rules(folder, f.read())
        except OSError:
            return None

    def rules(self, folder: str) -> Rules | None:
        """Those of a folder, given from the repository's root."""
        if folder not in self.cache:
            self.cache[folder] = self._read(os.path.join(self.base, folder, ".gitignore"), folder)
        return self.cache[folder]

    def ignored(self, rel: str, is_dir: bool = False) -> bool:
        """Whether a path or one of its parents in the tree is left out."""
        full = os.path.join(self.root, rel)
        if any(full == p or full.startswith(p + os.sep) for p in self.own):
            return True
        parts = rel.split("/")
        if any(p.startswith(".") for p in parts):
            return True
        if self.base is None:
            return False
        parts = [*self.above, *parts]
        for k in range(len(self.above) + 1, len(parts) + 1):
            sub, as_dir = "/".join(parts[:k]), is_dir or k < len(parts)
            for r in (*self.common, *(self.rules("/".join(parts[:j])) for j in range(k))):
                if r and r.ignores(sub, as_dir):
                    return True
        return False


def listing(root: str, own: tuple[str, ...] = (), only: list[str] | None = None) -> list[tuple[str, int, int]]:
    """(rel, mtime_ns, bytes) of the files of a tree, sorted; links aren't followed.  Of
    the paths in `only`, if given, without a walk."""
    ignores, out = Ignores(root, own), []
    if only is not None:
        for rel in sorted(set(only)):
            full = os.path.join(root, rel)
            if os.path.isfile(full) and not os.path.islink(full) and not ignores.ignored(rel):
                s = os.stat(full)
                out.append((rel, s.st_mtime_ns, s.st_size))
        return out
    for folder, dirs, names in os.walk(root):
        base = os.path.relpath(folder, root)
        base = "" if base == "." else base.replace(os.sep, "/") + "/"
        dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(folder, d)) and not ignores.ignored(base + d, True))
        for n in names:
            full = os.path.join(folder, n)
            if os.path.islink(full) or not os.path.isfile(full) or ignores.ignored(base + n):
                continue
            s = os.stat(full)
            out.append((base + n, s.st_mtime_ns, s.st_size))
    return sorted(out)


ID_BITS = 39


def file_id(rel: str) -> int:
    """A stable number of a path, small enough to be shifted by 24 bits."""
    return int.from_bytes(hashlib.blake2b(rel.encode(), digest_size=5).digest(), "big") >> (40 - ID_BITS)


def file_ids(rels: list[str]) -> dict[str, int]:
    """Numbers of a tree's paths, all different: where two would be the same, which is
    likely from a million files on, the later path takes the next one that is free."""
    out, used = {}, set()
    for rel in sorted(rels):
        k = file_id(rel)
        while k in used:
            k = (k + 1) % (1 << ID_BITS)
        used.add(k)
        out[rel] = k
    return out


def decode(data: bytes) -> str | None:
    """Text with bad bytes replaced; null for binary data (a NUL near the start)."""
    return None if b"\x00" in data[:PROBE] else data.decode("utf-8", "replace")


class _Slice(InputPartition):
    def __init__(self, rows: list[tuple[int, str, int, int]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.own = tuple(json.loads(options.get("own", "[]")))
        self.only = json.loads(options["only"]) if "only" in options else None
        self.tasks = int(options.get("tasks", "8"))
        self.most = int(options.get("mostbytes", options.get("mostBytes", str(MOST_BYTES))))

    def partitions(self) -> list[InputPartition]:
        found = listing(self.root, self.own, self.only)
        ids = file_ids([r[0] for r in found])
        rows = [(ids[r[0]], *r) for r in found if r[2] <= self.most]
        n = max(1, min(self.tasks, len(rows)))
        bins: list[list] = [[] for _ in range(n)]
        load = [0] * n
        for r in sorted(rows, key=lambda r: -r[3]):
            k = load.index(min(load))
            bins[k].append(r)
            load[k] += r[3] + 4096
        return [_Slice(b) for b in bins]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for number, rel, mtime, size in partition.rows:
            full = os.path.join(self.root, rel)
            try:
                with open(full, "rb") as f:
                    text = decode(f.read())
            except OSError:
                continue
            if text is not None:
                yield number, rel, full, mtime, size, text


class _Changes(SimpleDataSourceStreamReader):
    """Edits and deletions since the last look; an offset is the listing it has seen."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.own = tuple(json.loads(options.get("own", "[]")))

    def initialOffset(self) -> dict:
        return {"seen": json.dumps({})}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        import datetime

        before = json.loads(start["seen"])
        now = {rel: [mtime, size] for rel, mtime, size in listing(self.root, self.own)}
        at = datetime.datetime.fromtimestamp(time.time(), datetime.timezone.utc)
        rows = [(rel, os.path.join(self.root, rel), at, False) for rel, v in now.items() if before.get(rel) != v]
        rows += [(rel, os.path.join(self.root, rel), at, True) for rel in before if rel not in now]
        return iter(rows), {"seen": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        import datetime

        before, now = json.loads(start["seen"]), json.loads(end["seen"])
        at = datetime.datetime.fromtimestamp(time.time(), datetime.timezone.utc)
        changed = [(rel, os.path.join(self.root, rel), at, False) for rel, v in now.items() if before.get(rel) != v]
        return iter(changed + [(rel, os.path.join(self.root, rel), at, True) for rel in before if rel not in now])


class FileTree(DataSource):
    """format("file_tree"): options path, own (JSON list of paths left out), only (JSON list
    of relative paths, instead of the whole tree), tasks, mostBytes."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return CHANGES if self.options.get("changes") == "true" else FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
