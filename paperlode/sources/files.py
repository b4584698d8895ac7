"""Folders of PDF files as a batch source and as a stream of changes.

Registered with ``spark.dataSource.register``. The listing is made by walking the folder, so hidden files count,
which Spark's own file sources leave out; ``.gitignore`` files may be heeded, and links followed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

FILES = "path string, size_bytes bigint, mtime_ns bigint, dev bigint, ino bigint"
EVENTS = "path string, kind string, size_bytes bigint, mtime_ns bigint, dev bigint, ino bigint"


def is_pdf(path: str) -> bool:
    """A name with the suffix ``.pdf`` in any case; ``.pdf`` alone has no suffix."""
    stem, dot, suffix = os.path.basename(path).rpartition(".")
    return bool(stem and dot) and suffix.lower() == "pdf"


def identity(path: str) -> tuple[str, int, int, int, int] | None:
    """(path, size, time in ns, device, inode) of a regular file; None for anything else."""
    try:
        s = os.stat(path)
    except OSError:
        return None
    return (path, s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino) if os.path.isfile(path) else None


def scan_one(path: str) -> tuple[str, int, int, int, int] | None:
    """Identity of one PDF file, or None."""
    return identity(path) if is_pdf(path) else None


@cache
def ignore_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern of paths below the file's folder, whether it takes back, whether it holds for folders alone) of a line of an
    ignore file; None for blank lines and comments.

    A rule with a slash before its end counts from the file's folder, any other at every depth. ``*`` and ``?`` stay within a
    name, ``**`` as a whole name stands for any number of folders.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line[1:] if back else line
    folders = body.endswith("/")
    names = body.strip("/").split("/")
    if "/" not in body.rstrip("/"):
        names = ["**", *names]
    out = ""
    for i, name in enumerate(names):
        last = i == len(names) - 1
        if name == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        at = 0
        while at < len(name):
            c = name[at]
            closing = name.find("]", at + 2) if c == "[" else -1
            if c in "*?":
                out += "[^/]*" if c == "*" else "[^/]"
            elif closing > 0:
                inner = name[at + 1 : closing]
                out += "[" + ("^/" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
                at = closing
            elif c == "\\" and at + 1 < len(name):
                at += 1
                out += re.escape(name[at])
            else:
                out += re.escape(c)
            at += 1
        out += "" if last else "/"
    return re.compile(out, re.DOTALL), back, folders


def _ignored(rules: list[tuple[str, str]], path: str, folder: bool) -> bool:
    """The last rule that fits decides; rules are (folder of the file, line)."""
    for base, line in reversed(rules):
        rule = ignore_rule(line)
        if rule is None or rule[2] and not folder:
            continue
        if rule[0].fullmatch(os.path.relpath(path, base).replace(os.sep, "/")):
            return not rule[1]
    return False


def walk(root: str, respect_ignore: bool = False, follow_links: bool = False) -> Iterator[tuple[str, int, int, int, int]]:
    """Identities of all PDF files under a folder, hidden ones too. A folder that links lead to again is read once."""
    rules: dict[str, list[tuple[str, str]]] = {}
    seen: set[str] = set()
    for folder, folders, names in os.walk(root, followlinks=follow_links):
        if follow_links:
            if (real := os.path.realpath(folder)) in seen:
                folders.clear()
                continue
            seen.add(real)
        here = list(rules.get(os.path.dirname(folder), []))
        if respect_ignore and ".gitignore" in names:
            here += [(folder, x) for x in Path(folder, ".gitignore").read_text(errors="replace").splitlines()]
        rules[folder] = here
        if respect_ignore:
            folders[:] = [f for f in folders if f != ".git" and not _ignored(here, os.path.join(folder, f), True)]
        for name in names:
            path = os.path.join(folder, name)
            if not is_pdf(path) or (os.path.islink(path) and not follow_links) or (respect_ignore and _ignored(here, path, False)):
                continue
            if found := identity(path):
                yield found


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name.lower(), "false")).lower() == "true"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    """One partition for each folder directly under the root, and one for the root's own files."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        root = self.options["path"]
        if _flag(self.options, "respectIgnore"):
            return [_Folder(root, True)]  # rules of the root hold below it
        links = _flag(self.options, "followLinks")
        folders = [e.path for e in os.scandir(root) if e.is_dir(follow_symlinks=links)]
        return [_Folder(root, False), *(_Folder(f, True) for f in sorted(folders))]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if partition.deep:
            yield from walk(partition.path, _flag(self.options, "respectIgnore"), _flag(self.options, "followLinks"))
        else:
            for e in os.scandir(partition.path):
                if is_pdf(e.path) and (not e.is_symlink() or _flag(self.options, "followLinks")) and (found := identity(e.path)):
                    yield found


class _Changes(SimpleDataSourceStreamReader):
    """Each read lists the folder and gives what differs from the listing before: (dirty or removed, once a path).

    The offset names a listing kept in the state folder, so a restart goes on from what was committed.
    """

    def __init__(self, options: dict) -> None:
        self.options = options
        self.state = options["state"]
        os.makedirs(self.state, exist_ok=True)

    def _load(self, n: int) -> dict[str, list[int]]:
        path = os.path.join(self.state, f"{n}.json")
        return json.loads(Path(path).read_text()) if os.path.exists(path) else {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def _between(self, old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple]:
        dirty = [(p, "dirty", *v) for p, v in new.items() if old.get(p) != v]
        return dirty + [(p, "removed", None, None, None, None) for p in old if p not in new]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old = self._load(start["n"])
        new = {p: list(v) for p, *v in walk(self.options["path"], _flag(self.options, "respectIgnore"), _flag(self.options, "followLinks"))}
        rows = self._between(old, new)
        limit = int(self.options.get("maxevents", 0))
        if limit and len(rows) > limit:  # back-pressure: the rest differs again at the next read
            rows = rows[:limit]
            new = {**old, **{r[0]: list(r[2:]) for r in rows if r[1] == "dirty"}}
            for r in rows:
                if r[1] == "removed":
                    new.pop(r[0], None)
        if not rows:
            return iter([]), start
        end = start["n"] + 1
        part = os.path.join(self.state, f".{end}")
        Path(part).write_text(json.dumps(new))
        os.replace(part, os.path.join(self.state, f"{end}.json"))
        return iter(rows), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._between(self._load(start["n"]), self._load(end["n"])))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):
            if name.endswith(".json") and int(name[:-5]) < end["n"]:
                os.unlink(os.path.join(self.state, name))


class PdfFiles(DataSource):
    """``spark.read.format("pdf_files").load(folder)``; ``spark.readStream`` with the option ``state`` for changes."""

    @classmethod
    def name(cls) -> str:
        return "pdf_files"

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def schema(self) -> str:
        return EVENTS if "state" in self._plain() else FILES

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self._plain())

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Changes(self._plain())


def store_path(data_dir: str, root: str) -> str:
    """Where the store of a folder lies: its name, made safe, and 16 hexadecimal digits of its full path's digest."""
    full = os.path.realpath(root)
    name = re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(full)) or "root"
    return os.path.join(data_dir, "paperlode", f"{name}-{hashlib.sha256(full.encode()).hexdigest()[:16]}")
