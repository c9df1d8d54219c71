"""Data sources of working trees: ``spark.read.format("tree_files").option("paths", "a,name=b")``.

One row per file in the order of a sorted walk: repo (as in the sources of git), path, size,
mtime, content, blob.  Symbolic links are never followed; ``.git`` and what the root's ignore
files name are left out.  One partition per tree, split by top directory.  ``content`` is read
only if the option "content" is "true", and only up to "maxBytes" (null beyond: see size);
``blob``, git's id of the content, only if "blob" is "true", for files of any size.
``tree_dirs`` has the directories, empty ones too: repo, path.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .git import named_roots
from .ignore import IgnoreMatcher

SCHEMA = "repo string, path string, size long, mtime long, content binary, blob string"
IGNORE_FILES = (".gitignore", ".treeignore")


def matcher(root: str, extra: list[str] = ()) -> IgnoreMatcher:
    lines: list[str] = []
    for name in IGNORE_FILES:
        if os.path.isfile(p := os.path.join(root, name)):
            with open(p, encoding="utf-8", errors="replace") as f:
                lines += f.read().split("\n")
    return IgnoreMatcher([*lines, *extra])


def walk(root: str, ignore: IgnoreMatcher, below: str = "") -> Iterator[str]:
    """Relative paths of the files, names sorted in each directory."""
    for e in sorted(os.scandir(os.path.join(root, below) if below else root), key=lambda e: e.name):
        rel = f"{below}/{e.name}" if below else e.name
        if e.is_symlink() or ignore.ignored(rel, e.is_dir()):
            continue
        if e.is_dir():
            yield from walk(root, ignore, rel)
        elif e.is_file():
            yield rel


def directories(root: str, ignore: IgnoreMatcher, below: str = "") -> Iterator[str]:
    """Relative paths of the directories."""
    for e in sorted(os.scandir(os.path.join(root, below) if below else root), key=lambda e: e.name):
        rel = f"{below}/{e.name}" if below else e.name
        if not e.is_symlink() and e.is_dir() and rel != ".git" and not ignore.ignored(rel, True):
            yield rel
            yield from directories(root, ignore, rel)


def blob_id(path: str, size: int) -> str:
    """Git's id of a file, read in pieces."""
    h = hashlib.sha1(b"blob %d\0" % size)
    with open(path, "rb") as f:
        while piece := f.read(1 << 16):
            h.update(piece)
    return h.hexdigest()


class _Part(InputPartition):
    def __init__(self, key: str, root: str, name: str):
        self.key, self.root, self.name = key, root, name


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = named_roots(options.get("paths", ""))
        self.content, self.blob = options.get("content") == "true", options.get("blob") == "true"
        self.most = int(options.get("maxBytes", 1_000_000))
        self.extra = [p for p in options.get("exclude", "").split(",") if p]

    def partitions(self):
        return [_Part(key, root, name) for key, root in self.roots for name in sorted(os.listdir(root)) if name != ".git"]

    def read(self, part):
        ignore = matcher(part.root, self.extra)
        full = os.path.join(part.root, part.name)
        if os.path.islink(full) or ignore.ignored(part.name, os.path.isdir(full)):
            return
        for rel in walk(part.root, ignore, part.name) if os.path.isdir(full) else [part.name]:
            at = os.path.join(part.root, rel)
            st = os.stat(at)
            data = None
            if self.content and st.st_size <= self.most:
                with open(at, "rb") as f:
                    data = f.read()
            yield part.key, rel, st.st_size, st.st_mtime_ns, data, blob_id(at, st.st_size) if self.blob else None


class DirReader(TreeReader):
    def partitions(self):
        return [_Part(key, root, "") for key, root in self.roots]

    def read(self, part):
        for rel in directories(part.root, matcher(part.root, self.extra)):
            yield part.key, rel


class TreeFiles(DataSource):
    @classmethod
    def name(cls):
        return "tree_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


class TreeDirs(TreeFiles):
    @classmethod
    def name(cls):
        return "tree_dirs"

    def schema(self):
        return "repo string, path string"

    def reader(self, schema):
        return DirReader(self.options)
