"""Where a repository's source lies: a path in place, or a URL cloned into a cache."""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import sys
import time
from dataclasses import dataclass
from pathlib import Path

from ..registry import is_remote, name_of
from .git import is_shallow, version


@dataclass(frozen=True)
class Resolved:
    source: str
    kind: str
    path: str
    ref: str | None = None


def cache_path(source: str, cache: Path) -> Path:
    return cache / f"{name_of(source)}-{hashlib.sha256(source.encode()).hexdigest()[:12]}"


def resolve(source: str, cache: Path, ref: str | None = None, depth: int | None = 1) -> Resolved:
    """A local path as it is; a URL as a clone, made once and fetched again if that works.

    With ``depth`` None the whole history is wanted, and a clone that lacks some gets it.
    """
    if source.startswith("-") or (ref or "").startswith("-"):
        raise ValueError("a source or ref does not begin with '-'")
    if not is_remote(source):
        if not Path(source).exists():
            raise FileNotFoundError(source)
        return Resolved(source, "local", str(Path(source).resolve()), ref)
    at = cache_path(source, cache)
    shallow = [f"--depth={depth}"] if depth else []
    if at.exists():
        missing = ["--unshallow"] if depth is None and is_shallow(str(at)) else []
        subprocess.run(["git", "-C", str(at), "fetch", "-q", *shallow, *missing], capture_output=True)  # an old clone is better than none
    else:
        cache.mkdir(parents=True, exist_ok=True)
        subprocess.run(["git", "clone", "-q", *shallow, source, str(at)], check=True, capture_output=True)
    if ref:
        subprocess.run(["git", "-C", str(at), "checkout", "-q", ref], check=True, capture_output=True)
    os.utime(at)
    return Resolved(source, "remote", str(at), ref)


def purge(cache: Path, older_than: int | None = None, now: float | None = None) -> list[str]:
    """Removes clones unused for ``older_than`` seconds, or all; returns their names."""
    now = time.time() if now is None else now
    gone = []
    for p in sorted(cache.iterdir()) if cache.is_dir() else []:
        if p.is_dir() and not p.is_symlink() and (older_than is None or now - p.stat().st_mtime > older_than):
            shutil.rmtree(p)
            gone.append(p.name)
    return gone


def cached(cache: Path, now: float | None = None) -> list[tuple[str, int, int]]:
    """(name, bytes, seconds since its last use) of each clone."""
    now = time.time() if now is None else now
    return [(p.name, sum(f.stat().st_size for f in p.rglob("*") if f.is_file() and not f.is_symlink()), int(now - p.stat().st_mtime))
            for p in sorted(cache.iterdir()) if p.is_dir() and not p.is_symlink()] if cache.is_dir() else []


def doctor(cache: Path) -> list[tuple[str, bool, str]]:
    """(check, whether it holds, detail): what a run needs."""
    from importlib.metadata import PackageNotFoundError, version as package

    def found(name: str) -> str:
        try:
            return package(name)
        except PackageNotFoundError:
            return ""

    at = next(p for p in (cache, *cache.parents) if p.exists())
    git, java = version(), shutil.which("java") or os.environ.get("JAVA_HOME", "")
    return [
        ("git", git is not None, git or "no git on the path"), ("python", sys.version_info >= (3, 10), sys.version.split()[0]),
        ("java", bool(java), java or "no java on the path"), *((name, bool(found(name)), found(name) or "not installed") for name in ("pyspark", "pyarrow", "pandas")),
        ("cache", os.access(at, os.W_OK), f"{cache}: {len(cached(cache))} clones" if os.access(at, os.W_OK) else f"{cache} can't be written"),
    ]
