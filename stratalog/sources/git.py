"""Data sources of git repositories: the log, file events, blobs, refs, blame, names and contents.

``spark.read.format("git_commits").option("paths", "/a,work=/b").option("ref", "A..B").load()``.
A repository's key (the column repo) is the name before "=", or else its absolute path, so equal
folder names never meet.  One partition per repository (of blame and contents, per repository and
some of the paths); git's output is read as a stream.  Options ``ref``, ``maxCount``, ``path``,
``follow`` (over renames), ``needle`` (occurrence count changes) and ``pattern`` (a hunk matches)
are pushed down to git.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_END, _SEP = "\x1e", "\x1f"


def git(root: str, *args: str) -> Iterator[str]:
    """The lines of a git command's output; raises with git's message if it fails."""
    env = os.environ | {"GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    # messages go to a file, so that a command with many of them doesn't wait for a reader
    with tempfile.TemporaryFile() as said, subprocess.Popen(
            ["git", "-c", "core.quotepath=off", "-C", root, *args], stdout=subprocess.PIPE, stderr=said, env=env) as p:
        for line in p.stdout:  # bytes, so that only line feeds end a line
            yield line.removesuffix(b"\n").decode("utf-8", "replace")
        if p.wait():
            said.seek(0)
            raise RuntimeError(f"git {args[0]} in {root}: {said.read().decode('utf-8', 'replace').strip()}")


def _word(root: str, *args: str) -> str | None:
    """The first line of a command's output; None if it fails or says nothing."""
    try:
        return next(iter(list(git(root, *args))), "") or None
    except RuntimeError:
        return None


def version() -> str | None:
    try:
        return _word(".", "--version")
    except FileNotFoundError:
        return None


def is_repo(root: str) -> bool:
    return os.path.isdir(root) and _word(root, "rev-parse", "--git-dir") is not None


def head_sha(root: str) -> str | None:
    return _word(root, "rev-parse", "--verify", "-q", "HEAD")


def current_branch(root: str) -> str | None:
    """None where no branch is checked out."""
    return _word(root, "symbolic-ref", "--short", "-q", "HEAD")


def is_shallow(root: str) -> bool:
    return _word(root, "rev-parse", "--is-shallow-repository") == "true"


def _ref(o: dict, default: str = "HEAD") -> str:
    ref = o.get("ref", default)
    if ref.startswith("-") and ref != default:
        raise ValueError(f"not a ref: {ref!r}")
    return ref


def _log_args(o: dict) -> list[str]:
    follow = o.get("follow") == "true" and o.get("path")
    args = ["--follow"] if follow else ["--no-renames"]
    if o.get("maxcount"):
        args.append(f"--max-count={int(o['maxcount'])}")
    if o.get("needle"):
        args.append(f"-S{o['needle']}")
    if o.get("pattern"):
        args.append(f"-G{o['pattern']}")
    args.append(_ref(o))
    if o.get("path"):
        args += ["--", o["path"]]
    return args


def read_commits(root: str, o: dict) -> Iterator[tuple]:
    fields = _SEP.join(["%H", "%an", "%ae", "%at", "%aI", "%s", "%b"])
    commit, files, seq = None, [], 0
    body: list[str] = []
    state = ""
    for line in git(root, "log", "--numstat", f"--format={_END}{fields}{_SEP}{_END}", *_log_args(o)):
        if state != "body" and line.startswith(_END):
            if commit:
                yield (*commit, seq, files)
                seq += 1
            body, files, state, line = [], [], "body", line[1:]
        if state == "body":
            body.append(line)
            if line.endswith(_SEP + _END):
                sha, name, mail, time, date, subject, text = "\n".join(body)[: -len(_SEP + _END)].split(_SEP, 6)
                commit, state = (sha, name, mail, int(time), date, subject, text.strip("\n")), "files"
        elif line.count("\t") >= 2:
            a, d, path = line.split("\t", 2)
            files.append((path, None if a == "-" else int(a), None if d == "-" else int(d)))
    if commit:
        yield (*commit, seq, files)


def read_events(root: str, o: dict) -> Iterator[tuple]:
    sha = date = author = ""
    seq = 0
    for line in git(root, "log", "--name-status", f"--format={_END}%H{_SEP}%aI{_SEP}%an", *_log_args(o)):
        if line.startswith(_END):
            sha, date, author = line[1:].split(_SEP)
        elif "\t" in line:
            status, path = line.split("\t", 1)
            yield path, status[0], sha, date, author, seq
            seq += 1


def _objects(root: str, names: Iterator[str], content: bool) -> Iterator[tuple[str, str, int, bytes | None]]:
    """(name, kind, size, content) of objects, by one git process; a missing one has size -1."""
    with subprocess.Popen(["git", "-C", root, "cat-file", "--batch" if content else "--batch-check"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for name in names:
            p.stdin.write(f"{name}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().rsplit(None, 2)
            if len(head) < 3 or not head[2].isdigit():
                yield name, "missing", -1, None
                continue
            size = int(head[2])
            yield name, head[1].decode(), size, p.stdout.read(size + 1)[:-1] if content else None
        p.stdin.close()


def read_blobs(root: str, o: dict) -> Iterator[tuple]:
    """Reachable blobs with one path and, with option content, their bytes up to maxBytes (null beyond, see size)."""
    first: dict[str, str] = {}
    for line in git(root, "rev-list", "--objects", _ref(o, "--all")):
        sha, _, path = line.partition(" ")
        if path:
            first.setdefault(sha, path)
    most = int(o.get("maxbytes", 1_000_000))
    sized = ((sha, size) for sha, kind, size, _ in _objects(root, sorted(first), False) if kind == "blob")
    if o.get("content") != "true":
        yield from ((sha, first[sha], size, None) for sha, size in sized)
        return
    known = list(sized)  # one row each of a repository's blobs, as first is
    bodies = _objects(root, (sha for sha, size in known if size <= most), True)
    for sha, size in known:
        yield sha, first[sha], size, next(bodies)[3] if size <= most else None


def read_blob_commits(root: str, o: dict) -> Iterator[tuple]:
    """(path, blob, sha, author_name, author_date, seq): which commit gave a path which blob, newest first."""
    commit, seq = None, -1
    for line in git(root, "log", "--raw", "--no-abbrev", "--no-renames", "-m", f"--format={_END}%H{_SEP}%an{_SEP}%aI", _ref(o, "--all")):
        if line.startswith(_END):
            commit, seq = line[1:].split(_SEP), seq + 1
        elif line.startswith(":"):
            (*_, new, status), path = line.split("\t")[0].split(), line.split("\t", 1)[1]
            if status[0] != "D":
                yield path, new, *commit, seq


def read_refs(root: str, o: dict) -> Iterator[tuple]:
    merged = {x.strip() for x in git(root, "for-each-ref", "--merged=HEAD", "--format=%(refname)", "refs/heads")}
    form = "%(refname)%1f%(objectname)%1f%(*objectname)%1f%(committerdate:unix)%1f%(authorname)%1f%(upstream:track)%1f%(*committerdate:unix)"
    for line in git(root, "for-each-ref", f"--format={form}", "refs/heads", "refs/tags"):
        ref, sha, peeled, time, author, track, tag_time = line.split("\x1f")
        kind = "branch" if ref.startswith("refs/heads/") else "tag"
        yield ref.split("/", 2)[2], kind, peeled or sha, int(time or tag_time or 0), author, ref in merged, "gone" in track


def read_blame(root: str, o: dict, paths: list[str]) -> Iterator[tuple]:
    """(path, line, author, author_time) of the lines of each path; a path that is no file at the ref has none."""
    for path in paths:
        author, time, line = "", 0, 0
        if _word(root, "cat-file", "-t", f"{_ref(o)}:{path}") != "blob":
            continue
        for x in git(root, "blame", "--line-porcelain", _ref(o), "--", path):
            if x.startswith("author "):
                author = x[7:]
            elif x.startswith("author-time "):
                time = int(x[12:])
            elif x.startswith("\t"):
                line += 1
                yield path, line, author, time


def read_names(root: str, o: dict, paths: list[str]) -> Iterator[tuple]:
    """(path, name, place): the names that each path had before, the newest first."""
    yield from ((path, name, k) for path in paths for k, name in enumerate(former_names(root, path)))


def read_contents(root: str, o: dict, paths: list[str]) -> Iterator[tuple]:
    """(path, content) of each path at the ref, null where it has none; one git process for all."""
    wanted = (f"{_ref(o)}:{path}" for path in paths)
    for path, (_, kind, _, content) in zip(paths, _objects(root, wanted, True)):
        yield path, content if kind == "blob" else None


def show_file(root: str, rev: str, path: str) -> bytes | None:
    """The bytes of a path at a revision, or None."""
    if rev.startswith("-"):
        raise ValueError(f"not a revision: {rev!r}")
    p = subprocess.run(["git", "-C", root, "cat-file", "blob", f"{rev}:{path}"], capture_output=True)
    return p.stdout if p.returncode == 0 else None


def former_names(root: str, path: str) -> list[str]:
    """Names that a path had before, newest first."""
    names: list[str] = []
    for line in git(root, "log", "--follow", "--name-status", "--format=", "--", path):
        parts = line.split("\t")
        if parts[0].startswith("R") and parts[1] not in names and parts[1] != path:
            names.append(parts[1])
    return names


def restore_deleted(root: str, path: str) -> bytes:
    """The content of a path before its newest deletion."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"unsafe path: {path!r}")
    dead = next((e for e in read_events(root, {"path": path}) if e[1] == "D"), None)
    found = show_file(root, f"{dead[2]}~1", path) if dead else None
    if found is None:
        raise FileNotFoundError(path)
    return found


class _Repo(InputPartition):
    def __init__(self, key: str, root: str, paths: list[str] | None = None):
        self.key, self.root, self.paths = key, root, paths


def named_roots(option: str) -> list[tuple[str, str]]:
    """(key, folder) of each entry, "folder" or "name=folder"."""
    out = []
    for entry in filter(None, option.split(",")):
        name, eq, root = entry.partition("=")
        named = eq and "/" not in name
        out.append((name, root) if named else (os.path.abspath(entry), entry))
    if len({k for k, _ in out}) < len(out):
        raise ValueError("two repositories have one name")
    return out


#: Paths that one partition of blame, names or contents works on.
AT_ONCE = 64


def _source(label: str, columns: str, rows, by_path: bool = False):
    """``by_path``: rows of the paths in option path (or paths_list, one a line), some in each partition."""
    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = {k.lower(): v for k, v in options.items()}

        def partitions(self):
            roots = named_roots(self.options.get("paths", ""))
            if not by_path:
                return [_Repo(k, r) for k, r in roots]
            wanted = [p for p in self.options.get("paths_list", self.options.get("path", "")).split("\n") if p]
            return [_Repo(k, r, wanted[i : i + AT_ONCE]) for k, r in roots for i in range(0, len(wanted), AT_ONCE)]

        def read(self, part):
            found = rows(part.root, self.options, part.paths) if by_path else rows(part.root, self.options)
            for row in found:
                yield (part.key, *row)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return f"repo string, {columns}"

        def reader(self, schema):
            return Reader(self.options)

    return Source


GitCommits = _source("git_commits", "sha string, author_name string, author_email string, author_time long, author_date string, subject string, body string, "
                     "seq long, files array<struct<path:string,insertions:long,deletions:long>>", read_commits)
GitFileEvents = _source("git_file_events", "path string, status string, sha string, date string, author string, seq long", read_events)
GitBlobs = _source("git_blobs", "sha string, path string, size long, content binary", read_blobs)
GitRefs = _source("git_refs", "name string, kind string, sha string, last_time long, author string, merged boolean, gone_upstream boolean", read_refs)
GitBlobCommits = _source("git_blob_commits", "path string, blob string, sha string, author_name string, author_date string, seq long", read_blob_commits)
GitBlame = _source("git_blame", "path string, line long, author string, author_time long", read_blame, True)
GitNames = _source("git_names", "path string, name string, place long", read_names, True)
GitContents = _source("git_contents", "path string, content binary", read_contents, True)


def register(spark) -> None:
    """Makes all data sources known to a session."""
    from .fs import TreeDirs, TreeFiles

    for s in (GitCommits, GitFileEvents, GitBlobs, GitBlobCommits, GitRefs, GitBlame, GitNames, GitContents, TreeFiles, TreeDirs):
        spark.dataSource.register(s)


def file_changes(commits):
    """The changes of a commits table, one row for each path."""
    keep = ["repo", "sha", "seq", "author_name", "author_email", "author_time", "author_date", "subject"]
    from pyspark.sql import functions as F

    return commits.select(*keep, F.explode("files").alias("f")).select(*keep, "f.path", "f.insertions", "f.deletions")
