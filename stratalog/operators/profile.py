"""A repository's working profile: tooling, layout, hotspots with fixes, freshness stamps, and all of it composed."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import is_fix
from . import files as fs, history, outline

# Kinds of make targets and of npm scripts, files that tell a tool, steps of CI that
# set up and teach nothing, words that tell a CI command's kind (the first that occurs), folders left out.
MAKE_KINDS = {
    "build": "build", "test": "test", "tests": "test", "check": "test", "lint": "lint", "format": "format", "fmt": "format", "run": "run",
    "serve": "run", "dev": "run", "docs": "docs",
}
NPM_KINDS = {
    "build": "build", "test": "test", "lint": "lint", "format": "format", "start": "run", "dev": "run", "serve": "run", "docs": "docs",
}
TOOLING_FILES = (
    "pyproject.toml", "setup.py", "package.json", "Makefile", "Cargo.toml", "go.mod", ".pre-commit-config.yaml", "ruff.toml", ".ruff.toml",
    ".flake8", "mypy.ini", "tox.ini", "pytest.ini", ".eslintrc.json", ".eslintrc.js", ".prettierrc", "tsconfig.json", "Dockerfile",
    "docker-compose.yml", "mkdocs.yml", ".editorconfig",
)
SET_UP = ("pip install", "pipx install", "uv sync", "uv pip", "npm ci", "npm install", "yarn install", "pnpm install", "apt ", "apt-get ", "brew install", "choco install", "curl ", "wget ")
CI_WORDS = (("lint", "lint"), ("ruff", "lint"), ("eslint", "lint"), ("mypy", "lint"), ("test", "test"), ("build", "build"))
LEFT_OUT = ("node_modules", "__pycache__")

_SET_UP = re.compile(rf"(?i)\b(?:{'|'.join(map(re.escape, SET_UP))})")
Hints = Iterator[tuple[str, str]]


def hotspots_with_fixes(changes: DataFrame, limit: int = 10) -> DataFrame:
    """The most changed paths of each repo and how many of their commits were fixes."""
    n = changes.groupBy("repo", "path").agg(
        F.count("*").alias("commits"), F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).cast("long").alias("churn"),
        F.sum(is_fix(F.col("subject")).cast("long")).alias("fixes"))
    w = Window.partitionBy("repo").orderBy(F.desc("commits"), F.desc("churn"), "path")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def anonymous(owners: DataFrame, label: str = "keeper") -> DataFrame:
    """Contributors (repo, rank, name, ...) with names replaced by "keeper 1" and so on."""
    return owners.withColumn("name", F.concat(F.lit(f"{label} "), F.col("rank").cast("string"))).drop("who")


def layout(files: DataFrame) -> DataFrame:
    """Top directories with files and bytes."""
    from ..functions.scalars import top_dir

    return files.groupBy("repo", top_dir(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def top_entries(files: DataFrame) -> DataFrame:
    """repo, place, entry: what a repo's root holds, folders (with a slash) first, hidden ones left out."""
    first = F.substring_index("path", "/", 1)
    found = files.select("repo", first.alias("name"), F.contains("path", F.lit("/")).alias("is_dir")).filter(
        ~F.startswith("name", F.lit(".")) & ~F.col("name").isin(*LEFT_OUT)).distinct()
    order = Window.partitionBy("repo").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    return found.select("repo", F.row_number().over(order).cast("long").alias("place"), F.when(F.col("is_dir"), F.concat("name", F.lit("/"))).otherwise(F.col("name")).alias("entry"))


def tooling_files(files: DataFrame) -> DataFrame:
    """repo, place, path: the files in a repo's root that tell its tools."""
    places = F.create_map(*[F.lit(x) for k, name in enumerate(TOOLING_FILES) for x in (name, k)])
    return files.select("repo", places[F.col("path")].cast("long").alias("place"), "path").filter("place is not null")


def _table(data, *keys: str) -> dict:
    """A table within tables; an empty one where there is none."""
    for k in keys:
        data = data.get(k) if isinstance(data, dict) else None
    return data if isinstance(data, dict) else {}


def pyproject_hints(text: str, has_tests: bool) -> Hints:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    tools = _table(data, "tool")
    known = {"pytest": [("test", "pytest")], "ruff": [("lint", "ruff check ."), ("format", "ruff format .")], "mypy": [("lint", "mypy .")]}
    for tool, hints in known.items():
        if tool in tools or (tool == "pytest" and has_tests):
            yield from hints
    yield from (("run", name) for name in sorted(_table(data, "project", "scripts")))


def makefile_hints(text: str) -> Hints:
    """Targets that stand alone before their colon; assignments and names that begin with a dot are none."""
    for line in text.splitlines():
        target, colon, rest = line.partition(":")
        if colon and not rest.startswith("=") and target[:1].isalpha() and target.isascii() and target.replace("-", "_").isidentifier():
            yield MAKE_KINDS.get(target, "other"), f"make {target}"


def package_hints(text: str) -> Hints:
    try:
        scripts = _table(json.loads(text), "scripts")
    except ValueError:
        return
    yield from ((NPM_KINDS.get(name, "other"), f"npm run {name}") for name in sorted(scripts))


def ci_steps(text: str) -> Iterator[str]:
    """The commands of steps whose ``run`` stands on one line."""
    for line in text.splitlines():
        entry = line.strip()
        entry = entry[1:].lstrip() if entry.startswith("- ") else entry
        key, colon, value = entry.partition(":")
        if key == "run" and colon and value[:1] in (" ", "\t") and value.strip() and value.strip()[0] not in "|>":
            yield value.strip()


def ci_hints(text: str) -> Hints:
    for command in ci_steps(text):
        if not _SET_UP.search(command):
            yield next((kind for word, kind in CI_WORDS if word in command), "other"), command


#: Build files in the order in which their commands count: the pattern of the path, and its reader.
READERS: tuple[tuple[str, Callable[[str, bool], Hints]], ...] = (
    (r"^pyproject\.toml$", pyproject_hints), (r"^Makefile$", lambda t, _: makefile_hints(t)), (r"^package\.json$", lambda t, _: package_hints(t)),
    (r"^\.github/workflows/[^/]+\.ya?ml$", lambda t, _: ci_hints(t)),
)


def tooling(files: DataFrame) -> DataFrame:
    """repo, command, kind, origin: what build files and CI offer, each command once, the first origin's."""
    rank = F.coalesce(*[F.when(F.col("path").rlike(rx), k) for k, (rx, _) in enumerate(READERS)])
    tests = files.filter(F.startswith("path", F.lit("tests/"))).select("repo").distinct().withColumn("has_tests", F.lit(True))

    def run(batches):
        for pdf in batches:
            rows = [(repo, path, k, i, kind, command) for repo, path, text, k, t in zip(pdf["repo"], pdf["path"], pdf["content"], pdf["rank"], pdf["has_tests"])
                    for i, (kind, command) in enumerate(READERS[k][1](text or "", bool(t)))]
            yield pd.DataFrame(rows, columns=["repo", "origin", "rank", "pos", "kind", "command"])

    build = files.withColumn("rank", rank).filter("rank is not null").join(tests, "repo", "left").select(
        "repo", "path", "content", "rank", F.coalesce("has_tests", F.lit(False)).alias("has_tests"))
    found = build.mapInPandas(run, "repo string, origin string, rank int, pos int, kind string, command string")
    return found.groupBy("repo", "command").agg(F.min(F.struct("rank", "origin", "pos", "kind")).alias("f")).select("repo", "command", "f.kind", "f.origin")


def stamps(files: DataFrame) -> DataFrame:
    """The freshness stamp of each SKILL.md: source, sha (null if unknown) and profile."""
    part = lambda k: F.trim(F.regexp_extract("content", rf"(?m)^\s*{k}:\s+(.*)$", 1))
    sha = part("sha")
    return files.filter(F.substring_index("path", "/", -1) == "SKILL.md").select(
        "repo", "path", part("source").alias("source"), F.when(~sha.isin("", "unknown"), sha).alias("sha"), F.coalesce(F.nullif(part("profile"), F.lit("")), F.lit("repo")).alias("profile")
    ).filter("source <> ''")


def stale_stamps(files: DataFrame, heads: DataFrame) -> DataFrame:
    """Stamps whose sha is not their repo's newest commit; heads: repo, sha."""
    return stamps(files).join(heads.select("repo", F.col("sha").alias("head")), "repo").filter("sha is null or sha <> head")


def repo_profile(commits: DataFrame, changes: DataFrame, files: DataFrame, limit: int = 15, anon: bool = False) -> dict[str, DataFrame]:
    """The parts of a profile, by name, each with a column repo; ``files`` has content and size.

    ``anon`` leaves contributors' names out.
    """
    owners = history.contributors(commits, changes).filter(F.col("rank") <= limit)
    return {
        "languages": fs.file_census(files), "layout": top_entries(files), "tooling": tooling_files(files), "commands": tooling(files),
        "prefixes": history.commit_prefixes(commits), "gotchas": hotspots_with_fixes(changes, limit), "themes": history.fix_themes(commits),
        "markers": fs.marker_counts(files), "owners": anonymous(owners) if anon else owners, "bus_factor": history.bus_factor(commits),
        "structure": outline.code_outline(files),
    }


def profile_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """repo, part, rows: how much each part of a profile holds."""
    out = None
    for name, df in parts.items():
        n = df.groupBy("repo").agg(F.count("*").alias("rows")).select("repo", F.lit(name).alias("part"), "rows")
        out = n if out is None else out.unionByName(n)
    return out
