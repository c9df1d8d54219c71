"""Dependency manifests and their audit against advisories."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$")
_VERSION = re.compile(r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?$")


def requirement(line: str) -> tuple[str, str | None] | None:
    """(name, pinned version or None) of one requirement line; markers and comments don't count."""
    line = line.split("#")[0].split(";")[0].strip()
    m = _REQUIREMENT.match(line) if line and not line.startswith("-") else None
    if not m:
        return None
    pin = re.fullmatch(r"==\s*([^\s,*]+)", m[2].strip())
    return m[1], pin[1] if pin else None


def read_manifest(name: str, text: str) -> list[tuple[str, str | None, str]]:
    """(name, version, ecosystem) of a manifest; an unreadable one has none."""
    try:
        if name == "package.json":
            data = json.loads(text)
            both = {**(data.get("dependencies") or {}), **(data.get("devDependencies") or {})}
            return [(k, v if _VERSION.match(str(v)) else None, "npm") for k, v in both.items()]
        if name == "pyproject.toml":
            data = tomllib.loads(text)
            project = data.get("project", {})
            lines = [*project.get("dependencies", []), *(x for v in project.get("optional-dependencies", {}).values() for x in v),
                     *(x for v in data.get("dependency-groups", {}).values() for x in v if isinstance(x, str))]
        else:
            lines = text.splitlines()
    except (ValueError, AttributeError):
        return []
    return [(*r, "PyPI") for r in map(requirement, lines) if r]


def dependencies(files: DataFrame, root_only: bool = True) -> DataFrame:
    """repo, path, name, version, ecosystem, pinned of the manifests in each repo's root, or of all."""
    def run(batches):
        for pdf in batches:
            rows = [(repo, path, *d, d[1] is not None) for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["content"])
                    for d in read_manifest(path.rsplit("/", 1)[-1], text or "")]
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "version", "ecosystem", "pinned"])

    place = F.col("path") if root_only else F.substring_index("path", "/", -1)
    found = files.filter(place.rlike(r"^(requirements.*\.txt|pyproject\.toml|package\.json)$")).select("repo", "path", "content")
    return found.mapInPandas(run, "repo string, path string, name string, version string, ecosystem string, pinned boolean")


def afflictions(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Pinned dependencies with the advisories (name, version, ecosystem, advisory) that name them."""
    hit = deps.filter("version is not null").join(advisories, ["name", "version", "ecosystem"])
    return hit.groupBy("repo", "name", "version").agg(F.array_join(F.array_sort(F.collect_set("advisory")), ",").alias("ids"))


def dependency_audit(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every dependency with the ids of its advisories, '' where there are none or it isn't pinned."""
    ids = advisories.groupBy("name", "version", "ecosystem").agg(F.array_join(F.array_sort(F.collect_set("advisory")), " ").alias("ids"))
    return deps.join(ids, ["name", "version", "ecosystem"], "left").select("repo", "path", "name", "version", "ecosystem", "pinned", F.coalesce("ids", F.lit("")).alias("ids"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per repo: dependencies, those not pinned, those with an advisory."""
    return audit.groupBy("repo").agg(F.count("*").alias("dependencies"), F.count_if(~F.col("pinned")).alias("unpinned"), F.count_if(F.col("ids") != "").alias("afflicted"))
