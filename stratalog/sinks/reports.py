"""What the report of each analysis shows: its columns, their headings and its (ascending) order; the profile's bundle; the portrait."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .render import LIMIT, Provenance, human_size, rows_of, to_csv, to_html, to_json, to_markdown


@dataclass(frozen=True)
class Report:
    """``columns`` are SQL expressions by heading; ``order`` is a total one; ``bar`` is drawn in HTML."""

    title: str
    columns: dict[str, str]
    order: tuple[str, ...]
    bar: str | None = None


def _same(*names: str, **other: str) -> dict[str, str]:
    return {n: n for n in names} | other


_RANK = "case severity when 'high' then 0 when 'medium' then 1 else 2 end"
# Headings and their order are fixed values: other programs read the CSV.
REPORTS = {
    "file_census": Report("Census", {"extension": "ext", "language": "language", "files": "files", "size_bytes": "bytes", "lines": "lines", "token_estimate": "tokens"}, ("-bytes", "ext"), "size_bytes"),
    "commit_history": Report("History", {"sha": "sha", "date": "author_date", "author": "author_name", "message": "subject", "files_changed": "files_changed", "insertions": "insertions",
                                         "deletions": "deletions"}, ("seq",)),
    "contributors": Report("Contributors", _same("name", "commits", "insertions", "deletions", "first_seen", "last_seen"), ("-commits", "lower(name)", "rank"), "commits"),
    "hotspots": Report("Hotspots", _same("path", "commits", "churn", "insertions", "deletions"), ("-commits", "-churn", "path"), "commits"),
    "deleted_paths": Report("Deleted files", {"path": "path", "died": "date", "last_sha": "sha", "author": "author"}, ("seq", "path")),
    "branch_hygiene": Report("Branches", _same("name", "age_days", "author", "merged", "gone_upstream", "stale"), ("-age_days", "name"), "age_days"),
    "stale_files": Report("Stale files", {"path": "path", "last_commit": "last_date", "age_days": "age_days", "last_sha": "last_sha"}, ("-age_days", "path"), "age_days"),
    "secret_scan": Report("Secrets", {"severity": "severity", "rule": "rule", "path": "path", "line": "line", "preview": "preview", "sha": "sha", "date": "author_date", "author": "author_name",
                                      "fingerprint": "fingerprint"}, (_RANK, "path", "line", "rule", "fingerprint")),
    "risk_scores": Report("Risk", {"path": "path", "score": "score", "churn": "churn_score", "bug": "bug_score", "age": "age_score", "size": "size_score", "commits": "commits",
                                   "bug_commits": "bug_commits", "age_days": "age_days", "size_bytes": "size"}, ("-score", "path"), "score"),
    "duplicate_paths": Report("Duplicates", {"sha256": "sha256", "size_bytes": "size", "path": "path"}, ("-size", "sha256", "path"), "size_bytes"),
    "heavy_files": Report("Heavy files", {"where": "place", "path": "path", "size_bytes": "size", "sha": "sha"}, ("place <> 'tree'", "-size", "path", "sha"), "size_bytes"),
    "compare_files": Report("Changes in a range", _same("path", "insertions", "deletions"), ("-(insertions + deletions)", "path"), "insertions"),
    "dependency_audit": Report("Dependencies", {"package": "name", "version": "coalesce(version, '')", "ecosystem": "ecosystem", "manifest": "path", "pinned": "pinned", "afflictions": "ids"},
                               ("path", "name", "version")),
    "markers": Report("Markers", _same("path", "line", "marker", "text", "author", "age_days"), ("path", "line")),
}


def rows(name: str, df: DataFrame, limit: int = LIMIT) -> list[dict]:
    """The rows of a report, in its order; a column that ``df`` lacks (an optional one) is empty."""
    report = REPORTS[name]
    for optional in ("author", "age_days", "sha", "author_date", "author_name"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(None).cast("string"))
    keep = [F.col("repo")] if "repo" in df.columns else []
    shown = F.struct(*[F.expr(e).alias(h) for h, e in report.columns.items()]).alias("shown")
    by = [f"o{k}" for k in range(len(report.order))]
    found = rows_of(df.select(*keep, shown, *[F.expr(x).alias(o) for x, o in zip(report.order, by)]), [*keep, *map(F.col, by)], limit)
    many = len({r.get("repo") for r in found}) > 1
    return [({"repo": r["repo"]} if many else {}) | r["shown"] for r in found]


def heavy(files: DataFrame, dead: DataFrame) -> DataFrame:
    """The rows of the report on heavy files: those of the tree, then dead blobs."""
    tree = files.select("repo", F.lit("tree").alias("place"), "path", "size", F.lit("").alias("sha"))
    return tree.unionByName(dead.select("repo", F.lit("history").alias("place"), "path", "size", "sha"))


def render(name: str, df: DataFrame, kind: str, prov: Provenance, limit: int = LIMIT) -> str:
    """A report as "json", "csv", "md" or "html"."""
    report, found = REPORTS[name], rows(name, df, limit)
    columns = [*(["repo"] if found and "repo" in found[0] else []), *report.columns]
    if kind == "json":
        return to_json(found, prov)
    if kind == "csv":
        return to_csv(found, columns)
    if kind == "md":
        return to_markdown(found, columns, report.title, prov)
    if kind == "html":
        return to_html(found, columns, report.title, report.bar)
    raise ValueError(f"no report as {kind!r}")


PROFILES = ("repo", "stack", "onboarding")


def _listed(lines: list[str], none: str) -> list[str]:
    return lines or [none]


def bundle(name: str, source: str, sha: str | None, parts: dict[str, list[dict]], profile: str = "repo") -> dict[str, str]:
    """The files of a profile: path -> text.  ``parts`` are rows of ``repo_profile`` of one repo.

    SKILL.md carries the stamp that ``profile.stamps`` reads back.
    """
    if profile not in PROFILES:
        raise ValueError(f"a profile is one of {', '.join(PROFILES)}")
    stamp = [f"source: {source}", f"sha: {sha or 'unknown'}", f"profile: {profile}"]
    languages = list(dict.fromkeys(r["language"] for r in sorted(parts["languages"], key=lambda r: (-r["bytes"], r["ext"])) if r["language"]))
    files = sum(r["files"] for r in parts["languages"])
    entries = [r["entry"] for r in sorted(parts["layout"], key=lambda r: r["place"])]
    tools = [r["path"] for r in sorted(parts["tooling"], key=lambda r: r["place"])]
    commands = sorted(parts["commands"], key=lambda r: (r["kind"], r["command"]))
    titles = {"repo": f"Working in {name}", "stack": f"Working with {', '.join(languages) or 'this stack'}", "onboarding": f"Getting to know {name}"}
    pages = {
        "conventions": ["## Layout", "", *_listed([f"- `{e}`" for e in entries], "An empty tree."), "", "## Tools", "", *_listed([f"- `{t}`" for t in tools], "None found."), "",
                        "## Commits", "", *_listed([f"- `{r['prefix']}:` {r['commits']}" for r in sorted(parts["prefixes"], key=lambda r: (-r["commits"], r["prefix"]))], "Free subjects.")],
        "commands": _listed([f"- {r['kind']}: `{r['command']}` ({r['origin']})" for r in commands], "No commands were found."),
        "gotchas": ["| file | commits | fixes | churn |", "| --- | --- | --- | --- |",
                    *[f"| {r['path']} | {r['commits']} | {r['fixes']} | {r['churn']} |" for r in sorted(parts["gotchas"], key=lambda r: r["rank"])], "",
                    *[f"- {r['word']} ({r['n']} fixes)" for r in sorted(parts["themes"], key=lambda r: r["rank"])],
                    *[f"- {r['n']} lines with {r['marker']}" for r in sorted(parts["markers"], key=lambda r: r["marker"])]],
        "ownership": [f"Bus factor: {parts['bus_factor'][0]['bus_factor'] if parts['bus_factor'] else 0}", "",
                      *_listed([f"- {r['name']}: {r['commits']} commits, last {r['last_seen'][:10]}" for r in sorted(parts["owners"], key=lambda r: r["rank"])], "No commits.")],
        "structure": _listed([f"- {'  ' * (r['depth'] or 0)}`{r['signature']}` ({r['path']}:{r['line']})" if r["signature"] else f"- {r['path']}: {r['error'] or 'nothing to list'}"
                              for r in sorted(parts["structure"], key=lambda r: (r["path"], r["line"] or 0))], "No source code."),
    }
    test = [f"- Test with `{r['command']}`" for r in commands if r["kind"] == "test"][:1]
    head = ["---", f"name: {name}", f"description: Conventions, commands, structure and pitfalls of {name}", "---", "", "<!--", *stamp, "-->", "", f"# {titles[profile]}", "",
            f"- {files} files, mostly {', '.join(languages[:3]) or 'of no known language'}", *test, *[f"- [{page}](reference/{page}.md)" for page in pages]]
    out = {"SKILL.md": "\n".join(head) + "\n"}
    return out | {f"reference/{page}.md": "\n".join([f"# {page.capitalize()}", "", *lines]) + "\n" for page, lines in pages.items()}


def poster(name: str, parts: dict[str, list[dict]], width: int = 640) -> str:
    """A portrait as SVG: the people as bars, the activity as a clock of rings, the tree as slices of a circle.  ``parts`` are rows of ``portrait`` of one repo."""
    esc = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;")
    most = max((p["commits"] for p in parts["people"]), default=1)
    bars = [f'<rect x="20" y="{60 + 22 * k}" width="{max(1, round(180 * p["commits"] / most))}" height="14" fill="#48a"/><text x="210" y="{72 + 22 * k}">{esc(p["name"])} {p["commits"]}</text>'
            for k, p in enumerate(sorted(parts["people"], key=lambda p: p["rank"]))]
    peak = max((c["commits"] for c in parts["activity"]), default=1)
    dots = []
    for c in parts["activity"]:
        angle, r = 2 * math.pi * c["hour"] / 24 - math.pi / 2, 24 + 13 * c["weekday"]
        dots.append(f'<circle cx="{480 + r * math.cos(angle):.1f}" cy="{150 + r * math.sin(angle):.1f}" r="{1 + 5 * c["commits"] / peak:.1f}" fill="#2a6"/>')
    total, at, slices = sum(s["bytes"] for s in parts["slices"]) or 1, 0.0, []
    for k, s in enumerate(sorted(parts["slices"], key=lambda s: s["rank"])):
        share = 100 * s["bytes"] / total
        slices.append(f'<rect x="{20 + at * 6:.1f}" y="290" width="{share * 6:.1f}" height="30" fill="#48a" fill-opacity="{1 - 0.08 * k:.2f}"><title>{esc(s["dir"])} {human_size(s["bytes"])}</title></rect>')
        at += share
    v = (parts["vitals"] or [{}])[0]
    foot = f'{v.get("commits", 0)} commits by {v.get("contributors", 0)} people in {v.get("age_days", 0)} days'
    return (f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="380" font-family="sans-serif" font-size="12"><text x="20" y="32" font-size="20">{esc(name)}</text>'
            + "".join(bars + dots + slices) + f'<text x="20" y="350">{esc(foot)}</text></svg>\n')
