"""Single-file outputs of analyses: JSON, CSV, Markdown, HTML, an SVG grid and archives.

These gather the rows that a report shows, so they take a limit; whole results are written by
``df.write``.
"""

from __future__ import annotations

import csv
import gzip
import hashlib
import html
import io
import json
import shutil
import sys
import tarfile
import zipfile
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import IO

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 10_000


@dataclass(frozen=True)
class Provenance:
    """What an output was made from; ``generated`` is given, never read from a clock."""

    schema: str
    source: str
    generated: str
    invoked: str = ""
    ref: str = ""
    version: str = "1"


class TooLarge(ValueError):
    """A report would have more rows than its limit."""


def rows_of(df: DataFrame, order: list[str | Column], limit: int = LIMIT) -> list[dict]:
    """The rows in a total order; more than ``limit`` is an error, never a silent cut."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows; write the DataFrame instead")
    return [r.asDict(recursive=True) for r in rows]


def to_json(rows: list[dict], prov: Provenance) -> str:
    return json.dumps({"provenance": asdict(prov), "rows": rows}, indent=2, ensure_ascii=True, default=str) + "\n"


def to_csv(rows: list[dict], columns: list[str]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    for r in rows:
        w.writerow(["" if r[c] is None else json.dumps(r[c], default=str) if isinstance(r[c], (list, dict)) else r[c] for c in columns])
    return out.getvalue()


def to_markdown(rows: list[dict], columns: list[str], title: str, prov: Provenance) -> str:
    cell = lambda x: str("" if x is None else x).replace("|", r"\|").replace("\n", " ")
    head = "\n".join(f"{k}: {v}" for k, v in asdict(prov).items())
    lines = [f"<!--\n{head}\n-->", f"# {title}", "", f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"]
    return "\n".join(lines + [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows]) + "\n"


def to_html(rows: list[dict], columns: list[str], title: str, bar: str | None = None) -> str:
    """A table; ``bar`` names a column that is also drawn as a bar."""
    most = max((float(r[bar] or 0) for r in rows), default=0) if bar else 0
    esc = lambda x: html.escape(str("" if x is None else x))

    def line(r: dict) -> str:
        cells = "".join(f"<td>{esc(r[c])}</td>" for c in columns)
        width = round(100 * float(r[bar] or 0) / most) if bar and most else 0
        return f"<tr>{cells}" + (f'<td><div class="bar" style="width:{width}%"></div></td>' if bar else "") + "</tr>"

    head = "".join(f"<th>{esc(c)}</th>" for c in columns) + ("<th></th>" if bar else "")
    return (f"<!doctype html>\n<title>{esc(title)}</title>\n<style>.bar{{background:#48a;height:1em}}</style>\n<h1>{esc(title)}</h1>\n"
            f"<table><tr>{head}</tr>\n" + "\n".join(map(line, rows)) + "\n</table>\n")


def to_svg_grid(cells: dict[tuple[int, int], int], size: int = 14) -> str:
    """The 7 x 24 grid of activity as an SVG."""
    most = max(cells.values(), default=0)
    boxes = [
        f'<rect x="{h * size}" y="{d * size}" width="{size - 1}" height="{size - 1}" fill="#2a6" fill-opacity="{(cells.get((d, h), 0) / most if most else 0):.2f}"><title>{cells.get((d, h), 0)}</title></rect>'
        for d in range(7) for h in range(24)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{24 * size}" height="{7 * size}">' + "".join(boxes) + "</svg>\n"


def human_size(n: int) -> str:
    """1000-based, one decimal."""
    if n < 1000:
        return f"{n} B"
    power = next(p for p in (1, 2, 3, 4) if n < 1000 ** (p + 1) or p == 4)
    return f"{n / 1000**power:.1f} {'KMGT'[power - 1]}B"


def spark_line(values: list[int]) -> str:
    most = max(values, default=0)
    return "".join(" ▁▂▃▄▅▆▇█"[0 if not v else 1 + round(7 * v / most)] for v in values)


def ascii_tree(paths: list[str]) -> str:
    """A nested listing, directories first."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("/"):
            node = node.setdefault(part, {})

    def draw(node: dict, depth: int) -> list[str]:
        out = []
        for name, below in sorted(node.items(), key=lambda kv: (not kv[1], kv[0])):
            out.append("  " * depth + name + ("/" if below else ""))
            out += draw(below, depth + 1)
        return out

    return "\n".join(draw(tree, 0)) + "\n"


def tar_archive(files: dict[str, bytes], mtime: int = 0) -> bytes:
    """A tar with the same bytes for the same files: sorted, without owners."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for p in sorted(files):
            info = tarfile.TarInfo(p)
            info.size, info.mtime, info.mode = len(files[p]), mtime, 0o644
            tar.addfile(info, io.BytesIO(files[p]))
    return raw.getvalue()


def targz_archive(files: dict[str, bytes], mtime: int = 0) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=mtime, filename="") as z:
        z.write(tar_archive(files, mtime))
    return out.getvalue()


def snapshot_archive(files: dict[str, bytes], mtime: int, prov: Provenance) -> tuple[bytes, str]:
    """A tar.gz of the files, their hashes and provenance, and its sha256."""
    listing = "".join(f"{hashlib.sha256(files[p]).hexdigest()}  {p}\n" for p in sorted(files))
    facts = "".join(f"{k}: {v}\n" for k, v in asdict(prov).items())
    done = targz_archive({**files, "MANIFEST.sha256": listing.encode(), "PROVENANCE": facts.encode()}, mtime)
    return done, hashlib.sha256(done).hexdigest()


def zip_archive(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(files):
            z.writestr(zipfile.ZipInfo(p, (1980, 1, 1, 0, 0, 0)), files[p])
    return out.getvalue()


ARCHIVES = {".zip": zip_archive, ".tar": tar_archive, ".tar.gz": targz_archive}


def emit(text: str, out: Path | None = None, stream: IO[str] | None = None) -> None:
    """To a file, made with its folders, or to a stream (else standard output); nothing else is ever written there."""
    if out is None:
        (stream or sys.stdout).write(text)
        return
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(text, encoding="utf-8", newline="")


def write_sections(sections: DataFrame, out: Path, column: str = "section") -> int:
    """Sections (repo, path, text) in walk order as one file; rows come one partition at a time.  Returns how many."""
    n = 0
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8", newline="") as f:
        for row in sections.orderBy("repo", F.split("path", "/")).select(column).toLocalIterator():
            f.write(row[0])
            n += 1
    return n


class UnpackError(ValueError):
    """A packed tree that must not be written there."""


def write_files(rows: DataFrame, target: Path, force: bool = False) -> list[str]:
    """Writes unpacked files (repo, path, content, hash_ok, unsafe) below ``target``; returns paths whose hash differs.

    Nothing is written if a path is unsafe or occurs twice, or the folder isn't empty and ``force``
    isn't given.  Files whose hash differs are written all the same, so that they can be looked at.
    """
    if target.exists() and any(target.iterdir()) and not force:
        raise UnpackError(f"{target} is not empty")
    if bad := rows.filter("unsafe is not null").orderBy("path").head():
        raise UnpackError(f"{bad['path']!r}: {bad['unsafe']}")
    if twice := rows.groupBy("path").count().filter("count > 1").orderBy("path").head():
        raise UnpackError(f"{twice['path']!r} occurs twice")
    differ = []
    for row in rows.orderBy("path").toLocalIterator():
        at = target / row["path"]
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(row["content"], encoding="utf-8", newline="")
        if row["hash_ok"] is False:
            differ.append(row["path"])
    return differ


def copy_skills(root: Path, skills: list[dict], files: list[dict], out: Path, source: str) -> Path:
    """Copies skill folders of a tree byte for byte below ``out``, each under its name, and writes their index.

    ``skills`` and ``files`` are rows of ``collect_skills`` and ``skill_files``.  A skill that is
    there already is replaced; without skills nothing is written.
    """
    for s in skills:
        to = out / s["name"]
        shutil.rmtree(to, ignore_errors=True)
        for f in files:
            if f["dir"] == s["dir"] and not (root / f["path"]).is_symlink():
                (to / f["file"]).parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(root / f["path"], to / f["file"])
    if skills:
        rows = [f"| [{s['name']}]({s['name']}/SKILL.md) | {s['dir'] or '.'} | {s['description']} |" for s in skills]
        binary = [f"- {s['name']}: {s['binaries']}" for s in skills if s["binaries"]]
        emit("\n".join([f'---\nname: {out.name}\ndescription: "{len(skills)} skills of {source}"\n---', "", "| skill | folder | description |", "| --- | --- | --- |", *rows,
                        *(["", "## Binary files", "", *binary] if binary else [])]) + "\n", out / "SKILL.md")
    return out
