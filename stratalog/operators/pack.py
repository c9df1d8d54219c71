"""Packing files into a text that can be unpacked byte for byte."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import fence_length, n_lines, unsafe_path

_HEAD = re.compile(r"^=== file (\S.*)$")
_META = re.compile(r"^meta sha256=([0-9a-f]{64}) end=(\d+) eol=(yes|no)$")


def pack_receipts(files: DataFrame) -> DataFrame:
    """repo, path, size, lines, tokens (characters div 4), fence, no_eol, sha256."""
    c = F.col("content")
    return files.select(
        "repo", "path", F.octet_length(c).cast("long").alias("size"), n_lines(c).alias("lines"), F.expr("cast(char_length(content) div 4 as bigint)").alias("tokens"),
        fence_length(c).alias("fence"), ((c != "") & ~c.endswith("\n")).alias("no_eol"), F.sha2(c, 256).alias("sha256"))


def shard(receipts: DataFrame, budget: int) -> DataFrame:
    """The part of each file: in walk order, a part ends where its tokens would pass ``budget``.

    Where a part ends depends on all files before it, so a repo's sizes (not its texts) go by in
    order in one task, as a stream that keeps nothing but the part's tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, part, used = None, 0, 0
        for batch in batches:
            parts = []
            for own, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != repo:
                    repo, part, used = own, 1, 0
                elif used and used + tokens > budget:
                    part, used = part + 1, 0
                used += tokens
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int64())], ["repo", "path", "part"])

    ordered = receipts.select("repo", "path", "tokens").repartition("repo").sortWithinPartitions("repo", F.split("path", "/"))
    return ordered.mapInArrow(run, "repo string, path string, part long")


def render(path: str, content: str) -> str:
    """One file's section; ``unpack_text`` reads it back."""
    fence = "`" * max([3, *(len(x) + 1 for x in re.findall("`+", content))])
    n = 0
    while f"=== end {n} {path}" in content:
        n += 1
    eol = content == "" or content.endswith("\n")
    digest = hashlib.sha256(content.encode()).hexdigest()
    return f"=== file {path}\nmeta sha256={digest} end={n} eol={'yes' if eol else 'no'}\n{fence}\n{content}{'' if eol else chr(10)}{fence}\n=== end {n} {path}\n"


def pack(files: DataFrame, budget: int) -> DataFrame:
    """repo, part, text: the packed parts, files in walk order."""
    parts = shard(pack_receipts(files), budget)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=pdf["path"].map(lambda p: p.split("/"))).sort_values("k")
        text = "".join(render(p, c) for p, c in zip(pdf["path"], pdf["content"]))
        return pd.DataFrame({"repo": [pdf["repo"].iat[0]], "part": [pdf["part"].iat[0]], "text": [text]})

    return files.select("repo", "path", "content").join(parts, ["repo", "path"]).groupBy("repo", "part").applyInPandas(run, "repo string, part long, text string")


class PackError(ValueError):
    """A packed text that can't be read; the message names the line."""


def unpack_text(text: str) -> list[tuple[str, str, bool]]:
    """(path, content, whether the hash agrees) of each section."""
    lines, i, out = text.split("\n"), 0, []
    while i < len(lines):
        if lines[i] == "":
            i += 1
            continue
        head = _HEAD.match(lines[i])
        meta = _META.match(lines[i + 1]) if head and i + 1 < len(lines) else None
        if not meta or i + 2 >= len(lines) or not re.fullmatch("`{3,}", lines[i + 2]):
            raise PackError(f"line {i + 1}: not a file section")
        path, fence = head[1], lines[i + 2]
        j = i + 3
        while j < len(lines) and lines[j] != fence:
            j += 1
        if j + 1 >= len(lines) or lines[j + 1] != f"=== end {meta[2]} {path}":
            raise PackError(f"line {i + 1}: the section of {path!r} has no end")
        content = "".join(f"{x}\n" for x in lines[i + 3 : j])
        content = content if meta[3] == "yes" else content[:-1]
        out.append((path, content, hashlib.sha256(content.encode()).hexdigest() == meta[1]))
        i = j + 2
    if len({p for p, _, _ in out}) < len(out):
        raise PackError("a path occurs twice")
    return out


def unpack(parts: DataFrame) -> DataFrame:
    """repo, path, content, hash_ok, unsafe of packed parts (repo, part, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r, *x) for r, t in zip(pdf["repo"], pdf["text"]) for x in unpack_text(t)], columns=["repo", "path", "content", "hash_ok"])

    out = parts.select("repo", "text").mapInPandas(run, "repo string, path string, content string, hash_ok boolean")
    return out.withColumn("unsafe", unsafe_path(F.col("path")))
