"""Fenced code blocks of Markdown, by the CommonMark rules.

A document is read once, line by line; a fence is an event of opening, text or closing.  Names
are given in a second pass over the blocks that are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import unsafe_path

# File extensions of fence languages.
EXTENSIONS = {
    "python": "py", "py": "py", "javascript": "js", "js": "js", "typescript": "ts", "ts": "ts", "tsx": "tsx", "jsx": "jsx", "bash": "sh",
    "sh": "sh", "shell": "sh", "zsh": "sh", "console": "sh", "rust": "rs", "rs": "rs", "go": "go", "java": "java", "kotlin": "kt", "c": "c",
    "cpp": "cpp", "c++": "cpp", "h": "h", "cs": "cs", "ruby": "rb", "rb": "rb", "php": "php", "swift": "swift", "sql": "sql", "html": "html",
    "css": "css", "json": "json", "yaml": "yml", "yml": "yml", "toml": "toml", "ini": "ini", "xml": "xml", "markdown": "md", "md": "md",
    "diff": "diff", "dockerfile": "dockerfile", "makefile": "mk",
}
# Keys of a fence's info text that name its file.
NAME_KEYS = ("title", "filename", "file", "path")


@dataclass
class Block:
    mark: str
    info: str
    line: int
    body: list[str] = field(default_factory=list)

    @property
    def content(self) -> str:
        return "".join(f"{x}\n" for x in self.body)


def fence(line: str) -> tuple[str, str] | None:
    """The run of back-ticks or tildes that a line begins with (three or more, indented by three at most), and the rest."""
    text = line.lstrip(" ")
    run = text[: len(text) - len(text.lstrip(text[0]))] if text[:1] in ("`", "~") and text else ""
    return (run, text[len(run) :]) if len(run) >= 3 and len(line) - len(text) <= 3 else None


def blocks(text: str) -> Iterator[Block]:
    """The closed blocks; one that never closes is prose, with all that follows it."""
    current: Block | None = None
    for number, line in enumerate(text.split("\n"), 1):
        mark = fence(line)
        if current is None:
            if mark and not (mark[0][0] == "`" and "`" in mark[1]):
                current = Block(mark[0], mark[1].strip(), number)
        elif mark and mark[0].startswith(current.mark) and not mark[1].strip():
            yield current
            current = None
        else:
            current.body.append(line)


def described(info: str) -> tuple[str, str | None]:
    """The language and the file name that an info text gives."""
    words = info.split()
    plain = [w for w in words if "=" not in w and ("/" in w or "." in w) and w[0] not in "{."]
    if not words or words[0] in plain:
        return "", words[0] if words else None
    pairs = (w.lstrip("{").partition("=") for w in words)
    keyed = [v.strip("\"'}") for k, eq, v in pairs if eq and k in NAME_KEYS]
    return words[0].lstrip("{.").rstrip("}").lower(), next((x for x in [*keyed, *plain] if x), None)


def distinct(names: Iterable[str]) -> Iterator[str]:
    """The names, a later one with a number before its suffix where it is taken."""
    taken: set[str] = set()
    for name in names:
        at, n = PurePosixPath(name), 1
        while name in taken:
            n += 1
            name = f"{str(at)[: len(str(at)) - len(at.suffix)]}-{n}{at.suffix}"
        taken.add(name)
        yield name


def named_blocks(text: str, stem: str, lang: str | None = None) -> list[tuple[str, str, int, bool, str]]:
    """(name, language, line, whether the document names it, content) of the blocks of one document."""
    kept = [(b, *described(b.info)) for b in blocks(text)]
    kept = [x for x in kept if lang is None or x[1] == lang.lower()]
    names = ((path or f"{stem}.block-{k:02d}.{EXTENSIONS.get(language, language or 'txt')}").replace("\\", "/")
             for k, (_, language, path) in enumerate(kept, 1))
    return [(name, language, b.line, path is not None, b.content) for name, (b, language, path) in zip(distinct(names), kept)]


def extract_code_blocks(files: DataFrame, lang: str | None = None) -> DataFrame:
    """repo, path, name, language, line, named, content, unsafe of every fenced block."""
    def run(batches):
        for pdf in batches:
            rows = [(repo, path, *b) for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["content"])
                    for b in named_blocks(text or "", PurePosixPath(path).stem, lang)]
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "language", "line", "named", "content"])

    fenced = files.select("repo", "path", "content").filter(F.contains("content", F.lit("```")) | F.contains("content", F.lit("~~~")))
    out = fenced.mapInPandas(run, "repo string, path string, name string, language string, line long, named boolean, content string")
    return out.withColumn("unsafe", unsafe_path(F.col("name")))
