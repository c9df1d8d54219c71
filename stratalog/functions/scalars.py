"""Scalar helpers that the operators share.  All are column expressions of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Words in a subject that mark a fix (a fixed value).
FIX_WORDS = r"(?i)\b(fix|fixes|fixed|bug|bugs|defect|fault|hotfix|patch|repair|regression)\b"


def round3(x: Column) -> Column:
    """Half up in double arithmetic, the same in every engine."""
    return F.floor(x * 1000 + 0.5) / 1000


def age_days(time: Column | str, now: int) -> Column:
    """Whole days from an epoch to ``now``, at least 0; null for none."""
    return F.when(time.isNotNull(), F.greatest(F.lit(0), F.floor((F.lit(now) - time) / 86400))).cast("long")


def identity() -> Column:
    """The contributor: the e-mail, or the name where that is empty."""
    return F.coalesce(F.nullif("author_email", F.lit("")), F.col("author_name"))


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def suffix(path: Column) -> Column:
    """The lower-case suffix of the last segment, or "(none)"."""
    found = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.when(found == "", "(none)").otherwise(found)


def is_fix(subject: Column) -> Column:
    return subject.rlike(FIX_WORDS)


def n_lines(text: Column) -> Column:
    """Line feeds, and one for an unterminated rest."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def split_lines(text: Column) -> Column:
    """The lines as Python's splitlines() has them, in the terminators it knows."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def glob(path: Column, pattern: str) -> Column:
    """Whether the last segment or the whole path matches; ``*`` crosses ``/``."""
    rx = glob_regex(pattern)
    return F.substring_index(path, "/", -1).rlike(rx) | path.rlike(rx)


def glob_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c))
        i += 1
    return rf"\A{out}\z"


def unsafe_path(path: Column) -> Column:
    """Why a path must not be written, or null."""
    parts = F.split(path, "/")
    return (F.when((path == "") | path.contains("\x00") | path.contains("\\"), "malformed path")
            .when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "absolute path")
            .when(F.array_contains(parts, ".."), "path traversal")
            .when(F.array_contains(parts, "") | F.array_contains(parts, "."), "malformed path"))


def mask(secret: Column) -> Column:
    return (F.when(F.length(secret) <= 8, F.concat(F.substring(secret, 1, 2), F.lit("...")))
            .otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, -4, 4))))


def fingerprint(rule: Column, secret: Column) -> Column:
    return F.substring(F.sha2(F.concat(rule, F.lit(":"), secret), 256), 1, 16)


def fence_length(text: Column) -> Column:
    """Back-ticks of a fence that no run in the text reaches."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda r: F.length(r))
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1).cast("long")


_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


def parse_size(text: str) -> int:
    """'1MB' is 10**6, '512KiB' is 2**19, '2k' is 2000; '1Ki' is refused."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)(i?)(b?)\s*", text.lower())
    if not m or (m[3] and not (m[2] and m[4])):
        raise ValueError(f"not a size: {text!r}")
    unit = 1024 ** (" kmgt".index(m[2])) if m[3] else _UNITS[m[2]]
    return int(float(m[1]) * unit)


def parse_duration(text: str) -> int:
    """'7d' or '12h' in seconds; units s m h d w."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text.lower())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]]
