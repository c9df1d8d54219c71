"""Ignore rules with the semantics of .gitignore."""

from __future__ import annotations

import re


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", r"\\") + "]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


class IgnoreMatcher:
    """Decides by the last rule that matches; a file below an ignored directory stays ignored."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []  # pattern, directories only, negated
        for line in lines:
            line = line.rstrip("\n\r")
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/") if only_dirs else line
            anchored = "/" in line
            body = _regex(line.lstrip("/"))
            self.rules.append((re.compile((body if anchored else "(?:.*/)?" + body) + r"\Z", re.S), only_dirs, negated))

    def _one(self, path: str, is_dir: bool) -> bool:
        found = False
        for rx, only_dirs, negated in self.rules:
            if (is_dir or not only_dirs) and rx.match(path):
                found = not negated
        return found

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        if parts[0] == ".git":
            return True
        return any(self._one("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._one(path, is_dir)
