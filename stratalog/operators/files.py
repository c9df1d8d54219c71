"""Analyses of file trees: census, markers, duplicates, sizes, trees, snapshots, gathering.

``files`` is repo, path, size; with texts it also has ``content``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import age_days, glob, n_lines, split_lines, suffix

#: Languages by suffix.
LANGUAGES = {
    ".c": "C", ".cfg": "Config", ".cpp": "C++", ".cs": "C#", ".css": "CSS", ".go": "Go", ".h": "C header", ".html": "HTML", ".ini": "Config",
    ".java": "Java", ".js": "JavaScript", ".json": "JSON", ".jsx": "JavaScript", ".kt": "Kotlin", ".lua": "Lua", ".md": "Markdown", ".php": "PHP",
    ".pl": "Perl", ".py": "Python", ".r": "R", ".rb": "Ruby", ".rs": "Rust", ".sh": "Shell", ".sql": "SQL", ".swift": "Swift", ".toml": "TOML",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".txt": "Text", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML",
}
#: Bytes that are looked at to tell binary files.
SNIFF = 8192
MARKERS = ("TODO", "FIXME", "HACK", "XXX")


def is_binary(content):
    """A NUL in the first SNIFF bytes; an unreadable (null) file counts as binary."""
    return F.coalesce(F.contains(F.substring(content.cast("binary"), 1, SNIFF).cast("string"), F.lit("\x00")), F.lit(True))


def language(ext):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit(""))


def file_census(files: DataFrame) -> DataFrame:
    """Per suffix: files and bytes; of text files lines and tokens (bytes div 4)."""
    text = ~is_binary(F.col("content"))
    size = F.octet_length("content")
    return files.select("repo", suffix(F.col("path")).alias("ext"), size.alias("size"), F.when(text, n_lines(F.col("content"))).alias("l"), F.when(text, F.expr("octet_length(content) div 4")).alias("t")).groupBy("repo", "ext").agg(
        F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens")
    ).withColumn("language", language(F.col("ext")))


def census_by_size(files: DataFrame) -> DataFrame:
    """The census of a tree without contents, with a total row (suffix null) per repo."""
    return files.select("repo", suffix(F.col("path")).alias("ext"), "size").rollup("repo", "ext").agg(
        F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes")).filter("repo is not null")


def marker_pattern(words: tuple[str, ...] = MARKERS) -> str:
    """The marker, and the text after it."""
    return r"\b(" + "|".join(words) + r")\b[:\s]*(.*)"


def markers(files: DataFrame, words: tuple[str, ...] = MARKERS, blame: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """The first marker of each line: repo, path, line, marker and the text after it, 200 characters at most.

    With ``blame`` (repo, path, line, author, author_time) the author too, and with ``now`` the
    line's age in days; beyond it null.
    """
    rx = marker_pattern(words)
    some = files.filter(F.col("content").rlike("|".join(words)))
    lines = some.select("repo", "path", F.posexplode(split_lines(F.col("content"))).alias("pos", "text"))
    out = lines.filter(F.col("text").rlike(rx)).select(
        "repo", "path", (F.col("pos") + 1).cast("long").alias("line"), F.regexp_extract("text", rx, 1).alias("marker"),
        F.substring(F.trim(F.regexp_extract("text", rx, 2)), 1, 200).alias("text"))
    if blame is None:
        return out
    out = out.join(blame, ["repo", "path", "line"], "left")
    return out if now is None else out.withColumn("age_days", age_days(F.col("author_time"), now))


def marker_counts(files: DataFrame, words: tuple[str, ...] = MARKERS) -> DataFrame:
    """repo, marker and how many lines have it; markers that no line has are left out."""
    return markers(files, words).groupBy("repo", "marker").agg(F.count("*").alias("n"))


def _copies(files: DataFrame, least: int) -> DataFrame:
    """repo, path, size, sha256 of the files whose size occurs twice in their repo; others are never hashed."""
    sized = files.withColumn("size", F.octet_length("content").cast("long")).filter(F.col("size") >= max(1, least))
    twice = sized.groupBy("repo", "size").agg(F.count("*").alias("n")).filter("n > 1").select("repo", "size")
    return sized.join(twice, ["repo", "size"], "left_semi").select("repo", "path", "size", F.sha2("content", 256).alias("sha256"))


def duplicate_files(files: DataFrame, least: int = 1) -> DataFrame:
    """Equal contents of ``least`` bytes or more: copies, bytes to reclaim, first and last path.

    ``duplicate_paths`` lists the paths; a group may be far too large for one row.
    """
    return _copies(files, least).groupBy("repo", "sha256", "size").agg(
        F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).filter("copies > 1").withColumn(
        "reclaimable", (F.col("copies") - 1) * F.col("size"))


def duplicate_paths(files: DataFrame, least: int = 1) -> DataFrame:
    """repo, sha256, size, path: one row for each copy of a content that occurs twice or more."""
    same = _copies(files, least)
    groups = same.groupBy("repo", "sha256").agg(F.count("*").alias("copies")).filter("copies > 1").select("repo", "sha256")
    return same.join(groups, ["repo", "sha256"]).select("repo", "sha256", "size", "path")


def heavy_files(files: DataFrame, limit: int = 20) -> DataFrame:
    """The largest files of each repo, and its bytes in all."""
    w = Window.partitionBy("repo").orderBy(F.desc("size"), "path")
    top = files.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    return top.join(files.groupBy("repo").agg(F.sum("size").cast("long").alias("total_bytes")), "repo")


def blob_sha(content):
    """The id that git gives a blob."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def dead_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Blobs (repo, sha, path, size) that no working file holds.

    ``files`` has the column blob, which the source of working trees computes for files of any
    size, or else content; where neither tells a file's blob the query fails, as it could order
    the deletion of a living file.
    """
    sha = F.col("blob") if "blob" in files.columns else blob_sha(F.col("content"))
    known = F.when(sha.isNull(), F.raise_error(F.concat(F.lit("no blob id of "), "repo", F.lit("/"), "path"))).otherwise(sha)
    return blobs.join(files.select("repo", known.alias("sha")).distinct(), ["repo", "sha"], "left_anti")


def heavy_blobs(dead: DataFrame, limit: int = 20) -> DataFrame:
    """The largest dead blobs of each repo, and the bytes of all of them."""
    w = Window.partitionBy("repo").orderBy(F.desc("size"), "path", "sha")
    top = dead.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    return top.join(dead.groupBy("repo").agg(F.sum("size").cast("long").alias("dead_bytes")), "repo")


def file_tree(files: DataFrame, depth: int | None = None, dirs_only: bool = False, dirs: DataFrame | None = None) -> DataFrame:
    """Every directory and file: repo, path, parent, depth, is_dir, files below, bytes.

    With ``content`` in ``files``, lines too.  ``dirs`` (repo, path) adds directories that may be empty.
    """
    counted = "content" in files.columns
    lines = F.when(is_binary(F.col("content")), 0).otherwise(n_lines(F.col("content"))) if counted else F.lit(0)
    rows = files.select("repo", "path", F.lit(1).alias("n"), "size", lines.cast("long").alias("lines"), F.lit(False).alias("own_dir"))
    if dirs is not None:
        none = F.lit(0).cast("long")
        rows = rows.unionByName(dirs.select("repo", "path", F.lit(0).alias("n"), none.alias("size"), none.alias("lines"), F.lit(True).alias("own_dir")))
    parts = F.split("path", "/")
    rows = rows.select("repo", "n", "size", "lines", "own_dir", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    prefix = F.array_join(F.slice("parts", 1, F.col("depth")), "/")
    parent = F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/")
    out = rows.select("repo", prefix.alias("path"), parent.alias("parent"), F.col("depth").cast("long").alias("depth"),
                      (F.col("own_dir") | (F.col("depth") < F.size("parts"))).alias("is_dir"), "n", "size", "lines")
    if depth is not None:
        out = out.filter(F.col("depth") <= depth)
    if dirs_only:
        out = out.filter("is_dir")
    total = [F.sum("n").cast("long").alias("files"), F.sum("size").cast("long").alias("bytes")] + [F.sum("lines").cast("long").alias("lines")] * counted
    return out.groupBy("repo", "path", "parent", "depth", "is_dir").agg(*total)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two snapshots (path, size, mtime; by repo where they have one): added, removed or changed."""
    b, a = before.alias("b"), after.alias("a")
    keys = [k for k in ("repo", "path") if k in before.columns]
    kind = F.when(F.col("b.path").isNull(), "added").when(F.col("a.path").isNull(), "removed").otherwise("changed")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime")) & F.col("a.path").eqNullSafe(F.col("b.path"))
    return b.join(a, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer").filter(~same).select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], kind.alias("change"))


def gather_receipts(files: DataFrame, patterns: tuple[str, ...] = ("*.md",), cap: int | None = None, skip_binary: bool = True) -> DataFrame:
    """Files that match a pattern, with a reason for each that is skipped (size first, then binary, then not UTF-8)."""
    hit = glob(F.col("path"), patterns[0])
    for p in patterns[1:]:
        hit = hit | glob(F.col("path"), p)
    size = F.octet_length("content").cast("long")
    reason = F.when(F.lit(cap is not None) & (size > (cap or 0)), "over the size cap").when(
        F.lit(skip_binary) & is_binary(F.col("content")), "binary").when(
        F.lit(skip_binary) & ~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    return files.filter(hit).select("repo", "path", size.alias("size"), reason.alias("skip_reason"), n_lines(F.col("content").cast("string")).alias("lines"))


def over_total(receipts: DataFrame, total: int) -> DataFrame:
    """Per repo the first kept file, in walk order, at which the kept bytes pass ``total``."""
    w = Window.partitionBy("repo").orderBy(F.split("path", "/"))
    up = receipts.filter("skip_reason is null").withColumn("up", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return up.filter(F.col("up") > total).groupBy("repo").agg(F.min_by("path", "up").alias("path"), F.min("up").cast("long").alias("bytes"))


class CapExceeded(ValueError):
    """More bytes would be gathered than the total cap allows."""


def gather(files: DataFrame, patterns: tuple[str, ...] = ("*.md",), cap: int | None = None, total: int | None = None, skip_binary: bool = True) -> DataFrame:
    """repo, path, section: each kept file under a heading, ended by a marker; in order of split(path, '/') they are the gathered text.

    Beyond ``total`` bytes in a repo, CapExceeded names the file at which they pass.
    """
    receipts = gather_receipts(files, patterns, cap, skip_binary)
    if total is not None and (first := over_total(receipts, total).orderBy("repo").head()):
        raise CapExceeded(f"more than {total} bytes at {first['repo']}/{first['path']}")
    text = F.col("content").cast("string")
    section = F.concat(F.lit("\n## "), "path", F.lit("\n\n"), text, F.when((text == "") | text.endswith("\n"), "").otherwise("\n"),
                       F.lit("<!-- end "), "path", F.lit(" -->\n"))
    kept = receipts.filter("skip_reason is null").select("repo", "path")
    return files.join(kept, ["repo", "path"], "left_semi").select("repo", "path", section.alias("section"))


def manifest(files: DataFrame) -> DataFrame:
    """The sha256 and size of every file, as a snapshot archive lists them."""
    return files.select("repo", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
