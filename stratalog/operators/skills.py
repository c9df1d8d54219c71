"""Skill folders: those that hold a SKILL.md, their names, files and index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .files import is_binary

#: The file that marks a skill folder.
MARKER = "SKILL.md"


def skill_description(content: Column) -> Column:
    """The description in the front matter's first ten lines, without its quotes, pipes escaped."""
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 10), "\n")
    found = F.trim(F.regexp_extract(head, r"(?m)^description:[ \t]*\"?(.*?)\"?[ \t]*\r?$", 1))
    return F.replace(found, F.lit("|"), F.lit("\\|"))


def _above(path: Column, least: int) -> Column:
    """One row for each folder above the last ``least`` segments of a path; "" is the root."""
    parts = F.split(path, "/")
    return F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - least)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def skill_folders(files: DataFrame) -> DataFrame:
    """repo, dir, description: the topmost folders that hold a marker; a folder travels whole, so one inside another is no skill."""
    own = files.filter((F.col("path") == MARKER) | F.col("path").endswith(f"/{MARKER}")).select(
        "repo", F.regexp_replace("path", rf"/?{MARKER}$".replace(".", r"\."), "").alias("dir"), skill_description(F.col("content")).alias("description"))
    inside = own.filter("dir <> ''").select("repo", "dir", _above(F.col("dir"), 1).alias("above")).filter("above <> dir")
    nested = inside.join(own.select("repo", F.col("dir").alias("above")), ["repo", "above"], "left_semi").select("repo", "dir").distinct()
    return own.join(nested, ["repo", "dir"], "left_anti")


def skill_files(files: DataFrame) -> DataFrame:
    """repo, dir, path, file (below dir), binary: what travels with each skill."""
    f = files.select("repo", "path", F.coalesce(is_binary(F.col("content")), F.lit(True)).alias("binary"), _above(F.col("path"), 1).alias("dir"))
    return f.join(skill_folders(files).select("repo", "dir"), ["repo", "dir"], "left_semi").select(
        "repo", "dir", "path", F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)")).alias("file"), "binary")


def collect_skills(files: DataFrame) -> DataFrame:
    """repo, dir, name, description, files, binaries: one row for each skill.

    A skill is named after its folder (the root after its repo); of equal names in a repo, and of
    the marker's own, all but the first by path get a number.
    """
    n = skill_files(files).groupBy("repo", "dir").agg(
        F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("binary"), F.col("file")))), ",").alias("binaries"))
    base = F.when(F.col("dir") == "", F.regexp_replace("repo", r"^.*/|\.git$", "")).otherwise(F.substring_index("dir", "/", -1))
    order = Window.partitionBy("repo", "base").orderBy(F.split("dir", "/"))
    place = F.row_number().over(order) + (F.col("base") == MARKER).cast("int")
    found = skill_folders(files).withColumn("base", base).withColumn("k", place).join(n, ["repo", "dir"])
    # a number that gives the name of another folder goes on to the next free one
    taken = found.groupBy("repo").agg(F.collect_set(F.when(F.col("k") == 1, F.col("base"))).alias("taken"))
    free = F.filter(F.transform(F.sequence(F.lit(2), F.col("k") + F.size("taken") + 1), lambda i: F.concat("base", F.lit("-"), i.cast("string"))),
                    lambda x: ~F.array_contains("taken", x))
    name = F.when(F.col("k") == 1, F.col("base")).otherwise(F.get(free, F.col("k") - 2))
    return found.join(taken, "repo").select("repo", "dir", name.alias("name"), "description", "files", "binaries")
