"""Stale, deleted, resurrected and owned files; branches.  See history for the inputs.

``files`` is the working tree (repo, path, size); ``file_events`` is repo, path, status A, M or
D, sha, date, seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import age_days, is_fix, round3, top_dir


def stale_files(changes: DataFrame, files: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Working files with the age of their last touch; with ``limit`` the oldest of each repo and their rank."""
    last = changes.groupBy("repo", "path").agg(F.min_by(F.struct("author_time", "sha", "author_date"), "seq").alias("t"))
    out = last.join(files.select("repo", "path"), ["repo", "path"]).select(
        "repo", "path", F.col("t.sha").alias("last_sha"), F.col("t.author_date").alias("last_date"), age_days(F.col("t.author_time"), now).alias("age_days"))
    if limit is None:
        return out
    w = Window.partitionBy("repo").orderBy(F.desc("age_days"), "path")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def branch_hygiene(branches: DataFrame, now: int, stale_after: int | None = None) -> DataFrame:
    """Branches with age and whether they are stale (older than ``stale_after`` days, if given)."""
    age = age_days(F.col("last_time"), now)
    return branches.select("repo", "name", "author", age.alias("age_days"), "merged", "gone_upstream",
                           (F.lit(False) if stale_after is None else age > stale_after).alias("stale"))


def deleted_files(file_events: DataFrame) -> DataFrame:
    """The newest deletion of each path."""
    return file_events.filter("status = 'D'").groupBy("repo", "path").agg(
        F.min("seq").alias("seq"), F.min_by("sha", "seq").alias("sha"), F.min_by("date", "seq").alias("date"), F.min_by("author", "seq").alias("author"))


def deleted_paths(file_events: DataFrame, files: DataFrame) -> DataFrame:
    """Deaths of paths that the working tree does not have now."""
    return deleted_files(file_events).join(files.select("repo", "path"), ["repo", "path"], "left_anti")


def resurrections(file_events: DataFrame) -> DataFrame:
    """Paths that came back: deaths, rebirths, last dates, whether alive."""
    w = Window.partitionBy("repo", "path").orderBy(F.desc("seq"))
    e = file_events.filter("status in ('A', 'D')").withColumn("was", F.lag("status").over(w)).withColumn(
        "reborn", F.coalesce((F.col("status") == "A") & (F.col("was") == "D"), F.lit(False)))
    out = e.groupBy("repo", "path").agg(
        F.sum((F.col("status") == "D").cast("long")).alias("deaths"), F.sum(F.col("reborn").cast("long")).alias("rebirths"),
        F.min_by(F.when(F.col("status") == "D", F.col("date")), F.when(F.col("status") == "D", F.col("seq"))).alias("last_died"),
        F.min_by(F.when(F.col("reborn"), F.col("date")), F.when(F.col("reborn"), F.col("seq"))).alias("last_raised"),
        (F.min_by("status", "seq") != "D").alias("alive"))
    return out.filter("rebirths > 0")


def repeat_fixes(changes: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """Living paths with ``least`` fixes or more."""
    fix = is_fix(F.col("subject"))
    n = changes.join(files.select("repo", "path"), ["repo", "path"], "left_semi").groupBy("repo", "path").agg(
        F.sum(fix.cast("long")).alias("fixes"), F.count("*").alias("commits"),
        F.min_by(F.when(fix, F.col("author_date")), F.when(fix, F.col("seq"))).alias("last_fix"))
    return n.filter(F.col("fixes") >= least)


def _owned(tally: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "author_name")
    t = tally.select(*keys, "author_name", "n", F.row_number().over(w).alias("r"), F.sum("n").over(Window.partitionBy(*keys)).alias("commits"))
    share = round3(F.col("n") / F.col("commits"))
    return t.filter("r = 1").select(*keys, F.col("author_name").alias("owner"), "commits", share.alias("share"), (share >= threshold).alias("possessed"))


def ownership(changes: DataFrame, files: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The owner of each living path: most commits, ties by name."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    tally = changes.join(files.select("repo", "path"), ["repo", "path"], "left_semi").groupBy("repo", "path", "author_name").agg(F.count("*").alias("n"))
    return _owned(tally, ["repo", "path"], threshold)


def ownership_by_dir(changes: DataFrame, files: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The same for top directories, from the living paths, with their number of files."""
    living = changes.join(files.select("repo", "path"), ["repo", "path"], "left_semi").withColumn("dir", top_dir(F.col("path")))
    tally = living.groupBy("repo", "dir", "author_name").agg(F.count("*").alias("n"))
    n = living.groupBy("repo", "dir").agg(F.count_distinct("path").alias("files"))
    return _owned(tally, ["repo", "dir"], threshold).join(n, ["repo", "dir"])
