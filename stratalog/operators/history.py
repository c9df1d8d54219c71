"""Analyses of the commit log.

Inputs are ``commits`` (repo, sha, author_name, author_email, author_time, author_date,
subject, seq) and ``file_changes`` (the same columns, path, insertions, deletions).  ``seq`` is
the place in the log, 0 for the newest; "first" and "last" go by it, never by date.  All group
by ``repo``, so one run covers a fleet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import age_days, identity, is_fix, round3


def _sum(c: str):
    return F.sum(F.coalesce(c, F.lit(0))).cast("long")


def commit_history(commits: DataFrame, changes: DataFrame, max_count: int | None = None) -> DataFrame:
    """Commits with their churn; per repo the newest ``max_count``."""
    c = commits if max_count is None else commits.filter(F.col("seq") < max_count)
    churn = changes.groupBy("repo", "sha").agg(
        F.count("*").alias("files_changed"), _sum("insertions").alias("insertions"), _sum("deletions").alias("deletions"))
    return c.join(churn, ["repo", "sha"], "left").select(
        "repo", "sha", "seq", "author_date", "author_name", "subject",
        *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("files_changed", "insertions", "deletions")])


def contributors(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Per identity: name (of its newest commit), commits, churn, first and last date, and rank."""
    who = commits.groupBy("repo", identity().alias("who")).agg(
        F.count("*").alias("commits"), F.min_by("author_name", "seq").alias("name"), F.min("seq").alias("newest"),
        F.max_by("author_date", "seq").alias("first_seen"), F.min_by("author_date", "seq").alias("last_seen"))
    churn = changes.groupBy("repo", identity().alias("who")).agg(_sum("insertions").alias("insertions"), _sum("deletions").alias("deletions"))
    rank = Window.partitionBy("repo").orderBy(F.desc("commits"), F.lower("name"), "newest")
    return who.join(churn, ["repo", "who"], "left").select(
        "repo", F.row_number().over(rank).cast("long").alias("rank"), "who", "name", "commits",
        F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), "first_seen", "last_seen")


def bus_factor(commits: DataFrame) -> DataFrame:
    """The fewest contributors that hold more than half of a repo's commits."""
    n = commits.groupBy("repo", identity().alias("who")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo").orderBy(F.desc("n"), "who")
    run = n.select("repo", "n", F.row_number().over(w).alias("rank"),
                   F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("up"), F.sum("n").over(Window.partitionBy("repo")).alias("total"))
    return run.groupBy("repo").agg(F.min(F.when(F.col("up") * 2 > F.col("total"), F.col("rank"))).cast("long").alias("bus_factor"),
                                   F.max("total").cast("long").alias("total_commits"))


def activity_grid(commits: DataFrame) -> DataFrame:
    """Commits by weekday (0 is Monday) and hour of the recorded wall clock; the peak is marked."""
    n = (commits.groupBy("repo", F.weekday(F.to_date(F.substring("author_date", 1, 10))).cast("long").alias("weekday"),
                         F.substring("author_date", 12, 2).cast("long").alias("hour")).agg(F.count("*").alias("commits")))
    w = Window.partitionBy("repo").orderBy(F.desc("commits"), "weekday", "hour")
    return n.withColumn("peak", F.row_number().over(w) == 1)


def commits_in_cell(commits: DataFrame, weekday: int, hour: int) -> DataFrame:
    """The commits of one cell of the grid."""
    return commits.filter((F.weekday(F.to_date(F.substring("author_date", 1, 10))) == weekday) & (F.substring("author_date", 12, 2).cast("int") == hour))


def hotspots(changes: DataFrame, limit: int = 20) -> DataFrame:
    """The paths of most commits, then churn, per repo."""
    n = changes.groupBy("repo", "path").agg(F.count("*").alias("commits"), _sum("insertions").alias("insertions"), _sum("deletions").alias("deletions"))
    n = n.withColumn("churn", F.col("insertions") + F.col("deletions"))
    w = Window.partitionBy("repo").orderBy(F.desc("commits"), F.desc("churn"), "path")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def file_dossier(changes: DataFrame, paths: list[str]) -> DataFrame:
    """Per author of the given paths: commits, share and churn, and when the path began."""
    c = changes.filter(F.col("path").isin(paths))
    by = c.groupBy("repo", "path", "author_name").agg(F.count("*").alias("commits"), _sum("insertions").alias("insertions"), _sum("deletions").alias("deletions"))
    all_ = c.groupBy("repo", "path").agg(F.count("*").alias("total"), F.max_by("author_date", "seq").alias("created"), F.min_by("author_date", "seq").alias("touched"))
    return by.join(all_, ["repo", "path"]).select(
        "repo", "path", "author_name", "commits", round3(F.col("commits") / F.col("total")).alias("share"), "insertions", "deletions", "created", "touched")


def dossiers(changes: DataFrame, files: DataFrame, blame: DataFrame | None = None, former: DataFrame | None = None, now: int = 0) -> DataFrame:
    """One row per path: whether it exists, when and by which commit it began, commits, churn and authors.

    With ``blame`` (repo, path, line, author_time) the ages of its lines, with ``former`` (repo,
    path, name, place) the names it had, the newest first.  ``changes`` of one path, read with
    the option follow, carry its history over renames.
    """
    one = changes.groupBy("repo", "path").agg(
        F.max_by(F.struct("author_date", "sha"), "seq").alias("b"), F.count("*").alias("commits"), _sum("insertions").alias("insertions"),
        _sum("deletions").alias("deletions"), F.count_distinct("author_name").alias("authors"))
    living = files.select("repo", "path").distinct().withColumn("found", F.lit(True))
    out = one.join(living, ["repo", "path"], "left").select(
        "repo", "path", F.coalesce("found", F.lit(False)).alias("exists"), F.col("b.author_date").alias("created"), F.col("b.sha").alias("created_sha"),
        "commits", "insertions", "deletions", "authors")
    if former is not None:
        names = former.groupBy("repo", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("former_names"))
        out = out.join(names, ["repo", "path"], "left").withColumn("former_names", F.coalesce("former_names", F.lit("")))
    return out if blame is None else out.join(blame_ages(blame, now), ["repo", "path"], "left")


def dossier_of(changes: DataFrame, paths: list[str], **parts) -> DataFrame:
    """``dossiers`` of the given paths; a path that no commit ever touched is an error."""
    own = changes.filter(F.col("path").isin(paths))
    known = {r["path"] for r in own.select("path").distinct().collect()}
    if missing := [p for p in paths if p not in known]:
        raise KeyError(f"no history of {', '.join(missing)}")
    return dossiers(own, **parts)


def blame_ages(blame: DataFrame, now: int) -> DataFrame:
    """Per path: lines, and days since the oldest, newest and upper median line.

    Lines are counted per time first, so that a path's lines never meet in one row.
    """
    keys = [c for c in ("repo", "path") if c in blame.columns]
    n = blame.groupBy(*keys, "author_time").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    n = n.withColumn("up", F.sum("n").over(w.orderBy("author_time"))).withColumn("lines", F.sum("n").over(w))
    middle = F.min(F.when(F.col("up") > F.floor(F.col("lines") / 2), F.col("author_time")))
    return n.groupBy(*keys).agg(F.max("lines").alias("lines"), age_days(F.min("author_time"), now).alias("oldest_days"),
                                age_days(F.max("author_time"), now).alias("newest_days"), age_days(middle, now).alias("median_days"))


def repo_card(commits: DataFrame, now: int) -> DataFrame:
    """One row per repo: born, last, age, commits, contributors, last words, peak hour."""
    card = commits.groupBy("repo").agg(
        F.max_by("author_date", "seq").alias("born"), F.min_by("author_date", "seq").alias("last"), F.max_by("author_time", "seq").alias("born_time"),
        F.count("*").alias("commits"), F.count_distinct(identity()).alias("contributors"), F.min_by("subject", "seq").alias("last_words"))
    days = F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")))
    peak = activity_grid(commits).filter("peak").select("repo", F.concat(
        F.element_at(days, (F.col("weekday") + 1).cast("int")), F.lit(" "), F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")).alias("peak"))
    return card.join(peak, "repo").select("repo", "born", "last", age_days(F.col("born_time"), now).alias("age_days"), "commits", "contributors", "last_words", "peak")


def release_history(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """The release of each commit: the nearest tag at or after it in time, or "Unreleased"."""
    names = tags.groupBy("repo", "sha").agg(F.max("name").alias("tag"))
    w = Window.partitionBy("repo").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    c = commits.join(names, ["repo", "sha"], "left")
    return c.select("repo", "sha", "seq", "subject", F.coalesce(F.last("tag", ignorenulls=True).over(w), F.lit("Unreleased")).alias("release"))


#: What a conventional prefix stands for in a changelog.
PREFIXES = {"feat": "Added", "add": "Added", "fix": "Fixed", "bug": "Fixed", "hotfix": "Fixed", "remove": "Removed",
            "revert": "Removed", "deprecate": "Deprecated", "security": "Security", "sec": "Security"}


def classify(subject) -> tuple:
    """(section, breaking) of a subject."""
    kind = F.lower(F.regexp_extract(subject, r"^([A-Za-z]+)(\([^)]*\))?(!)?:\s", 1))
    bang = F.regexp_extract(subject, r"^([A-Za-z]+)(\([^)]*\))?(!)?:\s", 3) == "!"
    table = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    return F.coalesce(table[kind], F.lit("Changed")), F.when(kind == "", subject.contains("BREAKING")).otherwise(bang)


def changelog_entries(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Commits since each repo's newest tag, with section and whether they break."""
    edge = commits.join(tags.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi").groupBy("repo").agg(F.min("seq").alias("edge"))
    section, breaking = classify(F.col("subject"))
    return (commits.join(edge, "repo", "left").filter("edge is null or seq < edge")
            .select("repo", "sha", "seq", "subject", section.alias("section"), breaking.alias("breaking")))


def changelog_draft(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Per repo: commits since the newest tag and the bump that they ask for."""
    e = changelog_entries(commits, tags).groupBy("repo").agg(
        F.count("*").alias("commits"), F.bool_or("breaking").alias("b"), F.bool_or(F.col("section").isin("Added", "Removed")).alias("m"))
    return commits.select("repo").distinct().join(e, "repo", "left").select(
        "repo", F.coalesce("commits", F.lit(0)).cast("long").alias("commits"),
        F.when(F.col("b"), "major").when(F.col("m"), "minor").when(F.col("commits") > 0, "patch").otherwise("none").alias("bump"))


def compare(inside: DataFrame, changes: DataFrame, before: DataFrame) -> DataFrame:
    """Totals of the commits ``inside`` a range and its first-time contributors.

    ``inside`` and ``changes`` are what the newer ref reaches and the older doesn't (the source's
    option ref "A..B"), ``before`` what the older reaches.
    """
    old = before.select("repo", identity().alias("who")).distinct()
    new = inside.select("repo", identity().alias("who"), "author_name").join(old, ["repo", "who"], "left_anti").groupBy("repo").agg(
        F.array_join(F.array_sort(F.collect_set("author_name")), ",").alias("new_contributors"))
    total = inside.groupBy("repo").agg(F.count("*").alias("commits"), F.count_distinct(identity()).alias("contributors"))
    churn = changes.groupBy("repo").agg(_sum("insertions").alias("insertions"), _sum("deletions").alias("deletions"), F.count_distinct("path").alias("files"))
    return total.join(churn, "repo", "left").join(new, "repo", "left").select(
        "repo", "commits", "contributors", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("insertions", "deletions", "files")],
        F.coalesce("new_contributors", F.lit("")).alias("new_contributors"))


def compare_refs(commits: DataFrame, changes: DataFrame, newest: int, oldest: int) -> DataFrame:
    """``compare`` of the commits ``newest`` <= seq < ``oldest`` of a log without merges."""
    inside = (F.col("seq") >= newest) & (F.col("seq") < oldest)
    return compare(commits.filter(inside), changes.filter(inside), commits.filter(F.col("seq") >= oldest))


def compare_contributors(inside: DataFrame, before: DataFrame) -> DataFrame:
    """repo, rank, name, commits, is_new: who wrote the commits of a range, by identity, named as in the newest of them."""
    old = before.select("repo", identity().alias("who")).distinct().withColumn("known", F.lit(True))
    n = inside.groupBy("repo", identity().alias("who")).agg(F.count("*").alias("commits"), F.min_by("author_name", "seq").alias("name"), F.min("seq").alias("newest"))
    w = Window.partitionBy("repo").orderBy(F.desc("commits"), F.lower("name"), "newest")
    return n.join(old, ["repo", "who"], "left").select("repo", F.row_number().over(w).cast("long").alias("rank"), "name", "commits", F.col("known").isNull().alias("is_new"))


def compare_files(changes: DataFrame, newest: int, oldest: int) -> DataFrame:
    """Churn of each path in the range."""
    c = changes.filter((F.col("seq") >= newest) & (F.col("seq") < oldest))
    return c.groupBy("repo", "path").agg(_sum("insertions").alias("insertions"), _sum("deletions").alias("deletions"))


# The prefixes that count as conventional, and words of a fix's subject that are no theme.
CONVENTIONAL = ("feat", "fix", "chore", "docs", "refactor", "test", "style", "perf", "build", "ci")
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "bug", "by", "fix", "fixed", "fixes", "for", "from", "in", "is", "it", "its", "not", "now", "of",
    "on", "or", "that", "the", "this", "to", "was", "when", "with",
)
THEME = "[a-z][a-z0-9_-]{2,}"


def commit_prefixes(commits: DataFrame) -> DataFrame:
    """Per repo: how often each conventional prefix occurs, and the share of conventional subjects."""
    kind = F.regexp_extract("subject", r"^(" + "|".join(CONVENTIONAL) + r")(\(.+\))?!?:", 1)
    n = commits.groupBy("repo", kind.alias("prefix")).agg(F.count("*").alias("commits"))
    all_ = commits.groupBy("repo").agg(F.count("*").alias("total"), F.sum((kind != "").cast("int")).alias("conventional"))
    return n.filter("prefix <> ''").join(all_, "repo").select("repo", "prefix", "commits", round3(F.col("conventional") / F.col("total")).alias("conventional_share"))


def fix_themes(commits: DataFrame, stop: tuple[str, ...] = STOP_WORDS, limit: int = 10) -> DataFrame:
    """Words that stand more than once in subjects of fixes; ties go to the word met first."""
    words = commits.filter(is_fix(F.col("subject"))).select("repo", "seq", F.posexplode(F.regexp_extract_all(F.lower("subject"), F.lit(THEME), F.lit(0))).alias("pos", "word"))
    n = words.filter(~F.col("word").isin(*stop)).groupBy("repo", "word").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("met"))
    w = Window.partitionBy("repo").orderBy(F.desc("n"), "met")
    return n.filter("n > 1").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit).select("repo", "rank", "word", "n")


def trace_origin(versions: DataFrame, needle: str) -> DataFrame:
    """Commits that change how often ``needle`` stands in a path; versions: repo, path, seq, sha, content."""
    n = F.size(F.split("content", r"\Q" + needle.replace(r"\E", "") + r"\E")) - 1
    w = Window.partitionBy("repo", "path").orderBy(F.desc("seq"))
    v = versions.select("repo", "path", "seq", "sha", F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    v = v.withColumn("was", F.coalesce(F.lag("n").over(w), F.lit(0)).cast("long")).filter("n <> was")
    first = Window.partitionBy("repo").orderBy(F.desc("seq"), "path")
    return v.select("repo", "path", "seq", "sha", "n", "was", (F.row_number().over(first) == 1).alias("origin"))
