"""Scores: risk, forecast, portrait, purge plan, triage and policy gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import age_days, is_fix, parse_duration, round3, top_dir
from . import history
from .secret_rules import severity_gate, severity_rank

#: Weights of the risk score's parts.
WEIGHTS = {"churn": 0.4, "bug": 0.3, "age": 0.2, "size": 0.1}
HALF_LIFE = 90


def risk_scores(changes: DataFrame, files: DataFrame, now: int, weights: dict[str, float] = WEIGHTS, lens: str | None = None) -> DataFrame:
    """Living paths with churn, bug, age and size scores (each 0 to 1) and their weighted blend, or one lens."""
    if set(weights) - set(WEIGHTS) or min(weights.values()) < 0 or not sum(weights.values()):
        raise ValueError("weights are of churn, bug, age and size, none negative, not all 0")
    n = changes.groupBy("repo", "path").agg(
        F.count("*").alias("commits"), F.sum(is_fix(F.col("subject")).cast("long")).alias("bug_commits"), F.min_by("author_time", "seq").alias("touched"))
    n = n.join(files, ["repo", "path"]).withColumn("age_days", age_days(F.col("touched"), now))
    top = n.groupBy("repo").agg(F.max("commits").alias("mc"), F.max("bug_commits").alias("mb"), F.max("size").alias("ms"))
    share = lambda a, b: F.when(F.col(b) > 0, round3(F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    s = n.join(top, "repo").select(
        "repo", "path", "commits", "bug_commits", "age_days", "size", share("commits", "mc").alias("churn_score"), share("bug_commits", "mb").alias("bug_score"),
        round3(F.pow(F.lit(0.5), F.col("age_days") / HALF_LIFE)).alias("age_score"), share("size", "ms").alias("size_score"))
    if lens:
        return s.withColumn("score", F.col(f"{lens}_score"))
    w = {k: weights.get(k, 0.0) for k in WEIGHTS}
    blend = sum((F.col(f"{k}_score") * v for k, v in w.items()), F.lit(0.0)) / sum(w.values())
    return s.withColumn("score", round3(blend))


def attention_forecast(changes: DataFrame, files: DataFrame, now: int, horizon: int = 90) -> DataFrame:
    """Living paths by decayed heat, momentum and momentum of fixes."""
    if horizon <= 0:
        raise ValueError("the horizon is over 0 days")
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("author_time")) / F.lit(86400.0))
    c = changes.join(files.select("repo", "path"), ["repo", "path"], "left_semi").withColumn("age", age).withColumn("fix", is_fix(F.col("subject")))
    recent, prior = F.col("age") <= horizon, (F.col("age") > horizon) & (F.col("age") <= 2 * horizon)
    n = c.groupBy("repo", "path").agg(
        F.sum(F.pow(F.lit(0.5), F.col("age") / horizon)).alias("heat"), F.sum(recent.cast("long")).alias("recent"), F.sum(prior.cast("long")).alias("prior"),
        F.sum((recent & F.col("fix")).cast("long")).alias("fixes"), F.min_by("author_date", "seq").alias("last_touch"))
    top = n.groupBy("repo").agg(F.max("heat").alias("most"))
    heat = F.when(F.col("most") > 0, round3(F.col("heat") / F.col("most"))).otherwise(F.lit(0.0))
    momentum = F.when(F.col("recent") + F.col("prior") > 0, round3(F.col("recent") / (F.col("recent") + F.col("prior")))).otherwise(F.lit(0.0))
    bugs = F.when(F.col("recent") > 0, round3(F.col("fixes") / F.col("recent"))).otherwise(F.lit(0.0))
    out = n.join(top, "repo").select("repo", "path", "recent", "prior", "last_touch", heat.alias("heat"), momentum.alias("momentum"), bugs.alias("bug_momentum"))
    return out.withColumn("score", round3(F.col("heat") * 0.5 + F.col("momentum") * 0.3 + F.col("bug_momentum") * 0.2))


def repo_portrait(files: DataFrame, limit: int = 10) -> DataFrame:
    """The largest top directories of each repo by bytes."""
    n = files.groupBy("repo", top_dir(F.col("path")).alias("dir")).agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("files"))
    w = Window.partitionBy("repo").orderBy(F.desc("bytes"), "dir")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def portrait(commits: DataFrame, changes: DataFrame, files: DataFrame, now: int) -> dict[str, DataFrame]:
    """The parts of a portrait, by name: people (eight), activity, slices of the tree, bus factor and vitals."""
    return {
        "people": history.contributors(commits, changes).filter("rank <= 8"), "activity": history.activity_grid(commits), "slices": repo_portrait(files),
        "bus_factor": history.bus_factor(commits), "vitals": history.repo_card(commits, now),
    }


#: Bytes from which a dead blob is worth a rewrite.
WORTH = 1 << 20
WARNINGS = (
    "a rewrite gives every commit after the oldest touched one a new id",
    "change leaked secrets first: they are known, wherever they are removed from",
    "work on a fresh clone and keep a copy; a rewrite can't be taken back",
    "everyone who has a clone or a fork must rebase or clone again",
)


def purge_plan(dead_blobs: DataFrame, findings: DataFrame, least: int = WORTH) -> DataFrame:
    """What a history rewrite would remove: dead blobs of ``least`` bytes, and paths of findings that no blob names."""
    blobs = dead_blobs.filter(F.col("size") >= least).select("repo", "path", "size", F.lit("blob").alias("reason"))
    first = findings.groupBy("repo", "path").agg(F.min_by("rule", F.struct(severity_rank(F.col("severity")), "line", "rule")).alias("rule"))
    first = first.select("repo", "path", F.lit(0).cast("long").alias("size"), F.concat(F.lit("secret "), "rule").alias("reason"))
    return blobs.unionByName(first.join(blobs.select("repo", "path").distinct(), ["repo", "path"], "left_anti"))


def _shown(word: str) -> str:
    return f'"{word}"' if " " in word else word


def purge_commands(targets: list[tuple[str, str]], least: int = WORTH) -> list[str]:
    """Command lines of a repo's plan (path, reason) for two tools; they are printed, never run."""
    if not targets:
        return []
    paths = sorted({p for p, _ in targets})
    unit = next((f"{least // n}{label}" for n, label in ((1 << 30, "G"), (1 << 20, "M"), (1 << 10, "K")) if least % n == 0), str(least))
    out = ["git filter-repo --invert-paths " + " ".join(f"--path {_shown(p)}" for p in paths)]
    out += [f"git filter-repo --strip-blobs-bigger-than {unit}"] * any(r == "blob" for _, r in targets)
    return [*out, "bfg " + " ".join(f"--delete-files {_shown(n)}" for n in sorted({p.rsplit("/", 1)[-1] for p in paths}))]


def triage_board(risk: DataFrame, stale: DataFrame, findings: DataFrame | None = None, audit: DataFrame | None = None) -> DataFrame:
    """Findings, risky files, afflicted dependencies and stale files on one scale."""
    severity = {
        "risk": (risk.filter("score >= 0.4"), F.col("path"), lambda df: F.col("score") * 0.9),
        "stale": (stale.filter("age_days >= 180"), F.col("path"), lambda df: F.least(F.lit(0.4), F.col("age_days") / 3650 * 0.4)),
    }
    if findings is not None:
        level = F.when(F.col("severity") == "high", 1.0).when(F.col("severity") == "medium", 0.75).otherwise(0.5)
        severity["secret"] = (findings.filter(~F.col("suppressed")), F.col("path"), lambda df: level)
    if audit is not None:
        each = audit.filter("ids <> ''").withColumn("id", F.explode(F.split("ids", " ")))
        severity["dependency"] = (each, F.concat_ws(" ", "name", "version", "id"), lambda df: F.lit(0.9))
    parts = [df.select("repo", F.lit(name).alias("source"), subject.alias("subject"), round3(at(df)).alias("severity")) for name, (df, subject, at) in severity.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate_checks(policy: dict, findings: DataFrame | None = None, risk: DataFrame | None = None, audit: DataFrame | None = None,
                stale: DataFrame | None = None, skills: DataFrame | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The checks that a policy (settings' gate) asks for, each giving its violations.

    ``skills`` are the stale stamps.  A check whose table is missing fails when it is run.
    """
    checks: dict[str, Callable[[], DataFrame]] = {}
    if (level := policy.get("secrets", "off")) != "off":
        checks["secrets"] = lambda: severity_gate(findings, level)
    if (least := policy.get("risk")) is not None:
        checks["risk"] = lambda: risk.filter(F.col("score") >= least)
    if policy.get("advisories", "off") != "off":
        checks["advisories"] = lambda: audit.filter("ids <> ''")
    if age := policy.get("stale"):
        checks["stale"] = lambda: stale.filter(F.col("age_days") > parse_duration(age) // 86400)
    if folders := policy.get("skills"):
        checks["skills"] = lambda: skills.filter(F.col("path").isin([f"{f}/SKILL.md" for f in folders]))
    return checks


def policy_gate(spark, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """check, held, detail: each check passes if its DataFrame of violations is empty.

    A check that fails to run counts as broken (it fails closed).
    """
    rows = []
    for name, run in checks.items():
        try:
            n = run().count()
            rows.append((name, n == 0, f"{n} violations" if n else "clean"))
        except Exception as error:  # fail closed
            rows.append((name, False, f"check failed: {type(error).__name__}"))
    return spark.createDataFrame(rows, "check string, held boolean, detail string")
