"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import FIX_WORDS, round3 as r3, unsafe_path as s_unsafe
from ..operators import blocks, deps, files as fs, history as h, hygiene as hy, outline, pack, profile, risk, secret_rules as sr, skills
from .views import _PATH, NOW, sql, view

#: name -> (query, SQL or None)
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _add(name: str, oracle: str | None, *views: str):
    """Registers ``run(*views)`` as a query; ``oracle`` follows the views' ``with`` clause."""
    def wrap(run):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(*[view(spark, sf_dir, v) for v in views])

        _FOUND[name] = (query, f"{sql(*views)} {oracle}" if oracle else None)
        return run

    return wrap


WHO = "coalesce(nullif(author_email, ''), author_name)"
FIX = "regexp_matches(subject, '" + FIX_WORDS + "')"
R3 = lambda x: f"floor(({x}) * 1000 + 0.5) / 1000"
AGE = lambda t: f"cast(case when {t} is not null then greatest(0, floor(({NOW} - {t}) / 86400)) end as bigint)"
LIVE = "(repo, path) in (select repo, path from files)"
CHURN = "cast(sum(coalesce(insertions, 0)) as bigint) as insertions, cast(sum(coalesce(deletions, 0)) as bigint) as deletions"

# ---- commit log
_add("commit_history", f""", x as (select repo, sha, count(*) as files_changed, {CHURN} from file_changes group by 1, 2)
select c.repo, c.sha, c.seq, c.author_date, c.author_name, c.subject, coalesce(files_changed, 0) as files_changed,
  coalesce(insertions, 0) as insertions, coalesce(deletions, 0) as deletions from commits c left join x using (repo, sha)""",
     "commits", "file_changes")(lambda c, f: h.commit_history(c, f))
_add("commit_history_newest", f""", x as (select repo, sha, count(*) as files_changed, {CHURN} from file_changes group by 1, 2)
select c.repo, c.sha, c.seq, c.author_date, c.author_name, c.subject, coalesce(files_changed, 0) as files_changed,
  coalesce(insertions, 0) as insertions, coalesce(deletions, 0) as deletions from commits c left join x using (repo, sha) where seq < 50""",
     "commits", "file_changes")(lambda c, f: h.commit_history(c, f, 50))
_add("contributors", f""", w as (select repo, {WHO} as who, count(*) as commits, arg_min(author_name, seq) as name, min(seq) as newest,
  arg_max(author_date, seq) as first_seen, arg_min(author_date, seq) as last_seen from commits group by 1, 2),
x as (select repo, {WHO} as who, {CHURN} from file_changes group by 1, 2)
select repo, row_number() over (partition by repo order by commits desc, lower(name), newest) as rank, who, name, commits,
  coalesce(insertions, 0) as insertions, coalesce(deletions, 0) as deletions, first_seen, last_seen from w left join x using (repo, who)""",
     "commits", "file_changes")(h.contributors)
_add("bus_factor", f""", n as (select repo, {WHO} as who, count(*) as n from commits group by 1, 2),
r as (select repo, row_number() over w as rank, sum(n) over (partition by repo order by n desc, who rows unbounded preceding) as up, sum(n) over (partition by repo) as total
  from n window w as (partition by repo order by n desc, who))
select repo, min(case when up * 2 > total then rank end) as bus_factor, cast(max(total) as bigint) as total_commits from r group by repo""", "commits")(h.bus_factor)
GRID = """g as (select repo, isodow(cast(substr(author_date, 1, 10) as date)) - 1 as weekday, cast(substr(author_date, 12, 2) as bigint) as hour, count(*) as commits
  from commits group by 1, 2, 3), gp as (select *, row_number() over (partition by repo order by commits desc, weekday, hour) = 1 as peak from g)"""
_add("activity_grid", f", {GRID} select * from gp", "commits")(h.activity_grid)
_add("commits_in_cell", "select * from commits where isodow(cast(substr(author_date, 1, 10) as date)) = 1 and cast(substr(author_date, 12, 2) as bigint) = 0", "commits")(
    lambda c: h.commits_in_cell(c, 0, 0))
HOT = f"""n as (select repo, path, count(*) as commits, {CHURN} from file_changes group by 1, 2),
hot as (select *, insertions + deletions as churn, row_number() over (partition by repo order by commits desc, insertions + deletions desc, path) as rank from n)"""
_add("hotspots", f", {HOT} select * from hot where rank <= 20", "file_changes")(h.hotspots)
DOSSIER = ("d1/f1.md", "d2/f2.js", "d3/f3")
_add("file_dossier", f""", c as (select * from file_changes where path in {DOSSIER}),
b as (select repo, path, author_name, count(*) as commits, {CHURN} from c group by 1, 2, 3),
a as (select repo, path, count(*) as total, arg_max(author_date, seq) as created, arg_min(author_date, seq) as touched from c group by 1, 2)
select repo, path, author_name, commits, {R3('commits / total')} as share, insertions, deletions, created, touched from b join a using (repo, path)""", "file_changes")(
    lambda f: h.file_dossier(f, list(DOSSIER)))
_add("blame_ages", f""", t as (select repo, path, list_sort(list(author_time)) as t from blame group by 1, 2)
select repo, path, len(t) as lines, {AGE('t[1]')} as oldest_days, {AGE('t[-1]')} as newest_days, {AGE('t[len(t) // 2 + 1]')} as median_days from t""", "blame")(
    lambda b: h.blame_ages(b, NOW))
_add("dossiers", f""", a as (select repo, path, arg_max(author_date, seq) as created, arg_max(sha, seq) as created_sha, count(*) as commits, {CHURN}, count(distinct author_name) as authors
  from file_changes group by 1, 2), t as (select repo, path, list_sort(list(author_time)) as t from blame group by 1, 2)
select repo, path, (repo, path) in (select repo, path from files) as "exists", created, created_sha, commits, insertions, deletions, authors,
  coalesce(len(t), 0) as lines, coalesce({AGE('t[1]')}, -1) as oldest_days, coalesce({AGE('t[-1]')}, -1) as newest_days, coalesce({AGE('t[len(t) // 2 + 1]')}, -1) as median_days from a left join t using (repo, path)""", "file_changes", "files", "blame")(
    lambda c, f, b: h.dossiers(c, f, b, now=NOW).fillna(0, ["lines"]).fillna(-1, ["oldest_days", "newest_days", "median_days"]))
_add("repo_card", f""", {GRID}, k as (select repo, arg_max(author_date, seq) as born, arg_min(author_date, seq) as last, arg_max(author_time, seq) as b,
  count(*) as commits, count(distinct {WHO}) as contributors, arg_min(subject, seq) as last_words from commits group by 1)
select k.repo, born, last, {AGE('b')} as age_days, k.commits, contributors, last_words,
  ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][weekday + 1] || ' ' || lpad(cast(hour as varchar), 2, '0') || ':00' as peak
from k join gp on k.repo = gp.repo and gp.peak""", "commits")(lambda c: h.repo_card(c, NOW))
_add("release_history", """, n as (select repo, sha, max(name) as tag from tags group by 1, 2)
select c.repo, c.sha, seq, subject, coalesce(last_value(tag ignore nulls) over (partition by c.repo order by seq rows unbounded preceding), 'Unreleased') as release
from commits c left join n using (repo, sha)""", "commits", "tags")(h.release_history)
_KIND = r"regexp_extract(subject, '^([A-Za-z]+)(\([^)]*\))?(!)?:\s', {})"
ENTRIES = f"""edge as (select c.repo, min(seq) as edge from commits c join (select distinct repo, sha from tags) t using (repo, sha) group by 1),
k as (select c.repo, sha, seq, subject, lower({_KIND.format(1)}) as kind, {_KIND.format(3)} = '!' as bang from commits c left join edge using (repo) where edge is null or seq < edge),
entries as (select repo, sha, seq, subject, case {' '.join(f"when kind = '{k}' then '{v}'" for k, v in h.PREFIXES.items())} else 'Changed' end as section,
  case when kind = '' then contains(subject, 'BREAKING') else bang end as breaking from k)"""
_add("changelog_entries", f", {ENTRIES} select * from entries", "commits", "tags")(h.changelog_entries)
_add("changelog_draft", f""", {ENTRIES}, e as (select repo, count(*) as n, bool_or(breaking) as b, bool_or(section in ('Added', 'Removed')) as m from entries group by 1)
select r.repo, coalesce(n, 0) as commits, case when b then 'major' when m then 'minor' when n > 0 then 'patch' else 'none' end as bump
from (select distinct repo from commits) r left join e using (repo)""", "commits", "tags")(h.changelog_draft)
_add("compare_refs", f""", c as (select *, {WHO} as who from commits where seq >= 10 and seq < 60), f as (select * from file_changes where seq >= 10 and seq < 60),
o as (select distinct repo, {WHO} as who from commits where seq >= 60),
n as (select repo, string_agg(author_name, ',' order by author_name) as new_contributors from
  (select distinct repo, author_name from c where not exists (select 1 from o where o.repo = c.repo and o.who = c.who)) group by 1),
t as (select repo, count(*) as commits, count(distinct who) as contributors from c group by 1),
x as (select repo, {CHURN}, count(distinct path) as files from f group by 1)
select t.repo, commits, contributors, coalesce(insertions, 0) as insertions, coalesce(deletions, 0) as deletions, coalesce(files, 0) as files,
  coalesce(new_contributors, '') as new_contributors from t left join x using (repo) left join n using (repo)""", "commits", "file_changes")(
    lambda c, f: h.compare_refs(c, f, 10, 60))
_add("compare_contributors", f""", i as (select *, {WHO} as who from commits where seq >= 10 and seq < 60),
n as (select repo, who, count(*) as commits, arg_min(author_name, seq) as name, min(seq) as newest from i group by 1, 2), o as (select distinct repo, {WHO} as who from commits where seq >= 60)
select repo, row_number() over (partition by repo order by commits desc, lower(name), newest) as rank, name, commits, (repo, who) not in (select repo, who from o) as is_new from n""", "commits")(
    lambda c: h.compare_contributors(c.filter("seq >= 10 and seq < 60"), c.filter("seq >= 60")))
_add("compare_files", f"select repo, path, {CHURN} from file_changes where seq >= 10 and seq < 60 group by 1, 2", "file_changes")(lambda f: h.compare_files(f, 10, 60))
_CONV = "regexp_extract(subject, '^(" + "|".join(h.CONVENTIONAL) + r")(\(.+\))?!?:', 1)"
_add("commit_prefixes", f""", k as (select repo, {_CONV} as prefix from commits), a as (select repo, count(*) as total, count(*) filter (prefix <> '') as c from k group by 1)
select k.repo, prefix, count(*) as commits, {R3('any_value(c) / any_value(total)')} as conventional_share from k join a using (repo) where prefix <> '' group by 1, 2""", "commits")(
    h.commit_prefixes)
_add("fix_themes", f""", w as (select repo, seq, unnest(regexp_extract_all(lower(subject), '{h.THEME}')) as word, generate_subscripts(regexp_extract_all(lower(subject), '{h.THEME}'), 1) as pos
  from commits where {FIX}), n as (select repo, word, count(*) as n, min((seq, pos)) as met from w
  where word not in {h.STOP_WORDS} group by 1, 2 having count(*) > 1)
select repo, rank, word, n from (select *, row_number() over (partition by repo order by n desc, met) as rank from n) where rank <= 10""", "commits")(h.fix_themes)
_add("conventional_sections", f", {ENTRIES} select repo, section, count(*) as n from entries group by 1, 2", "commits", "tags")(
    lambda c, t: h.changelog_entries(c, t).groupBy("repo", "section").agg(F.count("*").alias("n")))

# ---- hygiene
STALE = f"""l as (select repo, path, min(seq) as s, arg_min(sha, seq) as last_sha, arg_min(author_date, seq) as last_date, arg_min(author_time, seq) as t from file_changes group by 1, 2),
stale as (select repo, path, last_sha, last_date, {AGE('t')} as age_days from l where {LIVE})"""
_add("stale_files", f""", {STALE} select * from stale""", "file_changes", "files")(lambda c, f: hy.stale_files(c, f, NOW))
_add("stalest_files", f""", {STALE} select * from (select *, row_number() over (partition by repo order by age_days desc, path) as rank from stale) where rank <= 50""", "file_changes", "files")(
    lambda c, f: hy.stale_files(c, f, NOW, 50))
_add("branch_hygiene", f"select repo, name, author, {AGE('last_time')} as age_days, merged, gone_upstream, {AGE('last_time')} > 1000 as stale from branches", "branches")(
    lambda b: hy.branch_hygiene(b, NOW, 1000))
DEAD = "dead as (select repo, path, min(seq) as seq, arg_min(sha, seq) as sha, arg_min(date, seq) as date, arg_min(author, seq) as author from file_events where status = 'D' group by 1, 2)"
_add("deleted_files", f", {DEAD} select * from dead", "file_events")(hy.deleted_files)
# the tree holds the paths whose newest event is no deletion
ALIVE = "alive as (select repo, path from file_events group by 1, 2 having arg_min(status, seq) <> 'D')"
_add("deleted_paths", f", {DEAD}, {ALIVE} select * from dead where (repo, path) not in (select repo, path from alive)", "file_events")(
    lambda e: hy.deleted_paths(e, e.groupBy("repo", "path").agg(F.min_by("status", "seq").alias("last")).filter("last <> 'D'")))
_add("resurrections", """, e as (select *, coalesce(status = 'A' and lag(status) over (partition by repo, path order by seq desc) = 'D', false) as reborn
  from file_events where status in ('A', 'D'))
select repo, path, count(*) filter (status = 'D') as deaths, count(*) filter (reborn) as rebirths, arg_min(date, seq) filter (status = 'D') as last_died,
  arg_min(date, seq) filter (reborn) as last_raised, arg_min(status, seq) <> 'D' as alive from e group by 1, 2 having count(*) filter (reborn) > 0""", "file_events")(hy.resurrections)
_add("repeat_fixes", f"""select repo, path, count(*) filter ({FIX}) as fixes, count(*) as commits, arg_min(author_date, seq) filter ({FIX}) as last_fix
from file_changes where {LIVE} group by 1, 2 having count(*) filter ({FIX}) >= 3""", "file_changes", "files")(hy.repeat_fixes)
OWN = lambda keys: f"""o as (select *, row_number() over (partition by {keys} order by n desc, author_name) as r, sum(n) over (partition by {keys}) as total from t)
select {keys}, author_name as owner, cast(total as bigint) as commits, {R3('n / total')} as share, {R3('n / total')} >= 0.5 as possessed"""  # noqa: E731
_add("ownership", f", t as (select repo, path, author_name, count(*) as n from file_changes where {LIVE} group by 1, 2, 3), {OWN('repo, path')} from o where r = 1", "file_changes", "files")(
    lambda c, f: hy.ownership(c, f, 0.5))
_add("ownership_by_dir", f""", v as (select *, split_part(path, '/', 1) as dir from file_changes where {LIVE}), t as (select repo, dir, author_name, count(*) as n from v group by 1, 2, 3),
d as (select repo, dir, count(distinct path) as files from v group by 1, 2), {OWN('repo, dir')}, files from o join d using (repo, dir) where r = 1""", "file_changes", "files")(
    lambda c, f: hy.ownership_by_dir(c, f, 0.5))

# ---- scores
SHARE = lambda a, m: f"case when {m} > 0 then {R3(f'{a} / {m}')} else 0.0 end"
RISK = f"""rn as (select repo, path, count(*) as commits, count(*) filter ({FIX}) as bug_commits, {AGE('arg_min(author_time, seq)')} as age_days from file_changes group by 1, 2),
rs as (select rn.*, size from rn join files using (repo, path)), rm as (select repo, max(commits) as mc, max(bug_commits) as mb, max(size) as ms from rs group by 1),
rp as (select rs.*, {SHARE('commits', 'mc')} as churn_score, {SHARE('bug_commits', 'mb')} as bug_score, {R3('pow(0.5::double, age_days / 90.0::double)')} as age_score, {SHARE('size', 'ms')} as size_score
  from rs join rm using (repo)),
risk as (select *, {R3('(0.0::double + churn_score * 0.4::double + bug_score * 0.3::double + age_score * 0.2::double + size_score * 0.1::double) / ' + repr(sum(risk.WEIGHTS.values())) + '::double')} as score from rp)"""
_add("risk_scores", f", {RISK} select * from risk", "file_changes", "files")(lambda c, f: risk.risk_scores(c, f, NOW))
_add("risk_scores_size_lens", f", {RISK} select * exclude (score), size_score as score from risk", "file_changes", "files")(lambda c, f: risk.risk_scores(c, f, NOW, lens="size"))
_AGED = f"greatest(0.0::double, ({NOW} - author_time) / 86400.0::double)"
_add("attention_forecast", f""", c as (select *, {_AGED} as age, {FIX} as fix from file_changes where {LIVE}),
n as (select repo, path, sum(pow(0.5::double, age / 180)) as heat, count(*) filter (age <= 180) as recent, count(*) filter (age > 180 and age <= 360) as prior,
  count(*) filter (age <= 180 and fix) as fixes, arg_min(author_date, seq) as last_touch from c group by 1, 2), m as (select repo, max(heat) as most from n group by 1),
p as (select repo, path, recent, prior, last_touch, {SHARE('heat', 'most')} as heat, {SHARE('recent', '(recent + prior)')} as momentum, {SHARE('fixes', 'recent')} as bug_momentum from n join m using (repo))
select *, {R3('heat * 0.5::double + momentum * 0.3::double + bug_momentum * 0.2::double')} as score from p""", "file_changes", "files")(
    lambda c, f: risk.attention_forecast(c, f, NOW, 180))
_add("repo_portrait", """, n as (select repo, split_part(path, '/', 1) as dir, cast(sum(size) as bigint) as bytes, count(*) as files from files group by 1, 2)
select * from (select *, row_number() over (partition by repo order by bytes desc, dir) as rank from n) where rank <= 10""", "files")(risk.repo_portrait)
_add("triage_board", f""", {RISK}, {STALE} select repo, 'risk' as source, path as subject, {R3('score * 0.9::double')} as severity from risk where score >= 0.4
union all select repo, 'stale', path, {R3('least(0.4::double, age_days / 3650.0::double * 0.4::double)')} from stale where age_days >= 180""", "file_changes", "files")(
    lambda c, f: risk.triage_board(risk.risk_scores(c, f, NOW), hy.stale_files(c, f, NOW)))
MAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+[A-Za-z0-9_]"
TOKEN = r"(token|password) ?= ?\"?[0-9a-f]{16,40}\"?"
_TOKEN_SQL = TOKEN.replace(r"\"", '"')
_add("purge_plan", f""", b as (select repo, path, octet_length(encode(content)) as size, 'blob' as reason from texts where octet_length(encode(content)) >= 20000),
s as (select distinct repo, path, 0 as size, 'secret token' as reason from texts where regexp_matches(content, '{_TOKEN_SQL}'))
select repo, path, cast(size as bigint) as size, reason from b union all
select repo, path, cast(size as bigint), reason from s where (repo, path) not in (select repo, path from b)""", "texts")(lambda t: risk.purge_plan(
        t.select("repo", "path", F.octet_length("content").cast("long").alias("size")),
        sr.scan_one(t, "token", _TOKEN_SQL).withColumn("line", F.lit(1)).withColumn("severity", F.lit("high")), 20000))

# ---- files
EXT = r"coalesce(nullif(lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)), ''), '(none)')"
_LINES = "length(content) - length(replace(content, chr(10), '')) + case when content <> '' and not ends_with(content, chr(10)) then 1 else 0 end"
_LANG = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in fs.LANGUAGES.items()) + " else '' end"
_add("file_census", f""", t as (select repo, {EXT} as ext, octet_length(encode(content)) as size, {_LINES} as l from texts)
select repo, ext, count(*) as files, cast(sum(size) as bigint) as bytes, cast(sum(l) as bigint) as lines, cast(sum(size // 4) as bigint) as tokens, {_LANG} as language from t group by 1, 2""", "texts")(
    fs.file_census)
_add("census_by_size", f"select repo, {EXT} as ext, count(*) as files, cast(sum(size) as bigint) as bytes from files group by grouping sets ((repo, {EXT}), (repo))", "files")(fs.census_by_size)
WORDS = ("License", "token", "password", "Copyright")
_MARK = r"\b(" + "|".join(WORDS) + r")\b[:\s]*(.*)"
_add("markers", f""", l as (select repo, path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from texts)
select repo, path, line, regexp_extract(text, '{_MARK}', 1) as marker, substr(trim(regexp_extract(text, '{_MARK}', 2)), 1, 200) as text from l where regexp_matches(text, '{_MARK}')""", "texts")(
    lambda t: fs.markers(t, WORDS))
_BLAMED = _PATH.format(k="doc_id")
_add("markers_with_blame", f""", l as (select repo, {_BLAMED} as path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from texts),
b as (select repo, path, line, min(author) as author, min(author_time) as author_time from blame group by 1, 2, 3)
select repo, path, line, regexp_extract(text, '{_MARK}', 1) as marker, substr(trim(regexp_extract(text, '{_MARK}', 2)), 1, 200) as text, author, cast({AGE('author_time')} as varchar) as age_days
from l left join b using (repo, path, line) where regexp_matches(text, '{_MARK}')""", "texts", "blame")(
    lambda t, b: fs.markers(t.withColumn("path", F.expr(_BLAMED)), WORDS, b.groupBy("repo", "path", "line").agg(F.min("author").alias("author"), F.min("author_time").alias("author_time")), NOW).drop("author_time").withColumn("age_days", F.col("age_days").cast("string")))
_add("marker_counts", f""", l as (select repo, unnest(string_split(content, chr(10))) as text from texts)
select repo, regexp_extract(text, '{_MARK}', 1) as marker, count(*) as n from l where regexp_matches(text, '{_MARK}') group by 1, 2""", "texts")(lambda t: fs.marker_counts(t, WORDS))
_add("duplicate_files", """, s as (select repo, path, octet_length(encode(content)) as size, sha256(content) as sha256 from texts where content <> '')
select repo, sha256, size, count(*) as copies, min(path) as first_path, max(path) as last_path, (count(*) - 1) * size as reclaimable from s group by 1, 2, 3 having count(*) > 1""", "texts")(
    fs.duplicate_files)
_add("duplicate_paths", """, s as (select repo, path, octet_length(encode(content)) as size, sha256(content) as sha256 from texts where content <> ''),
g as (select repo, sha256 from s group by 1, 2 having count(*) > 1) select s.* from s join g using (repo, sha256)""", "texts")(fs.duplicate_paths)
_add("heavy_files", """, t as (select repo, cast(sum(size) as bigint) as total_bytes from files group by 1)
select f.*, total_bytes from (select *, row_number() over (partition by repo order by size desc, path) as rank from files) f join t using (repo) where rank <= 20""", "files")(fs.heavy_files)
# history holds all texts, the working tree those of up to 2000 bytes
_DEAD_BLOBS = """d as (select repo, path, octet_length(encode(content)) as size, doc_id from texts
  where sha256(content) not in (select sha256(content) from texts t where t.repo = texts.repo and octet_length(encode(content)) <= 2000))"""


def _dead(t: DataFrame) -> DataFrame:
    history = t.select("repo", fs.blob_sha(F.col("content")).alias("sha"), "path", F.octet_length("content").cast("long").alias("size"))
    return fs.dead_blobs(history, t.filter(F.octet_length("content") <= 2000))


_add("dead_blobs", f", {_DEAD_BLOBS} select repo, path, size from d", "texts")(lambda t: _dead(t).select("repo", "path", "size"))
_add("heavy_blobs", f""", {_DEAD_BLOBS}, n as (select repo, cast(sum(size) as bigint) as dead_bytes from d group by 1)
select repo, path, size, rank, dead_bytes from (select *, row_number() over (partition by repo order by size desc, path) as rank from d) join n using (repo) where rank <= 20""", "texts")(
    lambda t: fs.heavy_blobs(_dead(t)).drop("sha"))
_add("file_tree", """, p as (select repo, size, string_split(path, '/') as p, unnest(generate_series(1, len(string_split(path, '/')))) as depth from files)
select repo, array_to_string(p[1:depth], '/') as path, array_to_string(p[1:depth - 1], '/') as parent, depth, depth < len(p) as is_dir, count(*) as files, cast(sum(size) as bigint) as bytes
from p group by 1, 2, 3, 4, 5""", "files")(fs.file_tree)
_add("file_tree_with_lines", f""", p as (select repo, octet_length(encode(content)) as size, {_LINES} as l, string_split(path, '/') as p, unnest(generate_series(1, len(string_split(path, '/')))) as depth from texts)
select repo, array_to_string(p[1:depth], '/') as path, array_to_string(p[1:depth - 1], '/') as parent, depth, depth < len(p) as is_dir, count(*) as files, cast(sum(size) as bigint) as bytes,
  cast(sum(l) as bigint) as lines from p group by 1, 2, 3, 4, 5""", "texts")(lambda t: fs.file_tree(t.withColumn("size", F.octet_length("content").cast("long"))))
_add("snapshot_diff", """, b as (select repo, path, size, size % 7 as mtime from files where size % 11 <> 0), a as (select repo, path, size, case when size % 5 = 0 then 99 else size % 7 end as mtime from files where size % 13 <> 0)
select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' else 'changed' end as change from b full join a on a.repo = b.repo and a.path = b.path
where a.path is null or b.path is null or a.mtime is distinct from b.mtime or a.size is distinct from b.size""", "files")(lambda f: fs.snapshot_diff(
        f.filter("size % 11 <> 0").selectExpr("repo", "path", "size", "size % 7 as mtime"),
        f.filter("size % 13 <> 0").selectExpr("repo", "path", "size", "case when size % 5 = 0 then 99 else size % 7 end as mtime")))
GATHER = f"""g as (select repo, path, octet_length(encode(content)) as size, case when octet_length(encode(content)) > 5000 then 'over the size cap' end as skip_reason, {_LINES} as lines
  from texts where path like '%.txt')"""
_add("gather_receipts", f", {GATHER} select * from g", "texts")(lambda t: fs.gather_receipts(t, ("*.txt",), 5000))
_add("gather_over_total", f""", {GATHER}, u as (select repo, path, sum(size) over (partition by repo order by string_split(path, '/') rows unbounded preceding) as up from g where skip_reason is null)
select repo, arg_min(path, up) as path, cast(min(up) as bigint) as bytes from u where up > 30000 group by 1""", "texts")(
    lambda t: fs.over_total(fs.gather_receipts(t, ("*.txt",), 5000), 30000))
_add("gather", """select repo, path, chr(10) || '## ' || path || chr(10) || chr(10) || content || case when content = '' or ends_with(content, chr(10)) then '' else chr(10) end
  || '<!-- end ' || path || ' -->' || chr(10) as section from texts where octet_length(encode(content)) <= 5000""", "texts")(lambda t: fs.gather(t, ("*.txt",), 5000))
_add("manifest", "select repo, path, sha256(content) as sha256, octet_length(encode(content)) as size from texts", "texts")(fs.manifest)
_add("suffixes", f"select repo, path, {EXT} as ext from files", "files")(lambda f: f.select("repo", "path", fs.suffix(F.col("path")).alias("ext")))

# ---- text
_add("scan_one_rule", f""", m as (select repo, path, unnest(regexp_extract_all(content, '{MAIL}')) as m from texts)
select repo, path, 'email' as rule, case when length(m) <= 8 then substr(m, 1, 2) || '...' else substr(m, 1, 4) || '...' || right(m, 4) end as preview,
  substr(sha256('email:' || m), 1, 16) as fingerprint from m""", "texts")(lambda t: sr.scan_one(t, "email", MAIL))
_add("redact_one_rule", f"""select repo, path, regexp_replace(content, '{MAIL}', '[REDACTED:email]', 'g') as content, len(regexp_extract_all(content, '{MAIL}')) as replaced from texts""", "texts")(
    lambda t: sr.redact_one(t, "email", MAIL))
# a rule for what the tables hold, before the built-in ones; in them no two rules claim one span
_RULES = (sr.Rule("token", _TOKEN_SQL, anchors=("token", "password")), *sr.RULES)
_QUOTED = lambda r: r.pattern.replace("'", "''")
_HITS = "hits as (select repo, path, line, rule, severity, unnest(found) as m from (" + " union all ".join(
    f"select repo, path, line, '{r.name}' as rule, '{r.severity}' as severity, regexp_extract_all(text, '{_QUOTED(r)}') as found from lines" for r in _RULES if not r.redact_only) + "))"
_SCANNED = f"""lines as (select repo, path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from texts), {_HITS}"""
_MASKED = "case when length(m) <= 8 then substr(m, 1, 2) || '...' else substr(m, 1, 4) || '...' || right(m, 4) end as preview, substr(sha256(rule || ':' || m), 1, 16) as fingerprint"
_add("scan_rules", f", {_SCANNED} select repo, path, rule, severity, line, {_MASKED}, false as suppressed from hits", "texts")(lambda t: sr.scan_rules(t, _RULES, sweep=False))
_BITS = "-list_sum(list_transform(list_distinct(string_split(m, '')), lambda x: (1 - length(replace(m, x, '')) / length(m)) * log2(1 - length(replace(m, x, '')) / length(m))))"
_SWEPT = f"""{_SCANNED}, sweep as (select repo, path, line, '{sr.ENTROPY.name}' as rule, 'low' as severity, unnest(regexp_extract_all(text, '{sr.ENTROPY.pattern}')) as m from lines)"""
_add("scan_rules_and_sweep", f""", {_SWEPT}, every as (select * from hits union all select * from sweep where {_BITS} >= {sr.ENTROPY_BITS})
select repo, path, rule, severity, line, {_MASKED}, false as suppressed from every""", "texts")(lambda t: sr.scan_rules(t, _RULES))
_add("scan_receipts", "select repo, path, octet_length(encode(content)) as size, case when content is null then 'no content' when octet_length(encode(content)) > 1000000 then 'over the size cap' end as skip_reason from texts", "texts")(
    sr.scan_receipts)
_add("scan_summary", f""", {_SCANNED}, n as (select repo, count(*) as findings, count(*) filter (severity = 'high') as high from hits group by 1)
select t.repo, t.n as scanned, 0 as skipped, coalesce(findings, 0) as findings, coalesce(high, 0) as high, 0 as suppressed
from (select repo, count(*) as n from texts group by 1) t left join n using (repo)""", "texts")(lambda t: sr.scan_summary(sr.scan_receipts(t), sr.scan_rules(t, _RULES, sweep=False)))
# everything that one repository has found before is in the baseline
_add("scan_with_baseline", f""", {_SCANNED}, f as (select repo, path, rule, severity, line, {_MASKED} from hits)
select *, fingerprint in (select fingerprint from f where repo = 'de') as suppressed from f""", "texts")(lambda t: sr.scan_rules(
    t, _RULES, sweep=False, baseline=sr.scan_rules(t.filter("repo = 'de'"), _RULES, sweep=False).select("fingerprint")))
_add("severity_gate", f", {_SCANNED} select repo, path, rule, severity, line, {_MASKED}, false as suppressed from hits where severity = 'high'", "texts")(
    lambda t: sr.severity_gate(sr.scan_rules(t, _RULES, sweep=False), "high"))
_REDACTED = "content"
for _r in _RULES:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_QUOTED(_r)}', '[REDACTED:{_r.name}]', 'g')"
_add("redact", f"select repo, path, {_REDACTED} as content from texts", "texts")(lambda t: sr.redact(t, _RULES, sweep=False).select("repo", "path", "content"))
_add("redact_and_sweep", None, "texts")(lambda t: sr.redact(t, _RULES).select("repo", "path", "content"))
_add("redaction_tally", ", d as (select " + f"{_REDACTED} as c from texts) " + " union all ".join(
    f"select '{r.name}' as rule, cast(sum(len(string_split(c, '[REDACTED:{r.name}]')) - 1) as bigint) as n from d having n > 0" for r in _RULES), "texts")(
    lambda t: sr.redaction_tally(sr.redact(t, _RULES, sweep=False)))


def _versions(t: DataFrame) -> DataFrame:
    """Every document as a version of its source's notes, the highest doc_id the oldest."""
    return t.withColumn("path", F.concat(F.substring_index("path", "/", 1), F.lit("/notes.txt"))).withColumn("blob", fs.blob_sha(F.col("content")))


_BY_BLOB = f""", v as (select repo, split_part(path, '/', 1) || '/notes.txt' as path, content, doc_id from texts),
o as (select repo, path, content, max(doc_id) as doc_id from v group by 1, 2, 3),
m as (select repo, path, content, unnest(regexp_extract_all(content, '{MAIL}')) as m from v)
select repo, path, 'email' as rule, substr(sha256('email:' || m), 1, 16) as fingerprint, cast(o.doc_id as varchar) as sha from m join o using (repo, path, content)"""
_add("findings_with_commits", _BY_BLOB, "texts")(lambda t: sr.with_commits(
    sr.scan_one(_versions(t), "email", MAIL), _versions(t).select(
        "repo", "path", "blob", F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("sha"), F.lit("").alias("author_name"), F.lit("").alias("author_date")))
    .select("repo", "path", "rule", "fingerprint", "sha"))
_add("secret_scan", f""", v as (select repo, split_part(path, '/', 1) || '/notes.txt' as path, content, doc_id from texts),
o as (select repo, path, content, max(doc_id) as doc_id from v group by 1, 2, 3),
lines as (select repo, path, doc_id, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from o),
{_HITS.replace('repo, path, line', 'repo, path, doc_id, line')}
select repo, path, rule, severity, line, {_MASKED}, cast(doc_id as varchar) as sha from hits""", "texts")(lambda t: sr.secret_scan(
    _versions(t).select("repo", "path", "blob", "content").dropDuplicates(["repo", "path", "blob"]), _versions(t).select(
        "repo", "path", "blob", F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("sha"), F.lit("").alias("author_name"), F.lit("").alias("author_date")),
    _RULES, sweep=False).select("repo", "path", "rule", "severity", "line", "preview", "fingerprint", "sha"))
# the two halves of the whole text
_FENCED = ("concat('# t\n```python title=a.py\n', substr(content, 1, length(content) div 2), '\n```\n~~~\n', "
           "substr(content, length(content) div 2 + 1), '\n~~~\n')")
_add("extract_code_blocks", """, h as (select repo, path, substr(content, 1, length(content) // 2) as a, substr(content, length(content) // 2 + 1) as b, doc_id from texts)
select repo, path, 'a.py' as name, 'python' as language, 2 as line, true as named, a || chr(10) as content, cast(null as varchar) as unsafe from h
union all select repo, path, doc_id || '.block-02.txt', '', 5 + length(a) - length(replace(a, chr(10), '')), false, b || chr(10), null from h""", "texts")(lambda t: blocks.extract_code_blocks(t.withColumn("content", F.expr(_FENCED))))
_add("trace_origin", """, v as (select repo, path, seq, sha, (length(subject) - length(replace(subject, 'fix', ''))) // 3 as n from file_changes),
w as (select *, coalesce(lag(n) over (partition by repo, path order by seq desc, sha desc), 0) as was from v)
select repo, path, seq, sha, n, was, row_number() over (partition by repo order by seq desc, path) = 1 as origin from w where n <> was""", "file_changes")(
    lambda f: h.trace_origin(f.select("repo", "path", "seq", "sha", F.col("subject").alias("content")), "fix"))

# ---- packing, outlines, dependencies
_RUNS = "list_max(list_transform(regexp_extract_all(content, '`+'), lambda x: length(x)))"
_add("pack_receipts", f"""select repo, path, octet_length(encode(content)) as size, {_LINES} as lines, length(content) // 4 as tokens, greatest(3, coalesce({_RUNS}, 0) + 1) as fence,
  content <> '' and not ends_with(content, chr(10)) as no_eol, sha256(content) as sha256 from texts""", "texts")(pack.pack_receipts)
_add("pack_shards", """, r as (select repo, path, length(content) // 4 as tokens, row_number() over (partition by repo order by string_split(path, '/')) as n from texts),
w as (select repo, path, n, tokens as used, 1 as part from r where n = 1 union all
  select r.repo, r.path, r.n, case when used > 0 and used + tokens > 20000 then tokens else used + tokens end, case when used > 0 and used + tokens > 20000 then part + 1 else part end
  from w join r on r.repo = w.repo and r.n = w.n + 1)
select repo, path, cast(part as bigint) as part from w""", "texts")(lambda t: pack.shard(pack.pack_receipts(t), 20000))
_add("pack_round_trip", """select repo, path, sha256(content) as sha256, true as hash_ok from texts""", "texts")(
    lambda t: pack.unpack(pack.pack(t, 200000)).select("repo", "path", F.sha2("content", 256).alias("sha256"), "hash_ok"))
_CODE = "concat('import os\n\nclass A(B):\n    \"\"\"Doc.\"\"\"\n\n    def f', cast(doc_id as string), '(self, x: int = 1) -> int:\n        return x\n')"
def _docstrings(content):
    """No table holds code: each line of a text is the docstring of a function."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1f]", " "), r"([\\\"])", r"\\$1")
    return F.array_join(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x, i: F.concat(
        F.lit("\ndef line"), i.cast("string"), F.lit("():\n    \""), plain(x), F.lit("\"\n"))), "")


_add("code_outline", r""", c as (select repo, replace(path, '.txt', '.py') as path, content, doc_id from texts),
l as (select repo, path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) - 1 as i from c),
o as (select repo, path, 'import' as kind, 'os' as name, 0 as depth, 1 as line, 'import os' as signature, '' as doc from c
union all select repo, path, 'class', 'A', 0, 3, 'class A(B)', 'Doc.' from c
union all select repo, path, 'method', 'f' || doc_id, 1, 6, 'def f' || doc_id || '(self, x: int=1) -> int', '' from c
union all select repo, path, 'function', 'line' || i, 0, 9 + 3 * i, 'def line' || i || '()', trim(regexp_replace(text, '[\x00-\x1f]', ' ', 'g')) from l)
select repo, path, true as parsed, '' as error, * exclude (repo, path) from o""", "texts")(lambda t: outline.code_outline(
    t.withColumn("path", F.regexp_replace("path", "txt$", "py")).withColumn("content", F.concat(F.expr(_CODE), _docstrings(F.col("content"))))))
_JSON = "concat('{\"dependencies\": {\"p', cast(doc_id % 50 as string), '\": \"', case when doc_id % 2 = 0 then '^1.2.3' else '1.2.3' end, '\"}}')"
def _manifests(t: DataFrame) -> DataFrame:
    return deps.dependencies(t.withColumn("path", F.replace("path", F.lit(".txt"), F.lit("/package.json"))).withColumn("content", F.expr(_JSON)), root_only=False)


def _advisories(spark: SparkSession) -> DataFrame:
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    return spark.range(0, 50, 5).select("id", two.alias("j")).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.lit("1.2.3").alias("version"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("ADV-"), F.col("j").cast("string")).alias("advisory"))


_DEPS = """d as (select repo, path, 'p' || (doc_id % 50) as name, case when doc_id % 2 = 0 then null else '1.2.3' end as version, 'npm' as ecosystem, doc_id % 2 <> 0 as pinned from
  (select repo, replace(path, '.txt', '/package.json') as path, doc_id from texts))"""
_AUDIT = f"{_DEPS}, au as (select *, case when version is not null and cast(substr(name, 2) as int) % 5 = 0 then 'ADV-0 ADV-1' else '' end as ids from d)"
_add("dependencies", f", {_DEPS} select * from d", "texts")(_manifests)
_add("dependency_audit", f", {_AUDIT} select * from au", "texts")(lambda t: deps.dependency_audit(_manifests(t), _advisories(t.sparkSession)))
_add("audit_summary", f", {_AUDIT} select repo, count(*) as dependencies, count(*) filter (not pinned) as unpinned, count(*) filter (ids <> '') as afflicted from au group by 1", "texts")(
    lambda t: deps.audit_summary(deps.dependency_audit(_manifests(t), _advisories(t.sparkSession))))
_add("afflictions", f""", {_AUDIT} select distinct repo, name, version, replace(ids, ' ', ',') as ids from au where ids <> ''""", "texts")(
    lambda t: deps.afflictions(_manifests(t), _advisories(t.sparkSession)))
_add("triage_of_all", f""", {RISK}, {STALE}, {_SCANNED}, {_AUDIT} select repo, 'risk' as source, path as subject, {R3('score * 0.9::double')} as severity from risk where score >= 0.4
union all select repo, 'stale', path, {R3('least(0.4::double, age_days / 3650.0::double * 0.4::double)')} from stale where age_days >= 180
union all select repo, 'secret', path, case severity when 'high' then 1.0::double when 'medium' then 0.75::double else 0.5::double end from hits
union all select repo, 'dependency', name || ' ' || version || ' ' || unnest(string_split(ids, ' ')), 0.9::double from au where ids <> ''""", "file_changes", "files", "texts")(
    lambda c, f, t: risk.triage_board(risk.risk_scores(c, f, NOW), hy.stale_files(c, f, NOW), sr.scan_rules(t, _RULES, sweep=False), deps.dependency_audit(_manifests(t), _advisories(t.sparkSession))))
POLICY = {"secrets": "high", "risk": 0.6, "advisories": "any", "stale": "365d"}
_add("policy_gate", f""", {RISK}, {STALE}, {_SCANNED}, {_AUDIT}, g as (select 'secrets' as name, count(*) as n from hits where severity = 'high'
union all select 'risk', count(*) from risk where score >= 0.6 union all select 'advisories', count(*) from au where ids <> '' union all select 'stale', count(*) from stale where age_days > 365)
select name as "check", n = 0 as held, case when n > 0 then n || ' violations' else 'clean' end as detail from g""", "file_changes", "files", "texts")(
    lambda c, f, t: risk.policy_gate(c.sparkSession, risk.gate_checks(POLICY, sr.scan_rules(t, _RULES, sweep=False), risk.risk_scores(c, f, NOW),
                                                                     deps.dependency_audit(_manifests(t), _advisories(t.sparkSession)), hy.stale_files(c, f, NOW))))

# ---- profile, gates, windows
_add("hotspots_with_fixes", f""", n as (select repo, path, count(*) as commits, cast(sum(coalesce(insertions, 0) + coalesce(deletions, 0)) as bigint) as churn,
  count(*) filter ({FIX}) as fixes from file_changes group by 1, 2)
select * from (select *, row_number() over (partition by repo order by commits desc, churn desc, path) as rank from n) where rank <= 10""", "file_changes")(profile.hotspots_with_fixes)
_add("layout", "select repo, split_part(path, '/', 1) as dir, count(*) as files, cast(sum(size) as bigint) as bytes from files group by 1, 2", "files")(profile.layout)
_add("top_entries", """, e as (select distinct repo, split_part(path, '/', 1) as name, contains(path, '/') as is_dir from files)
select repo, row_number() over (partition by repo order by is_dir desc, lower(name), name) as place, name || case when is_dir then '/' else '' end as entry from e""", "files")(profile.top_entries)
# each source is a folder whose first document (by doc_id) is its SKILL.md
_SKILLS = """concat('---\nname: x\ndescription: "Notes | of ', cast(doc_id as string), '"\n---\n', content)"""


def _skill_tree(t: DataFrame) -> DataFrame:
    first = t.groupBy("repo", F.substring_index("path", "/", 2).alias("dir")).agg(F.min("doc_id").alias("doc_id"))
    marked = t.join(first, ["repo", "doc_id"], "left")
    return marked.select("repo", F.when(F.col("dir").isNotNull(), F.concat("dir", F.lit("/SKILL.md"))).otherwise(F.col("path")).alias("path"),
                         F.when(F.col("dir").isNotNull(), F.expr(_SKILLS)).otherwise(F.col("content")).alias("content"))


_add("collect_skills", """, d as (select repo, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as dir, doc_id from texts),
s as (select repo, dir, min(doc_id) as doc_id, count(*) as files from d group by 1, 2),
k as (select *, split_part(dir, '/', 2) as base, row_number() over (partition by repo, split_part(dir, '/', 2) order by string_split(dir, '/')) as k from s)
select repo, dir, base || case when k = 1 then '' else '-' || k end as name, 'Notes \\| of ' || doc_id as description, files, '' as binaries from k""", "texts")(
    lambda t: skills.collect_skills(_skill_tree(t)))
_STAMPED = "concat('---\nsource: ', path, '\nsha: ', case when doc_id % 3 = 0 then 'unknown' else cast(doc_id as string) end, '\n')"
_add("stamps", """select repo, replace(path, '.txt', '/SKILL.md') as path, path as source, case when doc_id % 3 <> 0 then cast(doc_id as varchar) end as sha, 'repo' as profile from texts""", "texts")(
    lambda t: profile.stamps(t.withColumn("content", F.expr(_STAMPED)).withColumn("path", F.replace("path", F.lit(".txt"), F.lit("/SKILL.md")))))
_THEMES = f"""w as (select repo, unnest(regexp_extract_all(lower(subject), '{h.THEME}')) as word from commits where {FIX}),
th as (select repo, word from w where word not in {h.STOP_WORDS} group by 1, 2 having count(*) > 1)"""
_add("profile_summary", f""", {_THEMES}, l as (select repo, unnest(string_split(content, chr(10))) as text from texts), p as (
select repo, 'languages' as part, count(distinct {EXT}) as rows from texts group by 1
union all select repo, 'layout', count(distinct split_part(path, '/', 1)) from texts group by 1
union all select repo, 'prefixes', count(distinct {_CONV}) from commits where {_CONV} <> '' group by 1
union all select repo, 'gotchas', least(count(distinct path), 15) from file_changes group by 1
union all select repo, 'themes', least(count(*), 10) from th group by 1
union all select repo, 'markers', count(distinct regexp_extract(text, '{fs.marker_pattern()}', 1)) from l where regexp_matches(text, '{fs.marker_pattern()}') group by 1
union all select repo, 'owners', least(count(distinct {WHO}), 15) from commits group by 1
union all select repo, 'bus_factor', 1 from commits group by 1)
select repo, part, cast(rows as bigint) as rows from p""", "commits", "file_changes", "texts")(lambda c, f, t: profile.profile_summary(profile.repo_profile(c, f, t.withColumn("size", F.octet_length("content").cast("long")))))
_MADE = "concat('test:\n\tpytest\nbuild', cast(doc_id % 5 as string), ': x\nV:=1\n')"
_add("tooling", """select distinct repo, 'make test' as command, 'test' as kind, 'Makefile' as origin from texts
union all select distinct repo, 'make build' || (doc_id % 5), 'other', 'Makefile' from texts""", "texts")(
    lambda t: profile.tooling(t.withColumn("content", F.expr(_MADE)).withColumn("path", F.lit("Makefile"))))
_add("unsafe_paths", """select path, case when path = '' then 'malformed path' when path like '/%' then 'absolute path' when list_contains(string_split(path, '/'), '..') then 'path traversal'
  when list_contains(string_split(path, '/'), '') or list_contains(string_split(path, '/'), '.') then 'malformed path' end as reason
from (select case doc_id % 5 when 0 then '/' || path when 1 then replace(path, '/', '/../') when 2 then replace(path, '/', '//') when 3 then replace(path, '/', '/./') else path end as path from texts)""", "texts")(
    lambda t: t.select(F.expr("case doc_id % 5 when 0 then concat('/', path) when 1 then replace(path, '/', '/../') when 2 then replace(path, '/', '//') when 3 then replace(path, '/', '/./') else path end").alias("path"))
    .select("path", s_unsafe(F.col("path")).alias("reason")))
_add("score_gate", f", {RISK} select repo, count(*) filter (score >= 0.6) as violations, count(*) filter (score >= 0.6) = 0 as held from risk group by 1", "file_changes", "files")(
    lambda c, f: risk.risk_scores(c, f, NOW).groupBy("repo").agg(F.sum((F.col("score") >= 0.6).cast("long")).alias("violations"), (F.sum((F.col("score") >= 0.6).cast("long")) == 0).alias("held")))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.watch import activity_windows

    w = activity_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), "event_type", "n", r3(F.col("total")).alias("total"))


_FOUND["activity_windows"] = (_windows, """select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%dT%H:%M:%S') as start, event_type, count(*) as n,
  floor(sum(value) * 1000 + 0.5) / 1000 as total from events group by 1, 2""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, (_, oracle) in _FOUND.items() if oracle}
