"""The five base tables, drawn from the driver's tables, as Spark DataFrames and as SQL.

``orders`` stand for commits, ``lineitem`` for file changes and blame, ``part`` for the
working tree, ``events`` for file events, ``documents`` for text files and blobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: "Now" of all queries: 1999-01-01.
NOW = 915148800

# Written in what Spark SQL and DuckDB have in common; {x} marks what they spell differently.
_COMMITS = """
select concat('repo', cast(o_custkey % 3 as string)) as repo, cast(o_orderkey as string) as sha,
       concat('Name', cast(o_custkey % 50 as string)) as author_name,
       case when o_custkey % 11 = 0 then '' else concat('e', cast(o_custkey % 80 as string), '@x.org') end as author_email,
       cast({day} as bigint) * 86400 + o_orderkey % 86400 as author_time,
       case o_orderkey % 8 when 0 then 'feat: add part' when 1 then 'fix(core): repair flow' when 2 then 'docs: note'
            when 3 then 'feat!: new api' when 4 then 'Bug in parser' when 5 then 'remove: old' when 6 then 'BREAKING change'
            else o_orderpriority end as subject, o_orderkey
from orders"""
_SEQ = """
select repo, sha, author_name, author_email, author_time, {iso} as author_date, subject,
       cast(row_number() over (partition by repo order by author_time desc, o_orderkey desc) - 1 as bigint) as seq from c0"""
# the same in Spark, numbered within days, so that no task sorts all of a repository's rows
_DAYS = """
select repo, day, cast(coalesce(sum(n) over (partition by repo order by day desc rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier
from (select repo, author_time div 86400 as day, count(*) as n from c0 group by 1, 2)"""
_SEQ_BY_DAY = """
select c.repo, sha, author_name, author_email, author_time, {iso} as author_date, subject,
       cast(earlier + row_number() over (partition by c.repo, day order by author_time desc, o_orderkey desc) - 1 as bigint) as seq
from c0 c join days d on d.repo = c.repo and d.day = c.author_time div 86400"""
_PATH = "concat('d', cast({k} % 9 as string), '/f', cast({k} as string), case {k} % 4 when 0 then '.py' when 1 then '.md' when 2 then '.js' else '' end)"
_CHANGES = f"""
select c.repo, c.sha, c.seq, c.author_name, c.author_email, c.author_time, c.author_date, c.subject,
       {_PATH.format(k='l_partkey')} as path,
       case when l_partkey % 37 = 0 then null else cast(l_quantity as bigint) end as insertions,
       case when l_partkey % 37 = 0 then null else cast(l_linenumber as bigint) end as deletions
from lineitem join commits c on c.sha = cast(l_orderkey as string)"""
_FILES = f"""
select concat('repo', cast(r.r as string)) as repo, {_PATH.format(k='p_partkey')} as path, cast(p_size * 100 as bigint) as size
from part cross join (select 0 as r union all select 1 union all select 2) r where p_size % 5 <> 0"""
_EVENT = """
select concat('repo', cast(user_id % 3 as string)) as repo, concat('d', cast(user_id % 9 as string), '/u', cast(user_id as string)) as path,
       case event_type when 'signup' then 'A' when 'error' then 'D' else 'M' end as status, cast(event_id as string) as sha,
       concat('a', cast(user_id % 7 as string)) as author, cast(floor(value) as bigint) as size, {number} as seq, {ts} as date
from """
_EVENTS = _EVENT.replace("{number}", "cast(row_number() over (partition by user_id % 3 order by ts desc, event_id desc) - 1 as bigint)") + "events"
_HOURS = """
select shard, hour, cast(coalesce(sum(n) over (partition by shard order by hour desc rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier
from (select user_id % 3 as shard, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2)"""
_EVENTS_BY_HOUR = _EVENT.replace("{number}", "cast(earlier + row_number() over (partition by shard, hour order by ts desc, event_id desc) - 1 as bigint)") + \
    "events join hours on shard = user_id % 3 and hour = date_trunc('hour', ts)"
_TEXTS = "select lang as repo, concat(source, '/', lang, '/', cast(doc_id as string), '.txt') as path, text as content, doc_id from documents"
_TAGS = """
select repo, concat('v', sha) as name, sha, author_date as date from commits where cast(sha as bigint) % 97 = 0
union all select repo, concat('w', sha) as name, sha, author_date as date from commits where cast(sha as bigint) % 194 = 0"""
_BRANCHES = """
select concat('repo', cast(s_suppkey % 3 as string)) as repo, s_name as name, 800000000 + s_suppkey * 259200 as last_time,
       concat('a', cast(s_nationkey as string)) as author, s_suppkey % 2 = 0 as merged, s_nationkey % 5 = 0 as gone_upstream
from supplier"""
_BLAME = f"""
select case l_partkey % 4 when 0 then 'de' when 1 then 'en' when 2 then 'es' else 'fr' end as repo, {_PATH.format(k='l_partkey')} as path, cast(l_linenumber as bigint) as line, concat('a', cast(l_suppkey % 20 as string)) as author,
       cast({{ship}} as bigint) * 86400 as author_time from lineitem"""

_PARTS = {
    "c0": _COMMITS, "commits": _SEQ, "file_changes": _CHANGES, "files": _FILES, "file_events": _EVENTS,
    "texts": _TEXTS, "tags": _TAGS, "branches": _BRANCHES, "blame": _BLAME,
}
_SPARK = {
    "day": "unix_date(cast(o_orderdate as date))", "ship": "unix_date(cast(l_shipdate as date))",
    "iso": "date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, author_time), \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")",
    "ts": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
}
_DUCK = {
    "day": "datediff('day', date '1970-01-01', cast(o_orderdate as date))", "ship": "datediff('day', date '1970-01-01', cast(l_shipdate as date))",
    "iso": "strftime(make_timestamp(author_time * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')",
    "ts": "strftime(ts, '%Y-%m-%dT%H:%M:%S')",
}
_SOURCES = {"c0": "orders", "file_changes": "lineitem", "files": "part", "file_events": "events", "hours": "events", "texts": "documents", "branches": "supplier", "blame": "lineitem"}
#: Views that Spark builds otherwise than their SQL says, with what they need.
_OWN = {"days": _DAYS, "commits": _SEQ_BY_DAY, "hours": _HOURS, "file_events": _EVENTS_BY_HOUR}
_FIRST = {"commits": ["c0", "commits"], "file_changes": ["c0", "commits", "file_changes"], "tags": ["c0", "commits", "tags"]}
_FIRST_OWN = {k: [x for p in v for x in (["days", p] if p == "commits" else [p])] for k, v in _FIRST.items()} | {"file_events": ["hours", "file_events"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table over the Parquet files of ``sf_dir``."""
    need = _FIRST_OWN.get(name, [name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {_SOURCES.get(p) for p in need} if t}
    parts = []
    for p in need:
        body = _OWN.get(p, _PARTS.get(p)).format(**_SPARK)
        if t := _SOURCES.get(p):
            body = body.replace(f"from {t}", f"from {{{t}}}")
        parts.append(f"{p} as ({body})")
    return spark.sql(f"with {', '.join(parts)} select * from {name}", **tables)


def sql(*names: str) -> str:
    """``with ...`` that defines base tables in DuckDB."""
    need = list(dict.fromkeys(p for n in names for p in _FIRST.get(n, [n])))
    return "with recursive " + ", ".join(f"{p} as ({_PARTS[p].format(**_DUCK)})" for p in need)
