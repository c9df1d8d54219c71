"""Quality rules with thresholds that adapt to each language and source.

Every document is measured once with row-local array functions.  The measures go into
mergeable quantile sketches: log-linear histograms, whose merge is the sum of their
counts, one per (lang, source) and, by merging those, one per lang and one overall.
From a sketch's quartiles comes a fence; the fences are joined back to the documents.

Only DataFrame functions are used.  What is shuffled is a count per sketch bucket
(pre-aggregated in each task, so a hot source costs no more than a cold one).

Defined results: a null or empty text has no words, fails the base rule and is not kept;
texts of any length are measured whole; null lang or source form groups of their own; repeated
rows and null doc_ids count as often as they occur and give a result each; a measure on its
fence passes; an empty table gives an empty result; columns besides doc_id, text, lang and
source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import saved, table

#: Bits of mantissa of a sketch bucket: a quantile is off by at most 1/32 of its value.
MANTISSA = 5
#: Groups with fewer measured documents use the sketch of their language, then that of all.
LEAST = 50
#: Interquartile ranges between the outer quartile and the fence.
REACH = 3
#: measure -> least distance between quartile and fence: hundredths of a code point per
#: word, and characters, lines or words per 1000 words.
SLACK = {"word_length": 300, "symbols": 60, "dup_lines": 60, "repeats": 150}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        "doc_id", "lang", "source", words.alias("w"), lines.alias("l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    h = F.transform("w", lambda w: F.xxhash64(w))
    two = one.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        h.alias("h"),
    )
    # the hash of the 5-word window that begins at each word but the last four
    window = F.transform(
        F.slice("h", 1, F.greatest(F.size("h") - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(F.col("h"), i + k) for k in range(1, 5))),
    )
    three = two.withColumn("v", window).drop("h")
    # only texts with a repeated window look for its places
    spot = F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    four = three.withColumn("s", F.when(F.size(F.array_distinct("v")) < F.size("v"), spot)).drop("v")
    same = lambda x, k: F.coalesce(F.get(F.col("s"), k)["v"] == x["v"], F.lit(False))
    twice = F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    five = four.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.lit(5), F.coalesce(F.get(F.col("p"), j + 1) - x, F.lit(5)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return five.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rates(m: DataFrame) -> DataFrame:
    """Adds the measures that have a fence, as whole numbers."""
    per = lambda c: F.expr(f"{c} * 1000 div greatest(n_words, 1)")
    return m.select(
        "*",
        F.expr("word_chars * 100 div greatest(n_words, 1)").alias("word_length"),
        per("n_symbols").alias("symbols"),
        per("n_dup_lines").alias("dup_lines"),
        per("n_repeat_words").alias("repeats"),
    )


def bucket(x: Column) -> Column:
    """The log-linear bucket of a whole number >= 0."""
    top = F.length(F.bin(x)) - 1
    wide = (top - MANTISSA + 1) * 2**MANTISSA + (F.call_function("shiftright", x, top - MANTISSA) % 2**MANTISSA)
    return F.when(x < 2**MANTISSA, x).otherwise(wide).cast("long")


def floor_of(b: Column) -> Column:
    """The least number in a bucket."""
    top = F.floor(b / 2**MANTISSA) - 1
    wide = F.call_function("shiftleft", F.lit(2**MANTISSA) + b % 2**MANTISSA, top.cast("int"))
    return F.when(b < 2**MANTISSA, b).otherwise(wide).cast("long")


def sketches(m: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: a sketch for each language, source and measure."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"), bucket(F.col(k)).alias("bucket")) for k in SLACK
    ]))
    return (m.filter("n_words > 0").select("lang", "source", pairs.alias("p"))
            .groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, and a map ``name`` of measure to (docs, low, high)."""
    w = Window.partitionBy(*keys, "measure")
    q = (merged(sketch, keys)
         .withColumn("up", F.sum("n").over(w.orderBy("bucket")))
         .withColumn("total", F.sum("n").over(w)))
    at = lambda k: F.min(F.when(F.col("up") * 4 >= F.col("total") * k, floor_of(F.col("bucket"))))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("measure")]
    quart = q.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), at(1).alias("a"), at(3).alias("b"))
    reach = F.greatest(F.lit(REACH) * (F.col("b") - F.col("a")), slack)
    return quart.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "measure", F.struct("docs", (F.col("a") - reach).alias("low"), (F.col("b") + reach).alias("high")),
    ))).alias(name))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the base measures, base_failed, the failed fences and kept.

    A document is kept if it passes the base rule and every fence of its group: its
    (lang, source), or its lang or all documents where a group has fewer than LEAST.
    ``word_length`` has a fence on both sides, the others above only.
    """
    m = saved(rates(measures(docs)))
    sketch = sketches(m)
    # one row for each language and source, and for each language: AQE broadcasts what is small
    out = m
    for keys, name in ((["lang", "source"], "own"), (["lang"], "wider")):
        f = fences(sketch, keys, name)
        f = f.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], name)
        out = out.join(f, [out[k].eqNullSafe(f[f"{name}_{k}"]) for k in keys], "left")
    # the fences of all documents are one small row, which becomes part of the plan
    row = fences(sketch, [], "widest").head()
    kind = "struct<docs:bigint,low:bigint,high:bigint>"
    every = {k: v.asDict() for k, v in (row["widest"] if row and row["widest"] else {}).items()}
    widest = {k: F.struct(*[F.lit(every[k][x]).alias(x) for x in ("docs", "low", "high")]).cast(kind) if k in every else F.lit(None).cast(kind) for k in SLACK}
    fence = lambda k: F.when(F.col("own")[k]["docs"] >= LEAST, F.col("own")[k].cast(kind)).when(
        F.col("wider")[k]["docs"] >= LEAST, F.col("wider")[k].cast(kind)).otherwise(widest[k])
    broken = F.array_compact(F.array(*[
        F.when((F.col(k) > fence(k)["high"]) | ((F.lit(k) == "word_length") & (F.col(k) < fence(k)["low"])), F.lit(k))
        for k in SLACK
    ]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & (F.size(broken) == 0)).alias("kept"),
        F.array_join(broken, ",").alias("broken"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB, with sorted lists in place of sketches."""
    words, lines = r"regexp_split_to_array(t, '[\x20\x09-\x0D]+')", r"regexp_matches(x, '[^\x20\x09-\x0D]')"
    floor = f"case when x < {2**MANTISSA} then x else (x >> (length(bin(x)) - 1 - {MANTISSA})) << (length(bin(x)) - 1 - {MANTISSA}) end"
    slack = "case measure " + " ".join(f"when '{k}' then {v}" for k, v in SLACK.items()) + " end"
    group = lambda keys: f"""select {''.join(f'{k}, ' for k in keys)}measure, count(*) as docs, list_sort(list({floor}))[cast(ceil(count(*) / 4.0) as int)] as a,
      list_sort(list({floor}))[cast(ceil(count(*) * 3 / 4.0) as int)] as b from v where n_words > 0 group by all"""  # noqa: E731
    fence = lambda name: f"select *, a - greatest({REACH} * (b - a), {slack}) as low, b + greatest({REACH} * (b - a), {slack}) as high from {name}"
    pick = lambda c: f"case when o.docs >= {LEAST} then o.{c} when l.docs >= {LEAST} then l.{c} else e.{c} end"
    order = "case measure " + " ".join(f"when '{k}' then {n}" for n, k in enumerate(SLACK)) + " end"
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, list_filter({words}, lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: {lines}) as l from d),
g as (select rid, k, array_to_string(w[k:k + 4], ' ') as five from (select rid, w, unnest(generate_series(1, len(w) - 4)) as k from w)),
c as (select rid, count(distinct p) as n from (select rid, unnest(generate_series(k, k + 4)) as p from (select *, count(*) over (partition by rid, five) as times from g) where times > 1) group by 1),
m as (select w.rid, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from w left join c on c.rid = w.rid),
v as (unpivot (select rid, lang, source, n_words, word_chars * 100 // greatest(n_words, 1) as word_length, n_symbols * 1000 // greatest(n_words, 1) as symbols,
  n_dup_lines * 1000 // greatest(n_words, 1) as dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) as repeats from m)
  on word_length, symbols, dup_lines, repeats into name measure value x),
own as ({group(['lang', 'source'])}), wider as ({group(['lang'])}), widest as ({group([])}),
o as ({fence('own')}), l as ({fence('wider')}), e as ({fence('widest')}),
f as (select v.rid, string_agg(v.measure, ',' order by {order.replace('measure', 'v.measure')}) filter (v.x > {pick('high')} or v.measure = 'word_length' and v.x < {pick('low')}) as broken
  from v left join o on o.lang is not distinct from v.lang and o.source is not distinct from v.source and o.measure = v.measure
  left join l on l.lang is not distinct from v.lang and l.measure = v.measure left join e on e.measure = v.measure group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and broken is null as kept, coalesce(broken, '') as broken
from m join f using (rid)
"""


SQL = _sql()
