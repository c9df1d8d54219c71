"""Chat formatting by perspective rotation.

For every participant, the dialogue is rendered with that speaker as the assistant and the
others as named users; a training mask covers what the assistant says.  System turns belong
to nobody: they are rendered as system and are nobody's perspective.

A rendering is cut into segments of consecutive turns, each a row with its text and the
spans of code points in it that are trained on, so a conversation of any number of turns
never has to fit into one row or task.  Segments are turn ranges, grouped after the turns
are numbered; numbering counts turns in ranges first and so does not sort a hot
conversation in one task (rows of one turn number, or without one, are ordered in one).

Defined results: a row without conv_id or role belongs to no dialogue and is dropped; a
null text is rendered as empty, one of any length whole; marks in a text or role lose their
meaning ("<|" becomes "< |"), line ends in a role become a space; a null turn comes after the
numbered ones; ties go by role and text, and repeated rows stay, each rendered; a conversation of system turns only has no
perspective; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import table

#: Turns in a segment.
SEGMENT = 64
#: Turn numbers in a range that is sorted by itself.
RANGE = 1024
SYSTEM = "system"
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: What marks begin with, and what it becomes in roles and texts, so that no turn can be forged.
OPEN, PARTED = "<|", "< |"


def plain(text: Column) -> Column:
    """A text that can't hold a mark of its own: the marks' first two characters are parted."""
    return F.replace(text, F.lit(OPEN), F.lit(PARTED))


def named(role: Column) -> Column:
    """A role that ends where its line does."""
    return plain(F.regexp_replace(role, r"[\r\n]+", " "))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text."""
    t = (turns.filter("conv_id is not null and role is not null")
         .select("conv_id", F.col("turn").cast("long").alias("turn"), named(F.col("role")).alias("role"), plain(F.coalesce("text", F.lit(""))).alias("text"))
         .withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(2**62)).cast("long")))
    counts = t.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return (t.join(starts, ["conv_id", "range"])
            .select("conv_id", (F.col("first") + F.row_number().over(own) - 1).alias("position"), "role", "text"))


def rotate(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, speaker, segment, n_turns, text, mask (spans of code points, end exclusive)."""
    n = numbered(turns)
    speakers = (turns.filter(F.col("conv_id").isNotNull() & F.col("role").isNotNull() & (F.col("role") != SYSTEM))
                .select("conv_id", named(F.col("role")).alias("speaker")).distinct())
    parts = n.groupBy("conv_id", F.floor(F.col("position") / segment).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    each = parts.join(speakers, "conv_id")
    head = lambda t: F.when(t["role"] == SYSTEM, F.lit(f"{BEGIN}{SYSTEM}\n")).when(
        t["role"] == F.col("speaker"), F.lit(f"{BEGIN}assistant\n")).otherwise(
        F.concat(F.lit(f"{BEGIN}user name="), t["role"], F.lit("\n")))
    drawn = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), t["text"].alias("text"), (t["role"] == F.col("speaker")).alias("own")))
    # (text so far in code points, spans); a trained span is what the assistant says and the end mark
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    step = lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["text"]) + len(END)).cast("long").alias("at"),
        F.when(t["own"], F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(t["head"])).cast("long").alias("start"),
            (a["at"] + F.length(t["head"]) + F.length(t["text"]) + len(END)).cast("long").alias("end"),
        )))).otherwise(a["spans"]).alias("spans"))
    return (each.withColumn("drawn", drawn).select(
        "conv_id", "speaker", F.col("segment").cast("long").alias("segment"), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("drawn", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("text"),
        F.aggregate("drawn", zero, step)["spans"].alias("mask")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask is given as text, "start-end" joined by commas, so that SQL can compare it."""
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


SQL = f"""
with t as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn asc nulls last, role, text) - 1 as position
  from (select conv_id, turn, replace(regexp_replace(role, '[\r\n]+', ' ', 'g'), '{OPEN}', '{PARTED}') as role, replace(coalesce(text, ''), '{OPEN}', '{PARTED}') as text
        from conversations where conv_id is not null and role is not null)),
s as (select distinct conv_id, role as speaker from t where role <> '{SYSTEM}'),
h as (
  select t.conv_id, s.speaker, t.position // {SEGMENT} as segment, t.position, t.text, t.role = s.speaker as own,
         case when t.role = '{SYSTEM}' then '{BEGIN}{SYSTEM}' when t.role = s.speaker then '{BEGIN}assistant'
              else '{BEGIN}user name=' || t.role end || chr(10) as head
  from t join s using (conv_id)),
o as (
  select *, sum(length(head) + length(text) + {len(END)}) over (
      partition by conv_id, speaker, segment order by position) as until from h)
select conv_id, speaker, segment, count(*) as n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' order by position) as text,
       coalesce(string_agg(case when own then cast(cast(until - length(text) - {len(END)} as bigint) as varchar) || '-'
           || cast(cast(until as bigint) as varchar) end, ',' order by position), '') as mask
from o group by conv_id, speaker, segment
"""
