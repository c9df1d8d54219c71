"""Best-fit packing of documents into fixed-size bins, under conflicts.

A document longer than a bin fills whole bins and leaves a remainder.  What is left over is
packed by best fit: the bins of a shard are kept in order of their residual, and each
carries a bitmap of the sources and a bitmap of the duplicate clusters in it.  A piece takes
the tightest bin that holds it; if a bitmap conflicts, the search goes on to the successor,
until a compatible bin is found or a new one is opened.  So no bin holds two pieces of one
source or of one duplicate cluster.

Pieces are dealt to shards of about SHARD pieces by a hash of doc_id and row, so a hot source,
cluster or repeated doc_id spreads over all shards and a task's work is bounded.  Only lengths
and keys are shuffled, never texts.

Defined results: a null or empty text has length 0 and takes part in no bin (bin null); a text
of any length fills as many bins as it needs; null sources conflict with each other like any
value, null clusters with none; repeated rows, null doc_ids too, are separate pieces, and the
name of a bin that a part fills alone ends in the row's number; ties in length go by doc_id, then
by source and row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import saved, table

#: Words in a bin.
CAPACITY = 2048
#: Pieces in a shard, on average.
SHARD = 4096


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def cluster_of(text: Column) -> Column:
    """A key that documents with the same words in the same order share."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))


def best_fit(lengths, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each piece; pieces come longest first.

    ``sources`` and ``clusters`` are bit numbers, -1 for a piece that conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), the tightest first
    with_source, with_cluster = [], []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (length, -1))
        while at < len(order) and (with_source[order[at][1]] & s or with_cluster[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(with_source)
            with_source.append(0)
            with_cluster.append(0)
        with_source[b] |= s
        with_cluster[b] |= c
        if residual > length:
            insort(order, (residual - length, b))
        bins.append(b)
        offsets.append(capacity - residual)
    return bins, offsets


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Packs items (doc_id, source, cluster, length).

    Returns a row for each piece: doc_id, part, start and length in the document, bin
    (a text "shard-number", "full-doc_id-part" for a part that fills a bin alone) and offset.
    """
    # saved with the number of each row, so that repeated rows are dealt apart and stay where they are
    items = saved(items.select("doc_id", F.col("source").cast("string"), "cluster", F.coalesce("length", F.lit(0)).cast("long").alias("length"),
                               F.monotonically_increasing_id().alias("row")))
    shards = max(1, -(-items.count() // shard))
    full = F.floor(F.col("length") / capacity)
    whole = (items.filter(F.col("length") >= capacity)
             .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("part"), "row")
             .select("doc_id", "part", (F.col("part") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
                     F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("part").cast("string"), F.col("row").cast("string")).alias("bin"),
                     F.lit(0).cast("long").alias("offset")))
    none = items.filter("length = 0").select(
        "doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"), "length",
        F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("offset"))
    rest = (items.filter(F.col("length") % capacity > 0)
            .select("doc_id", full.cast("long").alias("part"), (full * capacity).cast("long").alias("start"),
                    (F.col("length") % capacity).alias("length"), "source", "cluster", "row",
                    F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "source", "row"], ascending=[False, True, True, True])
        sources = pd.factorize(pdf["source"], use_na_sentinel=False)[0]
        clusters = pd.Series(pd.factorize(pdf["cluster"])[0], index=pdf.index)
        alone = ~clusters.duplicated(keep=False) | (clusters < 0)
        clusters = pd.factorize(clusters.mask(alone))[0]  # bits only for clusters that can conflict here
        bins, offsets = best_fit(pdf["length"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        name = f"{pdf['shard'].iat[0]}-"
        return pdf[["doc_id", "part", "start", "length"]].assign(bin=[f"{name}{b}" for b in bins], offset=offsets)

    key = items.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("shard").applyInPandas(
        run, f"doc_id {key}, part long, start long, length long, bin string, offset long")
    return whole.unionByName(packed).unionByName(none)


def items_of(docs: DataFrame) -> DataFrame:
    """The lengths and conflict keys of documents."""
    return docs.select("doc_id", "source", cluster_of(F.col("text")).alias("cluster"), n_words(F.col("text")).alias("length"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(items_of(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: where each piece of each document goes.

    Nulls, empty and long texts, ties, repeats and an empty table are as the module defines them.
    """
    return pack(items_of(docs))
