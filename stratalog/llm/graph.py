"""Connected components of a large graph, by Spark joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import saved

#: Edges of a partition, about; each partition is contracted by itself first.
PART = 1 << 20


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the edges: (id, least id) of each id that isn't the least itself."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        last = label.copy()
        np.minimum.at(label, x, last[y])
        np.minimum.at(label, y, last[x])
        np.minimum.at(label, last, label)  # a part's old root learns of the new one
        while (label != label[label]).any():
            label = label[label]
        if (label == last).all():
            break
    other = label != np.arange(len(ids))
    return ids[other], ids[label[other]]


def _stars(batches):
    t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = contracted(t.column("a").to_numpy(), t.column("b").to_numpy())
    for k in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that is reachable, for every id in ``edges`` (a, b; whole numbers).

    Partitions of about PART edges are contracted to stars where they lie; one partition is done
    by that.  Then large and small stars alternate: each round links a node's neighbours to the
    least of them, which halves depths, so rounds grow with the logarithm of the longest path.  A
    round is two pre-aggregated shuffles of the edges; nothing is collected but one checksum.
    """
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    parts = 1 + e.count() // PART
    e = saved(e.coalesce(parts).mapInArrow(_stars, "a long, b long"))
    last = None if parts > 1 else 0
    while last != 0:
        # large star: every larger neighbour of x goes to the least of x and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small star: every smaller neighbour of x, and x, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        e = saved(small.filter("a <> b").distinct().coalesce(parts))
        now = mark(e)
        if now == last:
            break
        last = now
    ids = e.select(F.explode(F.array("a", "b")).alias("id"), F.col("b").alias("component"))
    return ids.groupBy("id").agg(F.min("component").alias("component"))
