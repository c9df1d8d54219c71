"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Share of labelled rows held out: crc32(doc_id as text) mod HOLD_OUT = 0.
HOLD_OUT = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; only where
    that is unset (local tests) is a temporary one made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratalog-"))
    return df.checkpoint(eager=True)


def held_out(doc_id) -> F.Column:
    """True for the rows whose labels may not be learnt from; false for a null doc_id, which no label names."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT == 0, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_where(docs: DataFrame, good) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text (the Arrow column) passes ``good``, which gives a mask."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(good(batch.column(at).cast(pa.string())), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: Values of the truncated hash that ``narrowed`` broadcasts, at most.
NARROW = 1 << 20


def narrowed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be in ``ids``: all that are, and few others while ids are few.

    Both sides are hashed to NARROW values; the distinct ones among ``ids``, at most NARROW
    numbers whatever the input, are broadcast.  It saves shuffling texts that a join would drop.
    """
    short = lambda c: F.pmod(F.xxhash64(c.cast("long"), F.lit(17)), F.lit(NARROW))
    few = ids.select(short(F.col("doc_id")).alias("short_id")).distinct()
    return docs.join(F.broadcast(few), short(docs["doc_id"]) == few["short_id"], "left_semi")
