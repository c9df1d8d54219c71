"""A corpus pipeline: each stage works on all that the one before it kept.

Stages 1 to 4 return the columns of ``documents``; the last returns the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bin_packing, jaccard_join, quality_classifier, substring_dedup, toxicity

STAGES = [
    ("quality classifier", quality_classifier.stage),
    ("toxicity", toxicity.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("substring dedup", substring_dedup.stage),
    ("best-fit packing", bin_packing.stage),
]
#: The classifiers and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between stages, rows are written as Parquet and read again.

    Nulls, empty and very long texts, ties, repeated rows and columns of any other name go through
    as each stage's docstring says; an empty table gives an empty packing.  What a stage read is
    removed when the next one has written its own rows; the last stage's input stays, as the
    result may still be read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = _folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="stratalog-")
    return f"{shared}/pipeline-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
