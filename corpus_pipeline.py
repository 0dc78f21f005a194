"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shared_folder, table
from tidemill.llm.line_dedup import drop_recurring_lines
from tidemill.llm.mixing import mix_sources, word_count
from tidemill.llm.near_dedup import drop_near_duplicates
from tidemill.llm.packing import pack
from tidemill.llm.quality import fit_quality, judge_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _words(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees accept. The trees are fitted on the labelled documents of ``docs``.

    A null text has no words and goes; rows that repeat are judged alike; an empty table, or one without labels, leaves the base rules alone.
    """
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs.select(*COLUMNS), trees).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows the text. One of which no word is left goes."""
    out = drop_recurring_lines(docs.select(*COLUMNS)).where(_words("text") | (F.size("dropped") == 0))
    return out.withColumn("n_chars", F.when(F.size("dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target asks for: at most twice, and not at all beyond the target.

    A null source is a source of its own; a null or wordless text has size 0; an empty table gives an empty one.
    """
    mixed = mix_sources(docs.select(*COLUMNS), word_count(), F.col("doc_id"), whole=True)
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null text gives the separator alone, an empty table no piece."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trees nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder of ``spark.checkpoint.dir`` and read again."""
    top = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
