"""A training-data pipeline: each stage takes what its predecessor kept, written as Parquet.

Stages, in order: language ID (documents whose language can't be told go), line dedup
(texts keep their kept lines), MinHash near-dedup (the smallest doc_id of each class
stays), mixing (rows are repeated or left out by their source's share) and packing. All
but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.llm.common import WRITTEN, documents, drop_tables, table
from muxlake.llm.langid import identified
from muxlake.llm.line_dedup import apply_bitmaps, keep_bitmaps
from muxlake.llm.mixing import repeat_rows
from muxlake.llm.near_dup import representatives
from muxlake.llm.packing import pack

#: Mean probability of the best language below which a document is rejected.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dup", near_dup), ("mix", mix), ("packing", packing)]
#: The network, the sketches and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of documents. What a stage wrote for itself is deleted once its result is written; only the last stage's remains."""
    docs, app = documents(spark, sf_dir), spark.sparkContext.applicationId
    others = list(WRITTEN.get(app, []))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs)
            drop_tables(spark, but=[*others, WRITTEN[app][-1]])
    return docs
