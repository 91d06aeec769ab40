"""A training corpus from raw documents: five stages, each written and read again.

Language ID drops documents without a language; line dedup deletes runs of lines that occurred before, and documents of which nothing is left;
the n-gram join leaves one document of each near-duplicate group, cut texts being compared as they came in too; mixing takes each source up to its budget; packing
forms batches of similar length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._spark import Scratch, side
from factloom.llm.language_id import accepted
from factloom.llm.line_dedup import line_dedup
from factloom.llm.mixing import Setting as Mix
from factloom.llm.mixing import mix
from factloom.llm.ngram_join import keep_one
from factloom.llm.packing import pack

#: English twice as often as any other language; 90 % of what is there, each document once at most.
MIX = Mix(weights={"lang": {"en": 2.0}}, share=0.9, max_epochs=1)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    return accepted(docs)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less repeated runs of lines; n_chars follows the text. A document that loses every line goes."""
    out = line_dedup(docs)
    left = out.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", chars).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by the texts as they are and, where an earlier stage cut some, as they came in.

    Line dedup leaves only the differing lines of a near copy, so a document that it cut takes part with both of its texts.
    """
    came = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    now = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"))
    other = came.select("doc_id", "mark").distinct().join(now.select("doc_id").distinct(), "doc_id", "left_semi").join(now, ["doc_id", "mark"], "left_anti")
    cut = came.join(side(Scratch(spark).store(other), row_bytes=64), ["doc_id", "mark"], "left_semi")
    return keep_one(docs, also=cut.select("doc_id", "text"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budget of their source."""
    return mix(docs, MIX).select(*docs.columns)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their bucket, batch and place."""
    return pack(docs)


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("mixing", stage_mix),
    ("packing", stage_pack),
]

#: Language ID learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return docs
