"""A training corpus from raw documents: quality filter, line dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.common import materialize, set_aside, table
from shroud.llm.jaccard_forest import drop_near_duplicates
from shroud.llm.line_dedup import dedup_lines
from shroud.llm.mixing import mix
from shroud.llm.packing import pack_documents
from shroud.llm.quality import classify
from shroud.llm.registry import LANGUAGE_WEIGHTS, site_group, tokenizer_file

#: Share of the deduplicated corpus that goes on, in percent of its tokens.
BUDGET_PERCENT = 90


#: The columns that the stages read or write; others go through under names of no meaning.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_other_columns(stage: Stage) -> Stage:
    """The stage, whatever names the other columns of ``docs`` have."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, back = set_aside(docs, lambda c: c not in OWN)
        return back(stage(spark, plain, sf_dir))

    return run_stage


@with_other_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, table(spark, sf_dir, "labels")).filter("keep").select(*docs.columns)


@with_other_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; a document of which nothing is left goes."""
    cut = dedup_lines(docs)
    left = cut.filter((F.col("n_deleted") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@with_other_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return drop_near_duplicates(docs)


@with_other_columns
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token prefix under its budget, no document twice; the document at the edge stays whole."""
    mixed = mix(docs, site_group(), F.col("lang"), F.col("source"), budget_percent=BUDGET_PERCENT,
                language_weights=LANGUAGE_WEIGHTS, max_epochs=1)
    return mixed.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixing),
    ("packing", packing),
]

#: The trained classifier and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
