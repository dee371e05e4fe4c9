"""The corpus pipeline: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet below the shared
folder and reads it back for the next one. All but the last return the columns of ``documents``; columns beyond these
are left out, whatever their names. An empty table gives an empty one. Rows that repeat are rows like others but in the
third stage, which keeps one document of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Stage, small, table
from lodestar.llm.line_dedup import remove_boilerplate
from lodestar.llm.mixing import mix
from lodestar.llm.ngram_join import similar_documents
from lodestar.llm.packing import pack
from lodestar.llm.toxicity import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null, empty or blank text has nothing toxic and stays; nulls in other columns don't matter. Texts are scored whole.
    """
    return score_documents(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources show stay in one document only, the one with the least doc_id.

    Every document stays, and n_chars is counted anew where lines go. Rows without an id or a text stay as they are; a
    null source is a source of its own. Of several rows with one id and text each loses the same lines.
    """
    out = remove_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, in all its rows.

    Documents without an id can't be named, so they all stay; documents without a word link with nothing and stay.
    """
    others = Stage(spark, "near")(similar_documents(docs).where("doc_id <> component_id").select("doc_id"))
    return docs.join(small(others), "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for: none, once or up to three times.

    A null source is a source of its own; rows without an id are told apart by their texts; null texts have no words and follow their hash.
    """
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins, one row per piece with its bin, document, number, first word, size, source and cluster.

    Documents without words have one row of size 0 and bin -1. Copies are packed each, into different bins; nulls are values like others.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the first stage, a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
