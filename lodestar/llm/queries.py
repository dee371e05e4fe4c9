"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .common import table
from .line_dedup import remove_boilerplate
from .mixing import take
from .neardup import similar_vectors
from .ngram_join import similar_documents
from .packing import pack
from .periodic import periodic_runs
from .pii import personal_data, summary
from .quality import judge
from .repeats import remove_repeats
from .tokens import token_counts
from .toxicity import score_documents
from .whitening import whiten


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_conversations(turns.unionByName(more)), arranged=True)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(personal_data(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = take(table(spark, sf_dir, "documents"), most=3.0)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), n=4, threshold=0.85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts, chosen by the hash h of their id, are made periodic from word a on, with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"filter(split(text, '[\u0009-\u000D\u0020]+'), w -> w <> '')")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.expr("(h div 10) % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    periodic = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    found = periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as order, r.start as start, r.period as period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.order")
    return found.select("doc_id", "n_runs", "best.start", length.alias("length"), "best.period", F.expr("-1000 * best.order div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), components=8)
    each = F.explode(F.expr("transform(arrays_zip(whitened, explained), (x, i) -> struct(i + 1 as component, x.whitened as whitened, x.explained as explained))"))
    return found.select("vec_id", "n", "deviation", "identity_error", each.alias("c")).select("vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), k=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_formatting, op2_embedding_near_dedup, op3_best_fit_packing, op4_pii, op5_toxicity, op6_source_mixing, op7_quality_rules, op8_token_counts, op9_ngram_jaccard_join, op10_line_dedup, op11_periodic_runs, op12_embedding_whitening, op13_substring_dedup]
    return {f.__name__: f for f in found}
