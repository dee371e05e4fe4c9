"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. A source's target is so many whole passes over the source plus a rest; the rest is taken
from the documents whose hash lies below a threshold. The threshold comes from a histogram of words by source and
hash bucket. Only the bucket in which a source's budget ends is split further, level by level, so thresholds are
nested and nothing is sorted. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, small

#: Hexadecimal digits of the hash that each level of histograms looks at: 4096, 4096 and 65536 buckets.
LEVELS = ((1, 3), (4, 3), (7, 4))
WORD = r"[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of runs outside ASCII white space; 0 for null."""
    return F.expr(f"cast(coalesce(regexp_count({text}, '{WORD}'), 0) as bigint)")


def weigh(sources: DataFrame) -> DataFrame:
    """Adds ``weight``: 1, 2, 3, repeating over (source, source_size) by code point, a null source last.

    Takes one row per source; a window over all of these is a window over sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))


def share(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds ``target``: (source, source_size, weight) share the sum of all sizes by weight, none over ``most`` times its size.

    The excess is shared again by weight until none is above. That ends at one level L with target = min(most * size,
    L * weight); sources reach their limit in the order of most * size / weight, so running sums in that order give L.
    """
    ratio = F.col("source_size") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = sources.withColumn("limited", F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0.0)))
    rows = rows.withColumn("lighter", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    rows = rows.withColumn("level", F.try_divide(F.sum("source_size").over(everything) - F.col("limited"), F.sum("weight").over(everything) - F.col("lighter")))
    # The level of the first source, in that order, that stays below its limit.
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= most * ratio, F.struct("place", "level"))).over(everything)["level"], F.lit(0.0)))
    return rows.withColumn("target", F.least(most * F.col("source_size"), F.col("level") * F.col("weight")).cast("double")).select(*sources.columns, "target")


def _hash(doc_id: Column, text: Column) -> Column:
    """Of id and text, so that rows that lack an id or share one are told apart by their texts."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), F.md5(F.coalesce(text, F.lit(""))))), 1, 10)


def _bucket(level: int, of: str | Column = "hash") -> Column:
    first, n = LEVELS[level]
    return F.conv(F.substring(of, first, n), 16, 10).cast("long")


def _budgets(docs: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """The sized rows (doc_id, source, size, hash), and one row a source: __source, source_size, target, passes and the cut of each level."""
    stage = Stage(docs.sparkSession, "mixing")
    sized = stage(docs.select("doc_id", "source", word_count().alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("hash")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stage(share(weigh(totals), most))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = sources.withColumn("passes", passes.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    for level in range(len(LEVELS)):
        left = stage(_refine(sized, left, level))
    return sized, left.select(F.col("source").alias("__source"), "source_size", "target", "passes", *[f"cut{i}" for i in range(len(LEVELS))])


def _copies(most: float, of: str | Column = "hash", passes: str = "passes", cut: str = "cut") -> Column:
    below = F.lit(False)
    for level in reversed(range(len(LEVELS))):
        b, c = _bucket(level, of), F.col(f"{cut}{level}")
        below = (b < c) | ((b == c) & below)
    # A source at its limit has no rest, but rows without words fit into that.
    return F.least(F.col(passes) + below.cast("long"), F.lit(math.ceil(most)).cast("long"))


def take(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each document; ``copies`` <= ``most``.

    Sizes are words. Every document is taken floor(target / source_size) times, and once more if its hash is below its
    source's threshold. A source's words differ from its target by at most half of what shares its last histogram
    cell, usually one document. Rows that repeat both doc_id and text share a hash and so a decision, a null doc_id being one
    like others; a null source is a source of its own; null or blank texts have size 0 and follow their hash. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    sized, cuts = _budgets(docs, most)
    met = sized.join(small(cuts), F.col("source").eqNullSafe(F.col("__source")))
    return met.select("doc_id", "source", "size", "source_size", "target", _copies(most).alias("copies"))


def _refine(sized: DataFrame, left: DataFrame, level: int) -> DataFrame:
    """Finds for each source the bucket of this level in which its rest ends (``cut``), and what is left for the next.

    At the last level the bucket itself goes to the nearer side.
    """
    inside = F.col("source").eqNullSafe(F.col("s"))
    for i in range(level):
        inside &= _bucket(i) == F.col(f"cut{i}")
    cuts = small(left.select(F.col("source").alias("s"), *[f"cut{i}" for i in range(level)]))
    cells = sized.join(cuts, inside).groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
    own = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("words").over(own)).select(F.col("source").alias("s"), "bucket", "words", "upto")
    met = left.join(cells, F.col("source").eqNullSafe(F.col("s")), "left")
    counts = F.col("upto") - F.col("words") / 2 <= F.col("rest") if level == len(LEVELS) - 1 else F.col("upto") <= F.col("rest")
    keep = [c for c in left.columns if c != "rest"]
    ended = met.groupBy(*keep, "rest").agg(F.min(F.when(~counts, F.col("bucket"))).alias("next"), F.max(F.when(counts, F.col("upto"))).alias("taken"))
    return ended.select(*keep, F.coalesce("next", F.lit(16**6)).alias(f"cut{level}"), (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"))


def mix(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as :func:`take` says, columns unchanged, whatever their names.

    The decision depends on (doc_id, text, source) alone, so rows that repeat these are all taken alike. Each row is decided
    by its own hash and its source's thresholds, so no text is shuffled. Nulls and empty tables as in :func:`take`.
    """
    _, cuts = _budgets(docs, most)
    cuts = cuts.select("__source", F.col("passes").alias("__passes"), *[F.col(f"cut{i}").alias(f"__cut{i}") for i in range(len(LEVELS))])
    met = docs.join(small(cuts), docs["source"].eqNullSafe(F.col("__source")))
    copies = _copies(most, _hash(docs["doc_id"], docs["text"]), "__passes", "__cut")
    return met.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("__copy")).drop("__copy")
