"""Line deduplication by distinct-site spread.

A line that many sites show is boilerplate. Spread is the number of distinct sites of a line, estimated by one
HyperLogLog sketch per line hash; sketches merge in the aggregation. Lines near the threshold get an exact count.
Of a boilerplate line the corpus keeps the first copy (least doc_id, then position, then hash of the text); the others go.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stage, small

#: Relative distance from the threshold within which a sketch doesn't decide.
BAND = 0.25
#: The sites that make a line boilerplate: two may be a site and its mirror, or one quoting the other; a third is spread.
SITES = 3


def line_key(line: str) -> Column:
    """Hash of a line without spaces, tabs and carriage returns at its ends."""
    return F.expr(f"xxhash64(btrim({line}, ' \\t\\r'))")


def spread_lines(lines: DataFrame, sites: int, stage: Stage) -> DataFrame:
    """(key): lines of (key, site) that at least so many distinct sites show."""
    first = lines.groupBy("key").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count("*").alias("n"))
    met = first.where(f"n >= {sites} and ({sites} < 2 or low <> high)").select("key")
    some = stage(met)
    sketches = lines.join(small(some), "key", "left_semi").groupBy("key").agg(F.hll_sketch_agg("site", F.lit(12)).alias("sketch"))
    spread = stage(sketches.select("key", F.hll_sketch_estimate("sketch").alias("spread")))
    near = small(spread.where(F.abs(F.col("spread") - sites) <= BAND * sites).select("key"))
    exact = lines.join(near, "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {sites}").select("key")
    return stage(spread.where(F.col("spread") > sites * (1 + BAND)).select("key").union(exact))


def remove_boilerplate(docs: DataFrame, sites: int = SITES, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_removed`` (long).

    Lines are what \\n parts; a line counts as boilerplate if it has at least ``least_chars`` characters and at least ``sites``
    distinct sites show it. A null site is a site of its own. A null text stays null and has no lines; an empty one has one empty
    line. Rows with a null id keep their text, though their lines count. Rows that repeat an id with the same text
    are one document: a position goes from all of them; of an id with several texts each loses its own lines only. Other columns pass through, but for n_lines and n_removed. No rows give no rows.
    """
    stage = Stage(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("digest"), F.coalesce(F.xxhash64(site_col), F.lit(0)).alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line"))
    rows = rows.where(F.length(F.expr("btrim(line, ' \\t\\r')")) >= least_chars)
    lines = stage(rows.select("doc", "digest", "site", "at", line_key("line").alias("key")))
    spread = spread_lines(lines, sites, stage)
    hits = stage(lines.join(small(spread), "key").where("doc is not null").select("key", "doc", "at", "digest"))
    first = hits.groupBy("key").agg(F.min(F.struct("doc", "at", "digest")).alias("first"))
    extra = stage(hits.join(small(stage(first)), "key").where("struct(doc, at, digest) <> first").select("doc", "digest", "at").distinct())
    taken = extra.groupBy(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")).agg(F.collect_list("at").alias("__taken"))
    if extra.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(*keep).join(taken, (F.col(id_col) == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__digest")), "left")
    parts = F.split(text_col, "\n", -1)
    cut = F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (l, i) -> not array_contains(__taken, i)), '\\n')")
    measures = [F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("n_lines")]
    measures.append(F.when(F.col("__taken").isNull(), 0).otherwise(F.size("__taken")).cast("long").alias("n_removed"))
    return out.select(*[F.when(F.col("__taken").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in keep], *measures)
