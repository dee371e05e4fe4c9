"""An inverted index kept current by segments: small ones are added, runs of equal level are merged into larger ones.

A segment holds what a batch of changes says: its documents with a mark where they were deleted, their postings, and for each
term how many of them have it. A document's newest segment is the one that counts. When ``fanout`` segments have one
level, they become one of the next level, without what is overruled among them, and without marks of deletion once nothing
older is left to delete. So after n batches there are fewer than fanout * (1 + log(n) / log(fanout)) segments, and a reader
never goes through the log of all changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import term_counts, tokenize_words
from ..operators.windows import keep_first
from ..sources.shared import few, staged
from ..sources.snapshots import Part, Snapshots

TABLES = ("docs", "postings", "vocab")


def _segment(changes: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Documents, postings and vocab of a batch of (id, op, columns..., seq): the last change of each id counts.

    Words are counted within their text, so no posting is shuffled.
    """
    last = keep_first(changes, ["id"], [F.desc("seq")])
    words = F.when(F.col("op") != "delete", F.flatten(F.array(*[tokenize_words(F.col(c)) for c in columns])))
    counted = last.select(F.col("id").alias("doc_id"), words.alias("words")).select("doc_id", F.size("words").cast("long").alias("dl"), F.col("words").isNull().alias("deleted"), term_counts(F.col("words")).alias("terms"))
    cut = staged(counted, "segment")
    postings = cut.sortWithinPartitions("doc_id").select("doc_id", F.explode("terms").alias("x")).select("doc_id", "x.term", F.col("x.n").alias("tf"))
    vocab = cut.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return {"docs": cut.select("doc_id", "dl", "deleted"), "postings": postings, "vocab": vocab}


def _newest(table: Snapshots, parts: tuple[Part, ...]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, batch, dl, deleted) as the newest segment of each document has it, and (doc_id, batch) of those overruled."""
    docs = table.read(parts, "docs")
    latest = docs.groupBy("doc_id").agg(F.max(F.struct("batch", "dl", "deleted")).alias("x"), F.count("*").alias("n"))
    now = latest.select("doc_id", "x.batch", "x.dl", "x.deleted")
    old = docs.join(few(latest.where("n > 1").select("doc_id", F.col("x.batch").alias("last"))), "doc_id").where("batch < last")
    return now, old.select("doc_id", "batch")


def _live(table: Snapshots, parts: tuple[Part, ...], old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings that aren't overruled, and the document frequencies: what the segments count, less what is overruled."""
    postings, dead = table.read(parts, "postings"), few(staged(old, "overruled"))
    kept = postings.join(dead, ["doc_id", "batch"], "left_anti").drop("batch")
    less = postings.join(dead, ["doc_id", "batch"], "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
    vocab = table.read(parts, "vocab").select("term", "df").union(less).groupBy("term").agg(F.sum("df").alias("df"))
    return kept, vocab.where("df > 0")


def _merge(table: Snapshots, parts: tuple[Part, ...], oldest: bool) -> None:
    now, old = _newest(table, parts)
    kept, vocab = _live(table, parts, old)
    docs = now.drop("batch")
    table.merge(parts, {"docs": docs.where("not deleted") if oldest else docs, "postings": kept.sortWithinPartitions("doc_id"), "vocab": vocab})


def maintain_index(path: str, columns: list[str], writer: str = "stream", fanout: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step for (id, op, columns..., seq): changed documents are replaced, those with op ``delete`` go.

    Each stream that writes to one index names itself ``writer`` and its batches are applied once. Streams at the same time may
    write to one index if they change different documents; of a document the change that is published later counts.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table = Snapshots(batch.sparkSession, path, TABLES)
        if batch_id <= table.manifest().marks.get(writer, -1):
            return
        table.append(_segment(batch, columns), batch_id, writer)
        while True:
            parts = table.manifest().parts
            same = tuple(p for p in parts if p.level == parts[-1].level)
            if len(same) < fanout:
                break
            _merge(table, same, oldest=same == parts)

    return step


def current_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The index as of the newest snapshot: postings, doc_len and vocab."""
    table = Snapshots(spark, path, TABLES)
    parts = table.manifest().parts
    now, old = _newest(table, parts)
    postings, vocab = _live(table, parts, old)
    return {"postings": postings.select("doc_id", "term", "tf"), "doc_len": now.where("not deleted").select("doc_id", "dl"), "vocab": vocab}
