"""Conflict-constrained best-fit packing of documents into bins of bounded size.

Bins are ordered by what is left in them and carry bitmaps of their sources and duplicate clusters. A piece goes to
the tightest bin that holds it and is compatible: the search starts at the smallest sufficient residual and
goes on to the next until a bin's bitmaps allow the piece; if none does, a bin is opened. Bins stay open until they
are full. Pieces are dealt by hash over ranges of about so many pieces, each packed as a whole by one task. How many
ranges there are follows from the number of pieces, so bins don't depend on how Spark partitions the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage
from .mixing import word_count

#: Pieces of a hash range, about; the unit that a task packs and holds.
RANGE = 1 << 16
#: The most tasks that ranges are dealt over; it bounds tasks, not ranges, and bins don't depend on it.
TASKS = 20_000


class OpenBins:
    """Bins that aren't full, ordered by (residual, number), with bitmaps for each value that a conflict may arise from.

    A bitmap has one bit for each such value and bin. At worst, in a range of 65,536 pieces, 32,768 clusters of two make 130 MB to 270 MB.
    """

    def __init__(self, capacity: int, per_source: int, sources: int, clusters: int):
        self.capacity, self.count, self.open = capacity, 0, 0
        self.keys = np.zeros(256, np.int64)  # residual << 32 | number, sorted
        words = lambda n: -(-n // 64)
        self.once = [np.zeros((words(sources), 256), np.uint64) for _ in range(per_source)]  # which sources a bin holds once, twice, ...
        self.held = np.zeros((words(clusters), 256), np.uint64)

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """Position of the tightest compatible bin: successor after successor from the least sufficient residual, looked at in growing strides."""
        at, stride = int(np.searchsorted(self.keys[: self.open], size << 32)), 16
        while at < self.open:
            some = self.keys[at : min(at + stride, self.open)] & 0xFFFFFFFF
            clash = np.zeros(len(some), np.uint64)
            if source >= 0:
                clash |= self.once[-1][source // 64][some] & np.uint64(1 << source % 64)
            if cluster >= 0:
                clash |= self.held[cluster // 64][some] & np.uint64(1 << cluster % 64)
            first = int(np.argmin(clash != 0))
            if not clash[first]:
                return at + first
            at, stride = at + stride, stride * 4
        return None

    def add(self, size: int, source: int, cluster: int) -> int:
        """The bin that the piece goes to."""
        at = self.find(size, source, cluster)
        if at is None:
            number, left = self.count, self.capacity
            self.count += 1
            if number == self.held.shape[1]:
                wide = lambda x: np.concatenate([x, np.zeros_like(x)], axis=1)
                self.once, self.held, self.keys = [wide(x) for x in self.once], wide(self.held), np.concatenate([self.keys, np.zeros_like(self.keys)])
        else:
            left, number = divmod(int(self.keys[at]), 1 << 32)
            self.keys[at : self.open - 1] = self.keys[at + 1 : self.open].copy()
            self.open -= 1
        if source >= 0:
            bit = np.uint64(1 << source % 64)
            for seen in self.once:  # the first bitmap that lacks the source
                if not seen[source // 64, number] & bit:
                    seen[source // 64, number] |= bit
                    break
        if cluster >= 0:
            self.held[cluster // 64, number] |= np.uint64(1 << cluster % 64)
        if left > size:
            key = left - size << 32 | number
            at = int(np.searchsorted(self.keys[: self.open], key))
            self.keys[at + 1 : self.open + 1] = self.keys[at : self.open].copy()
            self.keys[at] = key
            self.open += 1
        return number


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int = 2) -> list[int]:
    """The bin of each piece, largest pieces first; a bin has at most ``per_source`` pieces of a source and one of a cluster.

    Pieces of equal size go by arrival, and of bins with equal residuals the first opened is taken. A piece of size 0 has bin -1.
    """
    # Only sources of more pieces than a bin takes, and clusters of several, can conflict; others need no bitmap and have number -1.
    source_of = {s: i for i, s in enumerate(s for s, n in Counter(sources).items() if n > per_source)}
    shared = {c: i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    bins = OpenBins(capacity, per_source, len(source_of), len(shared))
    out = [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if sizes[k] > 0:
            out[k] = bins.add(int(sizes[k]), source_of.get(sources[k], -1), shared.get(clusters[k], -1))
    return out


COLUMNS = ["bin_id", "doc_id", "piece", "first_word", "size", "source", "cluster"]


def _pack(capacity: int, per_source: int):
    def packed(frames: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(frames, ignore_index=True)
        sources = [None if pd.isna(x) else x for x in rows["source"]]
        bins = np.array(best_fit(rows["size"].tolist(), sources, rows["cluster"].tolist(), capacity, per_source), np.int64)
        return rows.assign(bin_id=np.where(bins < 0, -1, (rows["range"].to_numpy(np.int64) << 32) + bins))[COLUMNS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for number, part in frame.groupby("range", sort=True):
                if held and held[0]["range"].iloc[0] != number:
                    yield packed(held)
                    held = []
                held.append(part)
        if held:
            yield packed(held)

    return run


def text_cluster(text: str = "text") -> Column:
    """Hash of a text without regard to letter case and white space: copies share it."""
    return F.expr(f"xxhash64(regexp_replace(lower(coalesce({text}, '')), '\\\\s+', ' '))")


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, cluster: Column | None = None, per_range: int = RANGE) -> DataFrame:
    """Bins of at most ``capacity`` words: (bin_id, doc_id, piece, first_word, size, source, cluster), one row per piece.

    A document of more words is cut into full pieces and a rest; pieces of one document share its cluster, so they go to different
    bins. Documents without words (null, empty, blank) make one row of size 0 with bin_id -1. Repeated rows are counted, so that
    they are dealt apart, and packed each, into different bins. Null ids and sources are values like others. Ties go by a hash of the
    piece, so the bins follow from the rows alone. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("words"), (text_cluster() if cluster is None else cluster).alias("cluster"))
    rows = stage(rows.groupBy("doc_id", "source", "words", "cluster").agg(F.count("*").alias("copies")))
    made = rows.select("doc_id", "source", "cluster", "words", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    made = made.select("*", F.explode(F.expr(f"sequence(0, cast(greatest(words - 1, 0) div {capacity} as int))")).alias("piece"))
    total = rows.agg(F.sum(F.expr(f"copies * (greatest(words - 1, 0) div {capacity} + 1)"))).first()[0] or 0
    ranges = max(1, -(-total // per_range))
    size = F.expr(f"least(words - cast(piece as bigint) * {capacity}, {capacity})")
    made = made.select(*["doc_id", "source", "cluster", "piece"], (F.col("piece").cast("long") * capacity).alias("first_word"), size.alias("size"), F.xxhash64("doc_id", "source", "cluster", "copy", "piece").alias("hash"))
    made = made.withColumn("range", F.pmod("hash", F.lit(ranges)))
    dealt = made.repartition(min(ranges, TASKS), "range").sortWithinPartitions("range", F.desc("size"), "hash", "doc_id", "source", "cluster", "piece")
    return dealt.drop("hash").mapInPandas(_pack(capacity, per_source), "bin_id long, doc_id long, piece int, first_word long, size long, source string, cluster long")
