"""Substring dedup: a count-min sketch leaves out the windows that are there once, an exact pass decides about the rest.

A window is a number of consecutive words. Texts are dealt into portions of bounded size. Each portion makes its own
count-min sketch of its windows: DEPTH rows of cells, so many that few different windows share one. As a portion fills
few of the cells, it sends sorted cell numbers, about two bytes each, by ranges of the row. Where the portions' sketches of
a range meet, they are added up, and each portion is told which of its own cells count twice or more; so the merged sketch
is never in one place, and its width follows the number of windows. A cell counts at least as much as any of its windows,
so a window with a cell below two is there once and is left out.

The others form stretches of consecutive windows within a text, and equal stretches are grouped first: one of each goes
on with its count. Its windows are grouped by 128-bit hashes, and a window whose group has a count of one was estimated
too high; that group names its only place. Repeated windows are the stretches without these places, so hot windows are
only ever added up, never gathered or joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stage
from .shingles import WordHashes, mix

#: Rows of the sketch, and its cells for each window; a lone window is estimated as repeated about once in 280.
DEPTH, CELLS = 2, 16
#: Texts of a portion, as a power of two; windows of one sketch, at most about; windows whose cells make a range, at least about.
PORTION_BITS = 10
SKETCHED = 2_000_000
RANGE = 500_000
#: Odd factors of the two window hashes.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_SEED = np.uint64(0x2545F4914F6CDD1D)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


def windows(words: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, h0, h1): where windows of k words begin and two 64-bit hashes of each, for texts one after another that end at ``ends``.

    A hash is a difference of sums of word * factor**i, divided by the factor to the power of the window's place.
    """
    n = len(words)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    last = np.maximum(ends - k + 1, starts)
    steps = np.zeros(n + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.add.at(steps, last, -1)
    at = np.flatnonzero(np.cumsum(steps[:n]))
    hashes = []
    with np.errstate(over="ignore"):
        for turn, factor in enumerate(FACTORS):
            w = words if not turn else mix(words ^ _SEED)
            total = np.concatenate(([np.uint64(0)], np.cumsum(w * np.cumprod(np.full(n, factor)), dtype=np.uint64)))
            back = np.cumprod(np.full(n, _inverse(factor)))
            hashes.append(mix((total[at + k] - total[at]) * back[at]))
    return at, *hashes


def _encoded(cells: np.ndarray) -> tuple[int, int, bytes]:
    """Sorted distinct cells as the first, how many there are, and the steps between them in as few bytes as the largest needs."""
    steps = np.diff(cells)
    most = int(steps.max(initial=np.uint64(0)))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    return int(cells[:1].view(np.int64)[0]), len(cells), steps.astype(kind).tobytes()


def _decoded(first: int, n: int, steps: bytes) -> np.ndarray:
    step = np.frombuffer(steps, f"u{len(steps) // (n - 1)}") if n > 1 else np.empty(0, np.uint64)
    return np.cumsum(np.concatenate((np.array([first], np.int64).view(np.uint64), step.astype(np.uint64))), dtype=np.uint64)


class _Shape:
    """How the cells of a row are numbered and cut into ranges; both counts are powers of two."""

    def __init__(self, n_windows: int):
        self.bits = max(20, (CELLS * max(n_windows, 1) - 1).bit_length())
        self.ranges = max(8, (n_windows // RANGE).bit_length())

    def cells(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def range_of(self, cells: np.ndarray) -> np.ndarray:
        return cells >> np.uint64(self.bits - self.ranges)


def _words(texts, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts one after another, unchanged but for white space, and where each text ends."""
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((hashes[w] for own in words for w in own), np.uint64, int(size.sum())), np.cumsum(size)


def _cut(frames: Iterator[pd.DataFrame], words: int = 150_000) -> Iterator[pd.DataFrame]:
    """The rows of one portion at a time, and not many more bytes than so many words have."""
    for frame in frames:
        size = np.cumsum([len(t) if t else 0 for t in frame["text"]]) // (6 * words)
        for _, part in frame.groupby([frame["portion"], size], sort=False, dropna=False):
            yield part


def _sketches(k: int, shape: _Shape):
    """(row, part, portion, first, n, steps): the sketch of a portion, by ranges; cells that it has several times come twice."""

    def flush(portion: int, parts: list) -> Iterator[pd.DataFrame]:
        out = []
        for row in range(DEPTH):
            cells = np.sort(shape.cells(np.concatenate([p[row] for p in parts])))
            new = np.concatenate(([True], cells[1:] != cells[:-1]))
            several = np.flatnonzero(new & ~np.concatenate((new[1:], [True])))
            for again, some in ((False, cells[new]), (True, cells[several])):
                parts_of = shape.range_of(some)
                cuts = np.flatnonzero(np.concatenate(([True], parts_of[1:] != parts_of[:-1])))[: len(some)]
                for x, y in pairwise([*cuts, len(some)]):
                    out.append((row, int(parts_of[x]), portion, again, *_encoded(some[x:y])))
        yield pd.DataFrame(out, columns=["row", "part", "portion", "again", "first", "n", "steps"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, portion, parts, held = WordHashes(), None, [], 0
        for frame in _cut(frames):
            now = int(frame["portion"].iloc[0])
            if held and (now != portion or held > SKETCHED):
                yield from flush(portion, parts)
                parts, held = [], 0
            portion = now
            _, *h = windows(*_words(frame["text"], hashes), k)
            if len(h[0]):
                parts.append(h)
                held += len(h[0])
        if held:
            yield from flush(portion, parts)

    return run


def _merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Adds up the sketches of one range and tells each portion its own cells that count twice or more."""
    cells = [_decoded(*x) for x in zip(frame["first"], frame["n"], frame["steps"], strict=True)]
    all_cells = np.sort(np.concatenate(cells))
    twice = all_cells[1:][all_cells[1:] == all_cells[:-1]]
    out = []
    for portion, again, own in zip(frame["portion"], frame["again"], cells, strict=True):
        if not again and len(twice):
            at = np.searchsorted(twice, own)
            at[at == len(twice)] = 0
            known = own[twice[at] == own]
            if len(known):
                out.append((portion, key[0], *_encoded(known)))
    return pd.DataFrame(out, columns=["portion", "row", "first", "n", "steps"])


def _in(sorted_cells: np.ndarray, cells: np.ndarray) -> np.ndarray:
    if not len(sorted_cells):
        return np.zeros(len(cells), bool)
    at = np.searchsorted(sorted_cells, cells)
    at[at == len(sorted_cells)] = 0
    return sorted_cells[at] == cells


def _stretches(k: int, shape: _Shape):
    """(row, start, n, s0, s1, hashes) of the stretches of windows estimated as repeated; rows come by portion, what it was told first.

    The hashes of the windows are given for the first of equal stretches of a portion; s0 and s1 stand for all of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, portion, told, known, seen = WordHashes(), None, [], None, set()
        for frame in _cut(frames):
            if int(frame["portion"].iloc[0]) != portion:
                portion, told, known, seen = int(frame["portion"].iloc[0]), [[] for _ in range(DEPTH)], None, set()
            for row, *x in frame.loc[frame["kind"] == 0, ["sketch", "first", "n", "steps"]].itertuples(index=False):
                told[row].append(_decoded(*x))
            texts = frame[frame["kind"] == 1]
            if not len(texts):
                continue
            if known is None:
                known = [np.unique(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in told]
            words, ends = _words(texts["text"], hashes)
            at, *h = windows(words, ends, k)
            some = np.logical_and.reduce([_in(c, shape.cells(x)) for c, x in zip(known, h, strict=True)])
            at, h = at[some], [x[some] for x in h]
            if not len(at):
                continue
            of = np.searchsorted(ends, at, "right")
            cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))))
            sums = [np.add.reduceat(mix(x ^ _SEED), cuts).view(np.int64) for x in h]
            begins = np.concatenate(([0], ends[:-1]))[of[cuts]]
            rows, out = texts["row"].to_numpy(np.int64), []
            for i, (x, y) in enumerate(pairwise([*cuts.tolist(), len(at)])):
                own = (y - x, int(sums[0][i]), int(sums[1][i]))
                both = None if own in seen else np.stack([z[x:y] for z in h], 1).view(np.int64).ravel()
                seen.add(own)
                out.append((rows[of[x]], int(at[x] - begins[i]), *own, both))
            yield pd.DataFrame(out, columns=["row", "start", "n", "s0", "s1", "hashes"])

    return run


def _spans(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, stretches, lone in zip(frame["row"], frame["stretches"], frame["lone"], strict=True):
                at = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in stretches])
                at = np.sort(at if lone is None else np.setdiff1d(at, np.asarray(lone)))
                if len(at):
                    cuts = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + k)))
                    out.append((row, [{"start": int(at[x]), "end": int(at[y - 1]) + k} for x, y in pairwise([*cuts, len(at)])]))
            yield pd.DataFrame(out, columns=["row", "spans"])

    return run


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        n, removed, kept = [], [], []
        for text, spans in zip(frame["text"], frame["spans"], strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            n.append(len(words))
            removed.append(sum(s["end"] - s["start"] for s in spans) if spans is not None else 0)
            for s in reversed(spans if spans is not None else []):
                del words[s["start"] : s["end"]]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": n, "n_removed": removed, "spans": [[] if s is None else list(s) for s in frame["spans"]], "kept": kept})


def remove_repeats(docs: DataFrame, k: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a window of k words covers whose words also start anywhere else, in the same text or another.

    Words are stretches outside ASCII white space, compared as they are. Returns one row per row of ``docs``: doc_id long,
    n_words long, n_removed long, spans array<struct<start long, end long>> (words removed, end exclusive, in order and
    apart) and kept string (the other words joined by one space). Windows are judged on the input, so no copy of a repeated
    window stays, the first included. Rows are texts of their own: rows that repeat an id and a text remove each other.
    A text that is null, empty, blank or shorter than k words has no window and stays whole. Null ids are kept; other columns
    are ignored, whatever their names. An empty table gives no rows. Exact but for collisions of 128-bit hashes.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "repeats")
    row = F.monotonically_increasing_id()
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), row.alias("row"))
    # Words are at least one byte and a space: half the bytes bound the windows from above, a sixth is about how many there are.
    texts = stage(texts.withColumn("portion", F.shiftright("row", PORTION_BITS)).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))))
    shape = _Shape((texts.agg(F.sum("bytes")).first()[0] or 0) // 6)

    sketches = texts.select("portion", "text").mapInPandas(_sketches(k, shape), "row int, part long, portion long, again boolean, first long, n int, steps binary")
    told = stage(sketches.groupBy("row", "part").applyInPandas(_merged, "portion long, row int, first long, n int, steps binary"))
    # Numbers that a kind of row has no use for are 0, as pandas would make doubles of a column with nulls.
    no = lambda kind, name: F.lit(0).cast(kind).alias(name)
    told = told.select("portion", no("int", "kind"), no("long", "row"), F.lit(None).cast("string").alias("text"), F.col("row").alias("sketch"), "first", "n", "steps")
    own = texts.select("portion", F.lit(1).alias("kind"), "row", "text", no("int", "sketch"), no("long", "first"), no("int", "n"), F.lit(None).cast("binary").alias("steps"))
    met = told.union(own).repartition("portion").sortWithinPartitions("portion", "kind", "row")
    found = stage(met.mapInPandas(_stretches(k, shape), "row long, start long, n long, s0 long, s1 long, hashes array<long>"))

    whole = found.groupBy("n", "s0", "s1").agg(F.count("*").alias("count"), F.min(F.when(F.col("hashes").isNotNull(), F.struct("row", "start"))).alias("one"))
    whole = stage(whole.select("one.row", "one.start", "count"))
    one = found.where("hashes is not null").select("row", "start", "hashes").join(_few(whole, whole.count()), ["row", "start"])
    places = one.select("row", "start", "count", F.posexplode(F.expr("transform(sequence(0, size(hashes) - 1, 2), i -> struct(hashes[i] as h0, hashes[i + 1] as h1))")).alias("i", "h"))
    groups = places.select("row", (F.col("start") + F.col("i")).alias("at"), "h.h0", "h.h1", "count").groupBy("h0", "h1").agg(F.sum("count").alias("n"), F.max("row").alias("row"), F.max("at").alias("at"))
    lone = groups.where("n = 1").groupBy("row").agg(F.collect_list("at").alias("lone"))
    stretches = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("stretches"))
    spans = stage(stretches.join(lone, "row", "left").mapInPandas(_spans(k), "row long, spans array<struct<start:long,end:long>>"))
    size = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    stage.drop(found, whole)
    done = texts.select("row", "doc_id", "text").join(_few(spans, size), "row", "left")
    out = done.select("doc_id", "text", "spans").mapInPandas(_kept, "doc_id string, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _few(df: DataFrame, size: int) -> DataFrame:
    """To broadcast if it is counted to hold few enough numbers; else a join shuffles."""
    return F.broadcast(df) if size <= BROADCAST_ROWS else df
