"""Periodic runs of words, found as maximal pairs in the LCP-interval tree of each text.

A run of period q is a maximal pair: its words from the start and its words from q further on are the same stretch, which
can grow neither to the left, as the words before the two occurrences differ, nor to the right, as the words after them
do. So the tree of LCP intervals is walked bottom up; each node keeps the places where its stretch of words occurs, in
lists by the word to their left, and where children meet, pairs of places from lists of different words are maximal. Only
those count whose distance is at most a third of the stretch (the run then has at least four periods), and these are runs
as they are: nothing is extended or compared again.

Why few places need a look: occurrences of a stretch of l words that are at most l/3 apart follow each other at equal
steps, so all but the first of them have the same word to their left. Of the places in reach before a new one only the
least can make a pair with it, and those in reach after it are all of one list.

Suffixes are ordered by prefix doubling for many texts at once, and only in texts in which five words in a row occur twice.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _M1, WordHashes, batches, mix

#: The least length of a run, the least number of its periods, and the shortest stretch that both ask of a maximal pair.
LEAST, PERIODS, SHORTEST = 6, 4, 5
#: Up to so many places a node is a plain list, which is looked through.
PLAIN = 12
CHUNK = 1000


class Ordered:
    """Places in order, in chunks, so that adding one moves no more than a chunk."""

    def __init__(self, places: list[int]):
        places = sorted(places)
        self.chunks = [places[i : i + CHUNK] for i in range(0, len(places), CHUNK)]
        self.last = [c[-1] for c in self.chunks]

    def add(self, p: int) -> None:
        k = min(bisect_left(self.last, p), len(self.last) - 1)
        chunk = self.chunks[k]
        insort(chunk, p)
        self.last[k] = chunk[-1]
        if len(chunk) > 2 * CHUNK:
            self.chunks[k : k + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.last[k : k + 1] = [chunk[CHUNK - 1], chunk[-1]]

    def first(self, low: int, high: int) -> int | None:
        """The least place in [low, high)."""
        k = bisect_left(self.last, low)
        if k < len(self.last):
            chunk = self.chunks[k]
            p = chunk[bisect_left(chunk, low)]
            return p if p < high else None
        return None

    def between(self, low: int, high: int) -> Iterator[int]:
        """All places in [low, high)."""
        for k in range(bisect_left(self.last, low), len(self.last)):
            chunk = self.chunks[k]
            yield from chunk[bisect_left(chunk, low) : bisect_left(chunk, high)]
            if chunk[-1] >= high:
                break

    def __iter__(self):
        return (p for c in self.chunks for p in c)


class Places:
    """The places of one node: all in order, and in a list for each word to their left."""

    def __init__(self, places: list[int], left: list[int]):
        self.left, self.size, self.all = left, len(places), Ordered(places)
        by: dict[int, list[int]] = {}
        for p in places:
            by.setdefault(left[p], []).append(p)
        self.by = {word: Ordered(own) for word, own in by.items()}

    def add(self, p: int) -> None:
        self.size += 1
        self.all.add(p)
        own = self.by.get(self.left[p])
        if own:
            own.add(p)
        else:
            self.by[self.left[p]] = Ordered([p])

    def pairs(self, p: int, reach: int) -> Iterator[tuple[int, int]]:
        """(earlier, later) of the new place p and places within reach that have another word to their left."""
        before = self.all.first(p - reach, p)
        if before is not None and self.left[before] != self.left[p]:
            yield before, p
        after = self.all.first(p + 1, p + reach + 1)
        if after is not None and self.left[after] != self.left[p]:
            for q in self.by[self.left[after]].between(after, p + reach + 1):
                yield p, q


def _met(a, b, length: int, left: list[int], found: dict):
    """The places of two children together; pairs across that are runs go to ``found``: (start, length) with the least period."""
    reach = length // (PERIODS - 1)
    if isinstance(a, list) and isinstance(b, list):
        for p in a:
            for q in b:
                if -reach <= q - p <= reach and left[p] != left[q]:
                    _run(min(p, q), abs(q - p), length, found)
        a.extend(b)
        return a if len(a) <= PLAIN else Places(a, left)
    if isinstance(a, list) or isinstance(b, Places) and b.size > a.size:
        a, b = b, a
    rest = b if isinstance(b, list) else list(b.all)
    for p in rest:
        for x, y in a.pairs(p, reach):
            _run(x, y - x, length, found)
    for p in rest:
        a.add(p)
    return a


def _run(start: int, period: int, length: int, found: dict) -> None:
    length += period
    if length >= LEAST and period < found.get((start, length), length):
        found[start, length] = period


def _tree(places: list[int], shared: list[int], left: list[int], found: dict) -> None:
    """Walks the LCP intervals of suffixes in order bottom up; shared[i] is what places[i] and places[i + 1] have in common."""
    stack: list[list] = []
    now = [places[0]]
    for i, length in enumerate(shared):
        while stack and stack[-1][0] > length:
            deeper, node = stack.pop()
            now = _met(node, now, deeper, left, found)
        if stack and stack[-1][0] == length:
            stack[-1][1] = _met(stack[-1][1], now, length, left, found)
        else:
            stack.append([length, now])
        now = [places[i + 1]]
    while stack:
        deeper, node = stack.pop()
        now = _met(node, now, deeper, left, found)


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the suffixes of a sequence in order, and how many words each has in common with the one before it.

    The words are numbers from 0; every number below 0 is an end mark that equals nothing, itself included. Prefix doubling:
    suffixes that begin with the same k words have one rank, which is the place of the first of them, and only those that
    aren't alone are ordered anew. The ranks of all lengths k are kept, and give what neighbours share by halving.
    """
    n = len(words)
    marks = words < 0
    key = np.where(marks, words.max(initial=0) + 1 + np.cumsum(marks), words)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.empty(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [], 1
    while True:
        levels.append(rank.astype(np.int32 if n < 2**31 else np.int64))
        sizes = np.bincount(rank, minlength=n)
        at = np.flatnonzero(sizes[rank] > 1)
        if not len(at):
            break
        key = rank[at] * (n + 1) + rank[at + k]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        group = rank[at]
        starts = np.concatenate(([True], group[1:] != group[:-1]))
        i = np.arange(len(at))
        place = group + i - np.maximum.accumulate(np.where(starts, i, 0))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        order[place] = at
        rank[at] = place[np.maximum.accumulate(np.where(new, i, 0))]
        k *= 2
    shared = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[min(2, len(levels) - 1)][order[1:]] == levels[min(2, len(levels) - 1)][order[:-1]]) + 1
    a, b, same = order[pairs - 1], order[pairs], np.zeros(len(pairs), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        on = np.flatnonzero(levels[j][a + same] == levels[j][b + same])
        same[on] += 1 << j
    shared[pairs] = same
    return order, shared


def _may_run(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some stretch of SHORTEST words occurs twice."""
    n = max(len(hashes) - SHORTEST + 1, 0)
    with np.errstate(over="ignore"):
        h = (of[:n].astype(np.uint64) + np.uint64(1)) * _M1
        for j in range(SHORTEST):
            h = (h + hashes[j : j + n]) * _M1
    own = of[:n] == of[SHORTEST - 1 :]
    h, of = mix(h[own]), of[:n][own]
    by = np.argsort(h)
    again = h[by][1:] == h[by][:-1]
    return np.unique(of[by][1:][again])


def runs_of(texts: list[list[bytes]], hashes: WordHashes) -> list[list[tuple[int, int, int]]]:
    """For the words of each text its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    some = _may_run(np.fromiter((hashes[w] for t in texts for w in t), np.uint64, len(of)), of).tolist()
    if not some:
        return out
    ids: dict[tuple[int, bytes], int] = {}
    left, start, number = [], [], []
    for k in some:
        ids.clear()
        first = number[-1] if number else 0
        start.append(len(left))
        own = [first + ids.setdefault(w, len(ids)) for w in texts[k]]
        left += [*own, -1]
        number.append(first + len(ids))
    words = np.array(left)
    order, shared = suffixes(words)
    deep = shared >= SHORTEST
    begins = np.flatnonzero(deep & ~np.concatenate(([False], deep[:-1])))
    ends = np.flatnonzero(deep & ~np.concatenate((deep[1:], [False]))) + 1
    doc = np.searchsorted(np.array(start), order[begins], "right") - 1
    before = [-1, *left]  # the word to the left of each place; ends of texts are -1
    order, shared = order.tolist(), shared.tolist()
    found: dict[int, dict] = {}
    for d, x, y in zip(doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
        _tree(order[x - 1 : y], shared[x:y], before, found.setdefault(d, {}))
    for d, own in found.items():
        s = start[d]
        out[some[d]] = sorted((a - s, length, q) for (a, length), q in own.items())
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for frame in batches(frames, "text"):
        texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in frame["text"]]
        runs = runs_of(texts, hashes)
        yield pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "n_words": [len(t) for t in texts],
                "runs": [[{"start": a, "length": b, "period": q} for a, b, q in own] for own in runs],
                "collapsed": [b" ".join(collapsed(t, own)).decode("utf-8", "surrogatepass") for t, own in zip(texts, runs, strict=True)],
            }
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds all runs in the words (stretches outside ASCII white space) of each text: one row per row of ``docs``.

    Returns doc_id long, n_words long, runs array<struct<start long, length long, period long>> by start, then period, and
    collapsed string: the words joined by one space, without those that any run holds after its first period. A run is a
    stretch of words with smallest period q, of at least six words and four periods, that no neighbouring word extends
    with that period. A null, empty or blank text has no words, no runs and the collapsed text "". Null and repeated ids are
    rows like others; other columns are ignored, whatever their names. An empty table gives no rows. A task holds one batch
    of texts, or one text that is longer than a batch, and time grows as n log n with the words of a text.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(_rows, "doc_id string, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
