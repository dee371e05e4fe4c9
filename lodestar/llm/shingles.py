"""Word shingles as sorted 64-bit sets, and their cut into fragments of the global n-gram order.

The global order of n-grams is the order of their 64-bit hashes, so a fragment is a range of hash
values and needs no table of frequencies. Everything here works on one text at a time inside a task.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= _LONG:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside ASCII white space, with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts, n: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of many texts, one after another, and where each begins.

    A text of fewer words gives one shingle for all its words, a text without words none.
    """
    words = [words_of(x) for x in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate(([0], np.cumsum(size)))
    w = np.fromiter((hashes[x] for ws in words for x in ws), np.uint64, int(at[-1]))
    sets = []
    with np.errstate(over="ignore"):
        h = np.full(max(len(w) - n + 1, 0), np.uint64(n) * _STEP, np.uint64)
        for j in range(n):
            h = (h + w[j : j + len(h)]) * _M1
        h = mix(h)
        for i, m in enumerate(size):
            if m >= n:
                sets.append(_distinct(h[at[i] : at[i + 1] - n + 1]))
            elif m:
                x = np.uint64(m) * _STEP
                for y in w[at[i] : at[i + 1]]:
                    x = (x + y) * _M1
                sets.append(mix(np.array([x])))
            else:
                sets.append(np.empty(0, np.uint64))
    start = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), start


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], n, hashes)[0]


def batches(frames, column: str, words: int = 150_000):
    """Cuts the frames of a mapInPandas iterator so that none holds many more bytes than so many words."""
    for frame in frames:
        size = np.cumsum([len(x) if x else 0 for x in frame[column]]) // (6 * words)
        for _, part in frame.groupby(size, sort=False):
            yield part


def digests(s: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit numbers for each set that stand for all of it; 0 for an empty set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(x), dtype=np.uint64))) for x in (s ^ _STEP, s + _M1)]
        a, b = ((x[start[1:]] - x[start[:-1]]).view(np.int64) for x in sums)
    return a, b


class Cuts:
    """How sets of each size are cut so that two similar sets share a fragment as a whole.

    Sets x and y with Jaccard similarity t or more differ in at most (1-t)/(1+t)*(|x|+|y|) members.
    Sizes are split into classes [l, 1.5 l). A pair is looked for in the class of its smaller set,
    where it differs in at most ``most`` members; the order is cut into clearly more fragments, so
    at least one non-empty fragment holds the same members in both sets. A set of which too many
    fragments are empty also gives the fragment -1, where such sets meet.
    """

    GROWTH = 1.5

    def __init__(self, threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        self.t = threshold

    def size_class(self, size: int) -> int:
        c = int(np.log(size) / np.log(self.GROWTH))
        while self.low(c + 1) <= size:
            c += 1
        while self.low(c) > size:
            c -= 1
        return c

    def low(self, c: int) -> int:
        return int(np.ceil(self.GROWTH**c - 1e-9))

    def classes(self, size: int) -> list[int]:
        """Its own class as the smaller set, and those where it can be the larger one."""
        own, smallest = self.size_class(size), max(1, int(np.ceil(size * self.t - 1e-9)))
        return list(range(self.size_class(smallest), own + 1))

    def most(self, c: int) -> int:
        """The most members in which a pair of class c differs."""
        top = max(self.low(c + 1) - 1, 1)
        return int((1 - self.t) / (1 + self.t) * (top + top / self.t) + 1e-9)

    def own_most(self, size: int) -> int:
        """The most members in which a set of this size differs from any similar one."""
        return int((1 - self.t) / (1 + self.t) * (size + size / self.t) + 1e-9)

    def fragments(self, c: int) -> int:
        m = self.most(c)
        return 1 if m == 0 else int(1.14 * m) + 5

    def signatures(self, s: np.ndarray, start: np.ndarray):
        """For sets one after another: (set, class, least number of signatures shared with a similar set, signatures).

        A signature is a signed 64-bit hash of a class, a fragment and the fragment's members.
        """
        size = np.diff(start)
        classes = [self.classes(int(x)) if x else [] for x in size]
        out = []
        with np.errstate(over="ignore"):
            scrambled = mix(s ^ _M2)
            for r in range(max(map(len, classes), default=0)):
                own = np.flatnonzero([len(x) > r for x in classes])
                c = np.array([classes[i][r] for i in own])
                known = {int(x): (self.fragments(int(x)), self.most(int(x))) for x in np.unique(c)}
                k = np.array([known[int(x)][0] for x in c], np.uint64)
                whole = len(own) == len(size)
                pick = slice(None) if whole else np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
                rank = np.repeat(np.arange(len(own)), size[own])
                f = ((s[pick] >> np.uint64(32)) * k[rank]) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (rank[1:] != rank[:-1]))))
                total = np.add.reduceat(scrambled[pick], first)
                of = rank[first]
                key = (c[of] + 1).astype(np.uint64) * _STEP + f[first] * _M1
                signature = mix(total + mix(key)).view(np.int64)
                ends = np.searchsorted(of, np.arange(len(own) + 1))
                for j, i in enumerate(own):
                    mine = signature[ends[j] : ends[j + 1]]
                    least = len(mine) - min(known[int(c[j])][1], self.own_most(int(size[i])))
                    if least < 1:
                        mine, least = np.append(mine, mix((c[j : j + 1] + 1).astype(np.uint64) * _M2).view(np.int64)), 1
                    out.append((int(i), int(c[j]), least, mine))
        return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
