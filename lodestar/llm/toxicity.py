"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's probability is a logistic function of its distinct words and their first bytes. A document is toxic if any sentence is,
so its probability is 1 - prod(1 - p). Weights are fitted by gradient steps on the documents' labels alone; the
same sentence scores then point to the sentences that made a document toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

#: The most labelled rows that a model is fitted on.
SAMPLE_ROWS = 5000
#: Words and first bytes that the model knows.
WORDS = 2000
_KNOWN = 100_000

_ENDS = b".!?\n\r"
_TABLE = bytes(10 if c in _ENDS else c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def sentences(text: str | None) -> list[bytes]:
    """Lower-cased sentences: runs between . ! ? and line ends, with all but letters blanked."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n") if text else []


def features(word: bytes) -> list[bytes]:
    """The word itself and its first 4 and 6 bytes."""
    return [word, *(b"^" + word[:n] for n in (4, 6) if len(word) > n)]


class WordWeights(dict):
    """Word -> summed weight of its features; forgets everything when it holds too many words."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.whole, self.four, self.six = ({k[cut:]: v for k, v in weights.items() if (k[:1] == b"^") == bool(cut) and (not cut or len(k) == n)} for cut, n in ((0, 0), (1, 5), (1, 7)))

    def __missing__(self, word: bytes) -> float:
        value = self.whole.get(word, 0.0) + (self.four.get(word[:4], 0.0) if len(word) > 4 else 0.0) + (self.six.get(word[:6], 0.0) if len(word) > 6 else 0.0)
        if len(self) > _KNOWN:
            self.clear()
        self[word] = value
        return value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class NoisyOr:
    """Word weights and bias of the sentence model; ``a`` and ``b`` calibrate a document's log-odds."""

    weights: dict[bytes, float]
    bias: float
    a: float = 1.0
    b: float = 0.0

    def sentence_scores(self, text: str | None, known: WordWeights | None = None) -> np.ndarray:
        """Probabilities of the sentences that hold a word, in order."""
        weight = (WordWeights(self.weights) if known is None else known).__getitem__
        return _sigmoid(self.bias + np.array([sum(map(weight, set(s.split()))) for s in sentences(text) if s and not s.isspace()]))

    def combine(self, scores: np.ndarray) -> float:
        """Noisy-or of sentence scores, calibrated; a text without sentences scores as if none were toxic."""
        p = -np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-9)).sum()) if len(scores) else 0.0
        p = min(max(p, 1e-9), 1 - 1e-9)
        return float(_sigmoid(self.a * np.log(p / (1 - p)) + self.b))


def sentence_sets(text: str | None) -> list[set[bytes]]:
    """The distinct words of each sentence that holds a word."""
    return [set(s.split()) for s in sentences(text) if s and not s.isspace()]


@dataclass(frozen=True)
class Bag:
    """What training needs of a document: its label, its sentences as the known features in them, each kind with its number, and the number of sentences without any."""

    label: int
    empty: int
    kinds: tuple[tuple[int, ...], ...]
    numbers: tuple[int, ...]


def bag(text: str | None, label: int, vocabulary: dict[bytes, int]) -> Bag:
    kinds: Counter = Counter()
    for words in sentence_sets(text):
        kinds[tuple(sorted(vocabulary[f] for w in words for f in features(w) if f in vocabulary))] += 1
    empty = kinds.pop((), 0)
    order = sorted(kinds)
    return Bag(label, empty, tuple(order), tuple(kinds[k] for k in order))


def share_of(labels: list[int]) -> NoisyOr:
    """A model that scores the share of toxic rows, 0 without rows."""
    share = sum(labels) / len(labels) if labels else 0.0
    return NoisyOr({}, -30.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def fit(bags: list[Bag], vocabulary: dict[bytes, int], steps: int = 300, rate: float = 0.05, decay: float = 2e-5) -> NoisyOr:
    """Fits the model by gradient steps. One class or no rows give a model that scores the share of toxic rows."""
    y = np.array([d.label for d in bags], float)
    if not len(y) or y.min() == y.max():
        return share_of([d.label for d in bags])
    empty = np.array([d.empty for d in bags], float)
    sets = [k for d in bags for k in d.kinds]
    doc_of = np.repeat(np.arange(len(bags)), [len(d.kinds) for d in bags])
    times = np.array([n for d in bags for n in d.numbers], float)
    col = np.array([f for k in sets for f in k], int)
    row = np.repeat(np.arange(len(sets)), [len(k) for k in sets])

    def log_none(p: np.ndarray, p_empty: float) -> np.ndarray:
        return np.bincount(doc_of, times * np.log1p(-p), len(y)) + empty * np.log1p(-p_empty)

    w, bias = np.zeros(len(vocabulary)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        p = _sigmoid(bias + np.bincount(row, w[col], len(sets)))
        p_empty = _sigmoid(bias)
        doc = np.clip(-np.expm1(log_none(p, p_empty)), 1e-9, 1 - 1e-9)
        # The loss is the documents' mean log loss. By log_none = log(1 - doc) its slope is as follows, and d(log_none)/d(logit) = -p.
        slope = (y * (1 - doc) / doc - (1 - y)) / len(y)
        by_kind = slope[doc_of] * -p * times
        g = np.bincount(col, by_kind[row], len(w)) + decay * w
        gb = by_kind.sum() - (slope * empty).sum() * p_empty
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    w[np.abs(w) <= 1e-3] = 0
    raw = np.clip(-np.expm1(log_none(np.minimum(_sigmoid(bias + np.bincount(row, w[col], len(sets))), 1 - 1e-9), _sigmoid(bias))), 1e-9, 1 - 1e-9)
    a, b = _platt(np.log(raw / (1 - raw)), y)
    return NoisyOr({x: float(w[i]) for x, i in vocabulary.items() if w[i]}, float(bias), a, b)


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps."""
    a, b = 1.0, 0.0
    x = np.clip(x, -12, 12)
    for _ in range(30):
        p = _sigmoid(a * x + b)
        r, s = y - p, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(r * x).sum(), r.sum()])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return max(float(a), 0.05), float(b)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic): distinct texts of at most ``rows`` labelled ids, chosen by hash of those whose crc32(doc_id as text) mod 4 is not 2.

    Of an id that rows repeat one text is taken, the least; of several labels of an id or a text the largest counts.
    """
    marks = labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for text, label in zip(frame["text"], frame["toxic"], strict=True):
            yield pd.DataFrame({"feature": sorted({f for words in sentence_sets(text) for w in words for f in features(w)}), "toxic": label})


def train(sample: DataFrame, words: int = WORDS) -> NoisyOr:
    """Fits the model on (text, toxic). Tasks count features by label, and then turn texts into bags of the chosen ones; the driver gets the chosen features and the bags."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return share_of([y for y, times in n.items() for _ in range(times)])
    counts = sample.mapInPandas(_features, "feature binary, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
    gain = F.expr(f"abs(ln(((n1 + 0.5D) / {n[1] + 1}) / ((n - n1 + 0.5D) / {n[0] + 1}))) * sqrt(n)")
    best = counts.where("n >= 5").orderBy(F.round(gain, 9).desc(), "feature").limit(words).collect()
    vocabulary = {bytes(r["feature"]): i for i, r in enumerate(best)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text, label in zip(frame["key"], frame["text"], frame["toxic"], strict=True):
                b = bag(text, label, vocabulary)
                yield pd.DataFrame({"key": [key], "label": [b.label], "empty": [b.empty], "kinds": [[list(k) for k in b.kinds]], "numbers": [list(b.numbers)]})

    made = sample.select(F.sha2("text", 256).alias("key"), "text", "toxic").mapInPandas(run, "key string, label int, empty long, kinds array<array<int>>, numbers array<int>")
    bags = sorted(made.collect(), key=lambda r: r["key"])
    return fit([Bag(r["label"], r["empty"], tuple(map(tuple, r["kinds"])), tuple(r["numbers"])) for r in bags], vocabulary)


def _score(model: NoisyOr, spans: float):
    @F.pandas_udf("score double, n_sentences long, toxic_sentences array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordWeights(model.weights)
        for some in texts:
            rows = []
            for text in some:
                p = model.sentence_scores(text, known)
                rows.append((model.combine(p), len(p), np.flatnonzero(p >= spans)))
            yield pd.DataFrame(rows, columns=["score", "n_sentences", "toxic_sentences"])

    return run.asNondeterministic()  # so that a filter on the score doesn't compute it again


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sentence_threshold: float = 0.3, rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Scores whole texts: the columns to keep (doc_id), score (0 to 1), n_sentences, toxic_sentences (their numbers from 0), predicted (score >= threshold).

    The model learns from ``labels`` (doc_id, toxic) of at most ``rows`` documents outside the held-out quarter; only
    texts are inputs of a score. Null, empty and blank texts have no sentences and get the lowest score. Rows that repeat
    are scored alike and stay, rows with a null doc_id too; other columns are ignored, and a kept one named as a result is
    replaced by it. Without labels every score is that of a share of zero. Labels: a null is left out, and of several for
    one document the largest counts. Only texts go to Python.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    sample = stage(training_sample(docs, labels, rows))
    model = train(sample)
    stage.drop(sample)
    made = ("score", "n_sentences", "toxic_sentences", "predicted")
    kept = [c for c in keep or ["doc_id"] if c not in made]
    out = docs.select(*kept, _score(model, sentence_threshold)("text").alias("__scored"))
    out = out.select(*kept, *[F.col(f"__scored.{c}").alias(c) for c in made[:3]])
    return out.withColumn("predicted", F.expr(f"cast(score >= {threshold} as int)"))
