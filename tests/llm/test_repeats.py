import hashlib
import random
import re

import numpy as np

from lodestar.llm import repeats
from lodestar.llm.repeats import remove_repeats, windows

SCHEMA = "doc_id long, text string"


def brute_force(texts, k):
    seen, words = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for own in words:
        for i in range(len(own) - k + 1):
            w = tuple(own[i : i + k])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for own in words:
        gone = {j for i in range(len(own) - k + 1) if seen[tuple(own[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone), sorted(gone)))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "Beta", "ä", "x y", *(f"w{i}" for i in range(400))])
    passages = [[word() for _ in range(rng.randint(3, 40))] for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randint(0, 30))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [texts[3]] * 40 + [None, "", "  \n", "one two", passages[0][0], " ".join(["a"] * 50)]
    near = texts[5].split()
    texts += [" ".join([*near[:i], f"z{i}", *near[i:]]) for i in range(min(30, len(near)))]
    return texts


def check(spark, texts, k, **ids):
    rows = [(2**60 + i, t, "n", 1) for i, t in enumerate(texts)]
    found = remove_repeats(spark.createDataFrame(rows, SCHEMA + ", row string, n_words int").repartition(5), k=k).collect()
    by = {r["doc_id"] - 2**60: r for r in found}
    assert len(found) == len(by) == len(texts)
    expected = brute_force(texts, k)
    for i, (n, removed, kept, gone) in enumerate(expected):
        r = by[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (n, removed, kept)
        assert [j for s in r["spans"] for j in range(s["start"], s["end"])] == gone
    return expected


def test_equals_brute_force(spark):
    expected = check(spark, corpus(1), 8)
    assert 0 < sum(e[1] for e in expected) < sum(e[0] for e in expected)


def test_equals_brute_force_where_the_sketch_is_too_narrow_and_portions_are_small(spark, monkeypatch):
    monkeypatch.setattr(repeats._Shape, "cells", lambda self, h: h >> np.uint64(54))
    monkeypatch.setattr(repeats._Shape, "range_of", lambda self, c: c >> np.uint64(6))
    monkeypatch.setattr(repeats, "PORTION_BITS", 3)
    monkeypatch.setattr(repeats, "SKETCHED", 50)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    check(spark, corpus(2, 80), 5)


def test_a_sketch_of_the_usual_width_lets_few_lone_windows_pass():
    shape = repeats._Shape(10**6)
    h = np.random.default_rng(5).integers(0, 2**63, (2, 10**6)).astype(np.uint64) << np.uint64(1)
    passed = np.ones(10**6, bool)
    for row in h:
        cells = shape.cells(row)
        values, n = np.unique(cells, return_counts=True)
        passed &= repeats._in(values[n > 1], cells)
    assert passed.mean() < 0.005 and len(np.unique(shape.range_of(shape.cells(h[0])))) == 2**shape.ranges


def test_window_hashes_depend_on_the_words_alone():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 50).astype(np.uint64)
    words, ends = np.concatenate((w, w[:3], w[10:30], w[:0], w)), np.cumsum([50, 3, 20, 0, 50])
    at, a, b = windows(words, ends, 10)
    assert at.tolist() == [*range(41), *range(53, 64), *range(73, 114)]
    assert (a[:41] == a[-41:]).all() and (b[10:21] == b[41:52]).all() and len(set(a.tolist())) == 41
    assert len(windows(np.empty(0, np.uint64), np.array([0, 0]), 3)[0]) == 0


def test_cells_are_read_back():
    for top in (1, 2**7, 2**15, 2**30, 2**62):
        cells = np.unique(np.random.default_rng(2).integers(0, top, 100).astype(np.uint64) << np.uint64(1))
        assert (repeats._decoded(*repeats._encoded(cells)) == cells).all()


def test_rows_are_texts_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (None, text + " x"), (8, " ".join(f"v{i}" for i in range(40)))]
    found = sorted((r["doc_id"] or 0, r["n_removed"], r["kept"]) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(0, 40, "x"), (7, 40, ""), (7, 40, ""), (8, 0, rows[3][1])]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert remove_repeats(spark.createDataFrame([(1, None)], SCHEMA)).first()["kept"] == ""


def test_query_equals_brute_force(spark, sf):
    from lodestar.llm.queries import op13_substring_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in op13_substring_dedup(spark, sf).collect()}
    expected = brute_force([d["text"] for d in docs], 35)
    assert len(found) == len(docs) and sum(e[1] for e in expected) > 0
    for d, (n, removed, kept, _) in zip(docs, expected, strict=True):
        r = found[d["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
