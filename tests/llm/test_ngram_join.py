import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.ngram_join import similar_documents
from lodestar.llm.shingles import Cuts, WordHashes, overlap, shingle_set, shingle_sets

SCHEMA = "doc_id long, text string"


def brute(rows, n, t):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        own = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        sets.setdefault(i, []).append(own)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(i, s) for i, some in sets.items() for s in some]
    for a, (i, x) in enumerate(items):
        for j, y in items[a + 1 :]:
            if x and y and len(x & y) >= t * len(x | y) - 1e-9:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (max(map(len, s)), find(i)) for i, s in sets.items()}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 6, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            mine = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                mine[rng.randrange(len(mine))] = word()
            rows.append((i, " ".join(mine)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "x" * 100_000), (i + 4, "X" * 100_000), rows[0], rows[3]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "t"), [(4, 0.85), (5, 0.8)])
def test_equals_brute_force(spark, n, t):
    rows = corpus()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(spark.createDataFrame(rows, SCHEMA), n, t).collect()}
    assert found == brute(rows, n, t)


@pytest.mark.parametrize(("rounds", "hot"), [(1, 64), (4, 1)])
def test_large_group_of_near_copies(spark, monkeypatch, rounds, hot):
    import lodestar.llm.common as c
    import lodestar.llm.ngram_join as m

    monkeypatch.setattr(m, "FEW", 4)
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "ROUNDS", rounds)
    monkeypatch.setattr(m, "HOT", hot)
    monkeypatch.setattr(c, "ALL", 0 if hot == 1 else 100_000)
    monkeypatch.setattr(c, "HUB", 3)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        mine = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            mine[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(mine)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(spark.createDataFrame(rows, SCHEMA), 4, 0.85).collect()}
    assert found == brute(rows, 4, 0.85)


def test_empty_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, 1, "z"), (2, "a b c d e", 8, 2, "z"), (None, "a b c d e", 9, 3, "z")], "doc_id long, text string, n long, component_id long, signature string")
    assert sorted(map(tuple, similar_documents(df).collect())) == [(1, 1, 1), (2, 1, 1)]
    assert similar_documents(df.limit(0)).collect() == []
    assert similar_documents(spark.createDataFrame([(5, None)], SCHEMA)).collect()[0].asDict() == {"doc_id": 5, "n_shingles": 0, "component_id": 5}


@pytest.mark.parametrize("few", [24, 1])
def test_ids_with_several_texts_equal_brute_force(spark, monkeypatch, few):
    import lodestar.llm.ngram_join as m

    monkeypatch.setattr(m, "FEW", few)
    text = lambda w, k=40: " ".join(f"{w}{i}" for i in range(k))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (9, text("b") + " more"), (20, text("c")), (20, text("d")), (21, text("d") + " x"), (22, text("d") + " y"), (22, text("c")), (30, None), (30, text("e")), (31, text("e") + " z"), (31, text("f"))]
    rows += [(i % 40 + 100, t) for i, (_, t) in enumerate(corpus(8)[:160])]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(df, 4, 0.85).collect()}
    assert found == brute(rows, 4, 0.85)
    part = [r for r in rows if r[0] < 20]
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(part, SCHEMA), 4, 0.85).collect()} == {3: 3, 5: 3, 9: 3}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.lists(st.integers(0, 2**64 - 1), max_size=20), st.integers(0, 20), st.sampled_from([0.8, 0.85, 0.95]))
def test_similar_sets_share_a_signature(members, added, dropped, t):
    import numpy as np

    a = np.array(sorted(members), np.uint64)
    b = np.array(sorted(set(sorted(members)[min(dropped, len(members) - 1) :]) | set(added)), np.uint64)
    union = len(a) + len(b) - overlap(a, b)
    if overlap(a, b) < t * union:
        return
    made = {}
    for which, c, least, sig in Cuts(t).signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])):
        made.setdefault(c, {})[which] = (least, set(sig.tolist()))
    shared = [(len(x[0][1] & x[1][1]), max(x[0][0], x[1][0])) for x in made.values() if len(x) == 2]
    assert any(n >= least for n, least in shared)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_bitmaps_differ_in_no_more_bits_than_sets(x, y, both):
    import numpy as np

    from lodestar.llm.ngram_join import bitmaps

    a, b = (np.array(sorted(z | both), np.uint64) for z in (x, y))
    (p, p2), (q, q2) = bitmaps(a), bitmaps(b)
    assert 64 * len(p) >= 2 * len(a) and len(p2) == len(p) // 2
    if len(p) > len(q):
        p = p2
    if len(q) > len(p):
        q = q2
    if len(p) == len(q):
        assert np.bitwise_count(p.view(np.uint64) ^ q.view(np.uint64)).sum() <= len((x | both) ^ (y | both))


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = ["a b c d e f", None, "", "one two", "A B c D e f", "x " * 10]
    h = WordHashes()
    s, start = shingle_sets(texts, 4, h)
    for i, t in enumerate(texts):
        assert s[start[i] : start[i + 1]].tolist() == shingle_set(t, 4, h).tolist()
    assert s[start[0] : start[1]].tolist() == s[start[4] : start[5]].tolist()


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_signatures_are_not_written_and_only_members_of_pairs_travel(spark, monkeypatch):
    import lodestar.llm.ngram_join as m
    from lodestar.llm.common import Stage

    written, rng = [], random.Random(4)
    monkeypatch.setattr(Stage, "__call__", lambda self, df, f=Stage.__call__: (written.append(out := f(self, df)), out)[1])
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(400)] for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, texts[0][:-1] + ["x"], texts[1][:-1] + ["y"]])]
    found = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: c for i, c in found.items() if i != c} == {300: 0, 301: 1}
    assert written and not any("signatures" in t.columns for t in written)

    sets = spark.createDataFrame(rows, SCHEMA).withColumn("several", m.F.lit(False)).mapInPandas(m._sets(5), "doc_id long, which long, n long, bits array<long>, half array<long>, parts array<array<long>>")
    stage = Stage(spark, "test")
    sets = stage(sets)
    before = shuffled(spark)
    pairs = spark.createDataFrame([(0, 0, 300, 0)], "a long, which_a long, b long, which_b long")
    assert m._links(pairs, sets, 0.8, stage).collect() == [(0, 300)]
    # Bitmaps of all sets, 160 bytes a set, may travel; 300 sets of 396 members are 950 kB.
    assert shuffled(spark) - before < 200_000
