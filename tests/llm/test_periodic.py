import random

from lodestar.llm import periodic
from lodestar.llm.periodic import collapsed, periodic_runs, runs_of
from lodestar.llm.shingles import WordHashes

SCHEMA = "doc_id long, text string"


def brute_force(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]).encode() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            period = [rng.choice("abcxyz").encode() for _ in range(rng.randint(1, 9))]
            m = rng.randint(1, 60)
            words += (period * m)[:m] + [rng.choice("abcxyz").encode() for _ in range(rng.randint(0, 5))]
        yield words


def test_runs_equal_brute_force():
    many = list(texts(1, 600))
    found = runs_of(many, WordHashes())
    assert [brute_force(w) for w in many] == found
    assert sum(map(len, found)) > 300


def test_runs_equal_brute_force_in_large_nodes(monkeypatch):
    monkeypatch.setattr(periodic, "PLAIN", 1)
    monkeypatch.setattr(periodic, "CHUNK", 2)
    many = list(texts(2, 300))
    assert [brute_force(w) for w in many] == runs_of(many, WordHashes())


def test_long_runs_of_one_word_and_many_left_words():
    one = [b"a"] * 30_000
    lines = [w for i in range(5000) for w in (b"%d" % i, *b"the same line of seven words here".split())]
    nested = ([b"x", b"y"] * 4 + [b"z"]) * 3000
    found = runs_of([one, lines, nested, []], WordHashes())
    assert found[0] == [(0, 30_000, 1)] and found[1] == [] and found[3] == []
    assert (0, 27_000, 9) in found[2] and len(found[2]) == 3001


def test_collapsed_keeps_first_periods():
    words = b"a b c c c c c c d".split()
    runs = brute_force(words)
    assert runs == [(2, 6, 1)] and collapsed(words, runs) == b"a b c d".split()


def test_rows(spark):
    rows = [(1, "x " * 8), (None, None), (3, ""), (3, " \n\t "), (5, "a b c d e"), (1, "x " * 8), (6, "ä ö " * 6), (2**60 + 1, "A a A a A a A a")]
    df = spark.createDataFrame([(*r, "w") for r in rows], SCHEMA + ", runs string")
    found = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect())
    assert found == [(0, 0, [], ""), (1, 8, [(0, 8, 1)], "x"), (1, 8, [(0, 8, 1)], "x"), (3, 0, [], ""), (3, 0, [], ""), (5, 5, [], "a b c d e"), (6, 6, [(0, 6, 1)], "ä ö"), (2**60 + 1, 8, [(0, 8, 2)], "A a")]
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark, sf):
    import hashlib
    import re
    import zlib

    from lodestar.llm.queries import op11_periodic_runs

    found = {r["doc_id"]: r for r in op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(docs)
    some = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_force(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = found[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        some += bool(runs)
    assert some > 10
