"""Packing, tokens and toxicity."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries as Q
from lodestar.llm.packing import best_fit, pack
from lodestar.llm.tokens import chars_within, prefix_tables, token_counts, tokenizer_path, tokens_at, tokens_total, truncated
from lodestar.llm.toxicity import Bag, bag, fit, score_documents, training_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        if sizes[k] <= 0:
            continue
        fits = [b for b, (left, s, c) in enumerate(bins) if left >= sizes[k] and s[sources[k]] < per_source and clusters[k] not in c]
        if fits:
            b = min(fits, key=lambda b: bins[b][0])
        else:
            bins.append([capacity, Counter(), set()])
            b = len(bins) - 1
        bins[b][0] -= sizes[k]
        bins[b][1][sources[k]] += 1
        bins[b][2].add(clusters[k])
        out[k] = b
    return out, sorted(b[0] for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_takes_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    n = 150
    sizes = [rng.choice([0, 1, 5, 40, 77, 100]) + rng.randint(0, 3) * (seed % 2) for _ in range(n)]
    sizes = [min(x, 100) for x in sizes]
    sources, clusters = [rng.choice(["hot"] * 5 + ["a", "b", None]) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
    got = best_fit(sizes, sources, clusters, 100, 2)
    held = defaultdict(list)
    for k, b in enumerate(got):
        held[b].append(k)
    for b, ks in held.items():
        if b < 0:
            assert all(sizes[k] == 0 for k in ks)
            continue
        assert sum(sizes[k] for k in ks) <= 100
        assert max(Counter(sources[k] for k in ks).values()) <= 2 and max(Counter(clusters[k] for k in ks).values()) == 1
    want, _ = plain_best_fit(sizes, sources, clusters, 100, 2)
    assert got == want  # every piece in the tightest compatible bin


def test_best_fit_with_many_sources_and_clusters():
    rng = random.Random(9)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    sources, clusters = [rng.randint(0, 150) if rng.random() < 0.6 else "hot" for _ in sizes], [rng.randint(0, 900) for _ in sizes]
    assert best_fit(sizes, sources, clusters, 100, 2) == plain_best_fit(sizes, sources, clusters, 100, 2)[0]


def test_many_sources_need_little_memory():
    import tracemalloc

    rng = random.Random(2)
    sizes = [rng.randint(1, 2048) for _ in range(30_000)]
    tracemalloc.start()
    bins = best_fit(sizes, list(range(30_000)), list(range(30_000)), 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and max(bins) + 1 <= 1.05 * sum(sizes) / 2048


def test_bins_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i if rng.random() < 0.9 else None, "w " * rng.choice([0, 3, 3, 40, 700, 5000]), "en", rng.choice(["hot", "hot", "a", None]), 0) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:50] + [(1, "same", "en", "hot", 0)] * 300, DOCS)
    found = []
    for parts, shuffle in ((1, "1"), (8, "8"), (64, "64")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        found.append(Counter(map(tuple, pack(df.repartition(parts), per_range=128).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and pack(df.limit(0)).collect() == []
    clusters = defaultdict(list)
    for r in found[0].elements():
        if r[0] >= 0:
            clusters[r[0]].append(r)
    assert all(max(Counter(r[6] for r in b).values()) == 1 and sum(r[4] for r in b) <= 2048 for b in clusters.values())


def test_pack_covers_every_word_once(spark):
    rows = [(i, " ".join(["w"] * n), "en", s, 0) for i, (n, s) in enumerate([(0, "a"), (1, "a"), (2048, "b"), (2049, None), (9000, "hot"), (300, "hot"), (300, "hot")])]
    rows += [(50, None, "en", "a", 0), (None, "x y", "en", "a", 0), rows[5], rows[5]]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    got = pack(df).collect()
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["size"]
        assert (r["bin_id"] == -1) == (r["size"] == 0) and r["first_word"] == r["piece"] * 2048
    assert words == Counter({1: 1, 2: 2048, 3: 2049, 4: 9000, 5: 900, 6: 300, None: 2})
    bins = defaultdict(list)
    for r in got:
        if r["bin_id"] >= 0:
            bins[r["bin_id"]].append(r)
    for rs in bins.values():
        assert sum(r["size"] for r in rs) <= 2048
        assert len({r["cluster"] for r in rs}) == len(rs) and max(Counter(r["source"] for r in rs).values()) <= 2
    assert pack(df.limit(0)).collect() == []


TEXTS = [None, "", "  \n", "Hello World's 123 don't", "<|endoftext|> a<|startoftext|>b <|endof", "ÉCOLE naïve ﬁ Ωmega Σς 中文字 ñ", "é x y z", "'S 'll'd ''re", "a" * 5000, "1234567890 " * 300, "!!!???*** #$%", "𝄞 emoji 😀😀 ‍"]


def test_token_counts_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [*TEXTS, *[r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in token_counts(df, limit=100).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), t
    assert token_counts(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_answered_from_the_stored_table(spark, sf, library, tmp_path):
    odd = ["don't we're 'rest it's 2024!", "a''re 'r x", "<|startoftext|>abc", "ab<|endoftext|>!!<|endoftext|><|start", "..<|startoftext|>'ll x", "日本語 é ñ ß ﬁ", "x   y\n\nz", "'llama 'd've", "", None]
    texts = odd + [r["text"][:250] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 0").limit(200).collect()]
    prefix_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).write.parquet(f"{tmp_path}/t")
    tables, n = spark.read.parquet(f"{tmp_path}/t"), 0
    asked = tables.select("normal", "prefix_tokens", tokens_total().alias("total"), tokens_at(7).alias("at"), chars_within(9).alias("within"), truncated(9).alias("cut")).collect()
    for r in asked:
        want = [library(r["normal"][:i]) for i in range(len(r["normal"]) + 1)]
        n += len(want)
        longest = max(i for i, x in enumerate(want) if x <= 9)
        assert r["prefix_tokens"] == want, r["normal"]
        assert (r["total"], r["at"], r["within"], r["cut"]) == (want[-1], want[min(7, len(want) - 1)], longest, r["normal"][:longest])
    assert len(asked) == len(texts) and n > 20_000


def test_other_tokenizers_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"):
        with pytest.raises(ValueError, match="tokenizer"):
            token_counts(df, path=tokenizer_path(name))


def test_prefix_columns(spark):
    df = spark.createDataFrame([(1, "One two three  four"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in prefix_tables(df).select("doc_id", "normal", tokens_total(), tokens_at(8), tokens_at(99), tokens_at(-1), chars_within(3), truncated(2)).collect()}
    assert got == {1: ("one two three four", 4, 2, 4, 0, 14, "one two "), 2: ("", 0, 0, 0, 0, 0, "")}


def test_rows_without_an_id_are_counted(spark):
    large = 2**60 + 1  # no float
    df = spark.createDataFrame([(None, "one two"), (large, "one two"), (None, None)], "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_bytes"]) for r in token_counts(df).collect())
    assert got == Counter({(None, 7): 1, (large, 7): 1, (None, 0): 1})
    assert Counter(r["doc_id"] for r in prefix_tables(df).collect()) == Counter({None: 2, large: 1})


def toxic_rows(n=300):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [[word() for _ in range(8)] for _ in range(6)]
        if toxic:
            text[rng.randrange(6)][3] = rng.choice(["wretch", "villain"])
        rows.append((i, ". ".join(" ".join(s) for s in text) + ".", int(toxic)))
    return rows


def test_learns_words_and_finds_sentences(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t, "score") for i, t, _ in rows] + [(1000, None, ""), (1001, "", ""), (1002, "...", ""), (None, "a villain here. fine words", ""), (1003, "x" * 300_000 + " wretch", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_documents(df, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[None]["predicted"] == 1 and got[None]["toxic_sentences"] == [0] and got[1003]["predicted"] == 1
    assert {got[i]["predicted"] for i in (1000, 1001, 1002)} == {0} and got[1000]["n_sentences"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_the_held_out_quarter_are_not_read(spark):
    rows = toxic_rows(120)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    b = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert sorted(score_documents(df, a).select("doc_id", "score").collect()) == sorted(score_documents(df, b).select("doc_id", "score").collect())


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in score_documents(df, none).collect()] == [0, 0]
    assert score_documents(df.limit(0), none).collect() == []
    assert fit([], {}).combine([]) < 0.01 and fit([Bag(1, 2, (), ())], {}).combine([]) > 0.99


def test_every_operator_has_a_query(spark):
    assert sorted({int(n[2:].split("_")[0]) for n in Q.queries()}) == list(range(1, 14))


def test_training_takes_one_text_of_a_repeated_id(spark):
    labelled = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = spark.createDataFrame([(labelled, f"text {n}") for n in range(300)] + [(labelled, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(labelled, 1, 0), (labelled, 1, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in training_sample(df, labels).collect()] == [("", 1)]


def test_bags_hold_whole_texts():
    known = {b"bad": 0, b"^wret": 1, b"wretch": 2}
    assert bag("a bad wretch. a BAD wretch! bad" + " fine. so" * 50_000 + ". bad.", 1, known) == Bag(1, 50_000, ((0,), (0, 1, 2)), (2, 2))
    assert bag(None, 0, known) == Bag(0, 0, (), ())


def test_kept_columns_named_as_results(spark):
    df = spark.createDataFrame([(1, "a b", 7, "s")], "doc_id long, text string, score int, source string")
    out = score_documents(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"), keep=["doc_id", "score", "source", "text"])
    assert out.columns == ["doc_id", "source", "text", "score", "n_sentences", "toxic_sentences", "predicted"] and out.first()["score"] < 0.01


def test_held_out_accuracy(spark):
    scored = Q.op5_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("toxic is not null").select("score", "predicted", "toxic").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    print(auc, hit / sum(r["predicted"] for r in rows), hit / len(good))
    assert auc >= 0.97 and hit >= 0.9 * sum(r["predicted"] for r in rows) and hit >= 0.85 * len(good)
