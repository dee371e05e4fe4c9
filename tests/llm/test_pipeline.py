"""The corpus pipeline: each stage's contract on its own input, and the whole run."""

from collections import Counter

import pytest

import corpus_pipeline as C
from lodestar.llm.mixing import take
from lodestar.llm.ngram_join import similar_documents
from lodestar.llm.toxicity import score_documents

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, step in C.STAGES:
        path = str(folder / name)
        step(spark, docs[-1], sf_dir).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "packing"] and C.ORACLE_SQL is None
    assert all(d.columns == DOCUMENTS for d in stages[:-1])


def test_toxicity_drops_what_it_rejects(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = {r["doc_id"] for r in score_documents(stages[0], labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept and 0 < len(kept)


def test_lines_keep_every_document(stages):
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in stages[1:3])
    assert set(before) == set(after)
    for i, r in after.items():
        assert set((r["text"] or "").split("\n")) <= set((before[i]["text"] or "").split("\n")) | {""}
        assert r["n_chars"] == len(r["text"] or "") or r["text"] == before[i]["text"]


def test_one_of_each_group_stays(stages):
    groups = Counter(r["component_id"] for r in similar_documents(stages[2]).collect())
    assert {r["doc_id"] for r in stages[3].collect()} == set(groups)


def test_documents_without_an_id_stay(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (None, None), (1, text), (2, text), (3, "other words than those of the first"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, step in C.STAGES[1:3]:
        docs = step(spark, docs, "")
        assert Counter(r["doc_id"] for r in docs.collect())[None] == 3, name
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter([None, None, None, 1, 3, 4])


def test_mix_repeats_as_decided(stages):
    want = Counter({r["doc_id"]: r["copies"] for r in take(stages[3]).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in stages[4].collect()) == want


def test_packing_covers_the_mix(stages):
    words = Counter()
    for r in stages[4].collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    packed = Counter()
    for r in stages[5].collect():
        packed[r["doc_id"]] += r["size"]
    assert packed == words
    size = Counter()
    for r in stages[5].where("bin_id >= 0").collect():
        size[r["bin_id"]] += r["size"]
    assert max(size.values()) <= 2048


def test_run_equals_its_stages(spark, stages):
    rows = lambda d: Counter((r["doc_id"], r["piece"], r["size"]) for r in d.collect())
    assert rows(C.run(spark, "/root/testdata/sf0.001")) == rows(stages[-1])


HARD = [(1, None, None, None, None), (None, "a b", None, "s", 3), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, "x" * 200_000, "en", "s", 1), (5, "long text here " * 30_000, "en", None, 1)]
HARD += [(6, "the same line that is long enough for all\nmore", "en", x, 1) for x in ("s", "t", "u", None)] + [(7, "the same line that is long enough for all", "en", "v", 1)] * 2


@pytest.mark.parametrize("n", range(5))
def test_stages_on_nulls_and_clashing_columns(spark, n):
    docs = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.selectExpr("*", "1 as score", "2 as copies", "3 as n_removed", "4 as component_id", "5 as bin_id", "6 as size", "7 as signature")
    name, step = C.STAGES[n]
    rows = lambda d: Counter(map(str, d.collect()))
    plain = step(spark, docs, "/root/testdata/sf0.001")
    assert rows(plain) == rows(step(spark, more, "/root/testdata/sf0.001")), name
    if n < 4:
        assert plain.columns == DOCUMENTS
    ids = Counter(r["doc_id"] for r in plain.collect())
    if n < 2:
        assert ids == Counter(r[0] for r in HARD)
    if n == 2:
        assert set(ids) == {r[0] for r in HARD} - {7}  # 5 of 6 shingles are those of 6
    if n == 4:
        assert ids[5] == 3 * 30_000 // 2048 + 1
    assert step(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == [], name
