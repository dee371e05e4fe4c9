"""Joins, aggregates, windows and table changes on hand-made rows and against row-by-row models."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from lodestar.operators import aggregates as A
from lodestar.operators import joins as J
from lodestar.operators import mutations as M
from lodestar.operators import retrieval as R
from lodestar.operators import windows as W
from lodestar.operators.windows import decayed_terms


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([("北京大学", 1, "顶尖C9", "media"), ("清华大学", 2, "顶尖C9", ""), ("某大学", 3, "上流211", "law")], "name string, rank int, tier string, note string")


def test_tiers_and_uncrawled(spark, dim):
    people = spark.createDataFrame([(1, "a", "北京大学"), (2, "b", "未知")], "id int, name string, university string")
    assert [r["id"] for r in J.restrict_to_tiers(people, dim, ["顶尖C9"]).collect()] == [1] and J.restrict_to_tiers(people, dim, []).count() == 0
    names = lambda *a, **k: [r["name"] for r in J.uncrawled_universities(dim, people, *a, **k).collect()]
    assert names(["顶尖C9", "上流211"], 5) == ["清华大学", "某大学"] and names([], 5) == [] and names(["顶尖C9"], 5, first=1) == []
    assert {r["id"]: r["tier"] for r in J.people_left_university(people, dim).collect()} == {1: "顶尖C9", 2: None}
    row = A.overview(people.withColumn("department", F.lit("d")), dim, people).first()
    assert (row["total_people"], row["total985"], row["matched_universities"]) == (2, 2, 1)


def test_departments_nest_and_flag(spark, dim):
    deps = spark.createDataFrame([("北京大学", "cs", "weak"), ("北京大学", "ai", "mix_ds"), ("某大学", "cs", "weak")], "univ_name string, dept_name string, com_status string")
    got = {r["name"]: [tuple(d) for d in r["departments"]] for r in J.nest_departments(dim, deps).collect()}
    assert got == {"北京大学": [("ai", "mix_ds"), ("cs", "weak")], "清华大学": [], "某大学": [("cs", "weak")]}
    assert {r["univ_name"]: (r["has_strong"], r["all_weak"]) for r in A.com_flags(deps).collect()} == {"北京大学": (True, False), "某大学": (False, True)}


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    qs, vs = ({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(60)} for _ in range(2))
    q, v = spark.createDataFrame([(x,) for x in qs], "q string"), spark.createDataFrame([(x,) for x in vs], "term string")
    want = {(a, b) for a in qs for b in vs if (a in b or b in a) and (len(a) > 1 or a == b or len(b) > 1 and a in b)}
    got = {tuple(r) for r in J.contained_terms(q, v).collect()}
    assert {p for p in got if len(p[0]) > 1} == {p for p in want if len(p[0]) > 1}
    assert {tuple(r) for r in J.contained_terms(q, v, both_ways=False).collect() if len(r[0]) > 1} == {(a, b) for a in qs for b in vs if a in b and len(a) > 1}


def test_few_queries_are_looked_for_where_terms_lie(spark):
    texts = ["the whole of a long text", "of", "o", "xo", "", "the whole of", None]
    q, v = spark.createDataFrame([("of",), ("the whole of",), ("o",), ("",), (None,), ("of",)], "q string"), spark.createDataFrame([(t,) for t in texts], "term string")
    want = {("of", texts[0]), ("of", "of"), ("of", "o"), ("of", texts[5]), (texts[5], texts[0]), (texts[5], texts[5]), (texts[5], "of"), (texts[5], "o"), ("o", "o")}
    got = J.contained_terms(q, v)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1  # terms are made distinct, pairs aren't
    assert {tuple(r) for r in J.contained_terms(q, v, both_ways=False).collect()} == {p for p in want if p[0] in p[1]}


def test_containment_in_hot_blocks_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 5)
    monkeypatch.setattr(J, "fits", lambda *a: False)
    rng = random.Random(4)
    qs, vs = ({"".join(rng.choices("ab", k=rng.randint(2, 9))) for _ in range(80)} for _ in range(2))
    q, v = spark.createDataFrame([(x,) for x in qs], "q string"), spark.createDataFrame([(x,) for x in vs], "term string")
    assert {tuple(r) for r in J.contained_terms(q, v).collect()} == {(a, b) for a in qs for b in vs if a in b or b in a}


def test_many_queries_give_no_pair_twice(spark):
    rng = random.Random(5)
    qs, vs = ({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(90)} for _ in range(2))
    assert len(qs) > J.SCANNED
    got = [tuple(r) for r in J.contained_terms(spark.createDataFrame([(x,) for x in qs], "q string"), spark.createDataFrame([(x,) for x in vs], "term string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in qs for b in vs if a == b or len(a) > 1 and (a in b or b in a)}


def test_a_term_meets_few_longer_ones(spark):
    """All hold a frequent gram; each term looks among those of its rarest one."""
    outer = spark.createDataFrame([(f"common{i:04d}",) for i in range(2000)], "outer string")
    inner = spark.createDataFrame([(f"mon{i:04d}",) for i in range(0, 2000, 7)] + [("zzz",), ("onz",)], "inner string")
    got = J._inside(inner, outer)
    assert got.count() == inner.count() - 2
    joined = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joined and all("Contains" in x or "contains" in x.lower() for x in joined)


def test_link_lookup_and_backfill(spark):
    d = spark.createDataFrame([(1, "北京大学", "t1"), (2, "北京大学医学部", "t2")], "position int, name string, tier string")
    got = {r["name"]: (r["linked"], r["tier"]) for r in J.link_name(spark.createDataFrame([("北京大学医学部",), ("北京",), ("x",), (None,)], "name string"), d).collect()}
    assert got == {"北京大学医学部": ("北京大学医学部", "t2"), "北京": ("北京大学", "t1"), "x": (None, "双非"), None: (None, "双非")}
    out = J.lookup(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", "A")], "key string, value string"), "k", "v")
    assert {tuple(r) for r in out.collect()} == {("a", "A"), ("b", "b")}
    people = spark.createDataFrame([("p", "u", ""), ("q", "u", "own"), ("r", "u", None)], "name string, university string, lab_name string")
    labs = spark.createDataFrame([(2, "L2", "u", ["p"]), (1, "L1", "u", ["p", "q"])], "lab_id int, lab_name string, university string, members array<string>")
    assert {r["name"]: r["lab_name"] for r in J.backfill_lab(people, labs).collect()} == {"p": "L1", "q": "own", "r": None}


def test_affiliations_grids_and_probes(spark, dim):
    en = dim.select("name", F.when(F.col("rank") == 1, "Peking University").alias("en_name"))
    orgs = spark.createDataFrame([("北京某所",), ("PEKING univ",), ("none",)], "org string")
    assert {(r["org"], r["university"]) for r in J.affiliation_join(orgs, en).collect()} == {("北京某所", "北京大学"), ("PEKING univ", "北京大学")}
    grid = J.query_grid(en, spark.createDataFrame([(1, "{name} {en} {year}")], "template_id int, template string"), 2025)
    assert {r["query"] for r in grid.collect()} == {"北京大学 Peking University 2025", "清华大学 清华大学 2025", "某大学 某大学 2025"}
    assert J.not_yet_stored(orgs, orgs.limit(1), ["org"]).count() == 2


def model_upsert(rows):
    stored = OrderedDict()
    for name, univ, url, title, lab in rows:
        if any(r[0] == name and r[1] == univ for r in stored.values()):
            continue
        old = stored.get(url)
        stored[url] = (old[0], old[1], title, lab if lab is not None else old[3]) if old else (name, univ, title, lab)
    return {(u, *r) for u, r in stored.items()}


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    rows, absorbed, seen = [], set(), {}
    for _ in range(60):
        person, url = (f"n{rng.randrange(30)}", f"u{rng.randrange(2)}"), f"x{rng.randrange(25)}"
        if person in absorbed:  # the one corner in which the set-based form differs
            continue
        if person not in {r[:2] for r in rows} and url in seen:
            absorbed.add(person)
        seen.setdefault(url, person)
        rows.append((*person, url, f"t{rng.randrange(9)}", rng.choice([None, "lab1", "lab2"])))
    schema = "seq long, name string, university string, profile_url string, title string, lab_name string"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    got = {(r["profile_url"], r["name"], r["university"], r["title"], r["lab_name"]) for r in M.upsert_people(df.where("seq < 20"), df.where("seq >= 20")).collect()}
    assert got == model_upsert(rows)


def test_notices_reject_blank_urls_and_keep_extras(spark):
    schema = "url string, title string, extra_json string, seq long"
    old = spark.createDataFrame([("a", "t1", "e1", 1)], schema)
    new = spark.createDataFrame([("a", "t2", None, 2), (" ", "x", "x", 3), ("b", "t3", None, 4)], schema)
    assert {r["url"]: (r["title"], r["extra_json"]) for r in M.upsert_notices(old, new).collect()} == {"a": ("t2", "e1"), "b": ("t3", None)}
    again = M.upsert_notices(M.upsert_notices(old, new), new)
    assert again.count() == 2


def test_feedback_is_clamped_at_each_step(spark):
    rows = [(1, i, True) for i in range(3000)] + [(1, 3000, False), (2, 0, False), (3, 0, True)] + [(4, i, False) for i in range(60)] + [(4, 60, True)]
    got = {r["id"]: round(r["score"], 6) for r in M.apply_feedback(spark.createDataFrame(rows, "id int, seq long, positive boolean")).collect()}
    assert got == {1: 0.99, 2: 0.49, 3: 0.52, 4: 0.02}


def test_questions_progress_and_patches(spark):
    schema = "category string, question string, hint string, source string"
    old = spark.createDataFrame([("c", "q1", "h", "builtin"), ("c", "q2", None, "manual")], schema)
    new = spark.createDataFrame([("d", "q1", None, "import"), ("d", "q3", "h3", "import")], schema)
    count = lambda mode, **k: sorted((r["question"], r["category"], r["hint"]) for r in M.import_questions(old, new, mode, **k).collect())
    assert len(count("skip")) == 4 and len(count("skip", dedupe=True)) == 3
    assert count("overwrite") == [("q1", "d", "h"), ("q2", "c", None), ("q3", "d", "h3")]
    assert [q for q, _, _ in count("replace_all")] == ["q1", "q1", "q3"]
    marks = spark.createDataFrame([(1, 1, "t1"), (1, 1, "t2"), (1, 2, "t1")], "user_id int, question_id int, done_at string")
    done = M.mark_done(marks.limit(0), marks)
    assert sorted(map(tuple, done.collect())) == [(1, 1, "t1"), (1, 2, "t1")]
    assert M.unmark_done(done, marks.where("question_id = 1")).count() == 1 and M.clear_progress(done, marks).count() == 0
    ok = M.append_validated(old, spark.createDataFrame([("", "q", " ", None), ("x", " ", "h", "s")], schema), ["question"], defaults={"category": "综合"}).where("question = 'q'").first()
    assert tuple(ok) == ("综合", "q", None, None)


def test_toggles(spark):
    rows = [("a", "u", 1, "toggle"), ("a", "u", 2, "toggle"), ("b", "u", 3, "toggle"), ("c", "u", 4, "toggle"), ("c", "u", 5, "remove"), ("d", "u", 6, "remove"), ("d", "u", 7, "toggle")]
    got = M.toggle_set(spark.createDataFrame(rows, "name string, university string, seq long, action string")).collect()
    assert [(r["name"], r["seq"]) for r in got] == [("d", 7), ("b", 3)]


def test_cascade_thresholds(spark):
    rows = [("below", "s1", f"n{i}", i) for i in range(2)] + [("at", "s1", f"n{i}", i) for i in range(3)] + [(g, "s2", n, 10 + k) for g in ("below", "at") for k, n in enumerate(["n0", "m1", "m2", "m3"])] + [("below", "s3", "z", 30), ("at", "s3", "z", 30)]
    policy = [W.Source("s1"), W.Source("s2", below=3, cap=2), W.Source("s3", below=4)]
    got = {(r["g"], r["source"], r["name"]) for r in W.coverage_cascade(spark.createDataFrame(rows, "g string, source string, name string, seq int"), policy, group="g").collect()}
    assert {n for g, s, n in got if g == "below" and s == "s2"} == {"m1", "m2"} and not any(s == "s2" for g, s, _ in got if g == "at")
    assert ("below", "s3", "z") not in got and ("at", "s3", "z") in got


def test_packed_session_terms_equal_lines(spark):
    docs = spark.createDataFrame([(1, "Aa bb aa,\x0bc /É\u3000é"), (2, " "), (3, None), (4, "bb"), (5, "x、y"), (6, "\t")], "doc_id long, areas string")
    events = spark.createDataFrame([(7, 1, 1, 1), (7, 2, 2, 2), (7, 3, 3, 1), (8, 4, 1, 4), (8, 5, 2, 3), (9, 6, 1, 2), (9, 7, 1, 5), (9, 8, 1, 4)], "session_id long, event_id long, ts long, doc_id long")
    packed = W.packed_terms(docs)
    lined, made = ({(r["session_id"], r["term"]): round(r["weight"], 9) for r in x.collect()} for x in (decayed_terms(events, lines=W.session_lines(docs)), decayed_terms(events, packed=packed)))
    assert made == lined and len(made) == 6
    shares = W.event_shares(events)
    assert {r["session_id"]: r["terms"] for r in W.liked_terms(shares, packed, 1).collect()} == {7: ["aa"], 8: ["bb"], 9: ["bb"]}
    results = spark.createDataFrame([(s, d, 0.5) for s in (7, 8, 9, 10) for d in (1, 2, 3, 4, 5, 6)], "session_id long, doc_id long, score double")
    plain = R.session_rerank(results, decayed_terms(events, packed=packed), docs.withColumnRenamed("areas", "research_areas"), lines=W.session_lines(docs))
    want, got = ({(r["session_id"], r["doc_id"]): round(r["hybrid"], 9) for r in x.collect()} for x in (plain, R.packed_rerank(results, shares, packed)))
    assert got == want and len(got) == 24


def test_sessions_that_ask_the_same_words_are_asked_once(spark, sf, monkeypatch):
    from lodestar.plans import matching

    asked, recalled, stored = [], matching.pruned_recall, matching.store_index
    monkeypatch.setattr(matching, "pruned_recall", lambda terms, index, k: asked.append((terms.collect(), index.vocab.collect())) or recalled(terms, index, k))
    rows = matching.session_reranked(spark, sf).collect()
    (terms, vocab), = asked
    sets = {}
    for r in terms:
        sets.setdefault(r["query_id"], set()).add(r["term"])
    assert len({frozenset(x) for x in sets.values()}) == len(sets) <= len({r["session_id"] for r in rows})
    assert {r["term"] for r in vocab} == {r["term"] for r in terms}  # postings of other words are not kept


def test_session_interest_writes_no_table(spark, sf, monkeypatch):
    from lodestar.plans import matching

    def refuse(df, name):
        raise AssertionError(f"{name} is written to the shared folder")

    monkeypatch.setattr(matching, "staged", refuse)
    assert matching.session_interest(spark, sf).where("weight is null").count() == 0


def test_session_rerank_corners(spark):
    results = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.9), ("none", 1, 0.4), ("s", 3, 0.2)], "session_id string, doc_id int, score double")
    docs = spark.createDataFrame([(1, "ml, cv"), (2, " "), (3, "x、y"), (4, "not shown")], "doc_id int, research_areas string")
    events = spark.createDataFrame([("s", 1, 1, "ml"), ("s", 2, 2, None), ("blank", 1, 3, "")], "session_id string, ts int, event_id int, areas string")
    got = {(r["session_id"], r["doc_id"]): round(r["hybrid"], 6) for r in R.session_rerank(results, decayed_terms(events), docs).collect()}
    assert got == {("s", 1): round(0.35 + 0.3 / 2**0.5, 6), ("s", 2): 0.9, ("none", 1): 0.4, ("s", 3): 0.14}


def test_expansion_and_directions(spark):
    words = spark.createDataFrame([("视觉", "目标检测"), ("视觉", "图像"), ("语言", "翻译")], "direction string, term string")
    tech = spark.createDataFrame([("YOLO", "视觉"), ("X1", "未知")], "word string, direction string")
    ask = spark.createDataFrame([(1, ["语言"], None, "used YOLO"), (2, ["别的"], "图像 things", ""), (3, [], "", "X1")], "query_id int, dirs array<string>, target string, background string")
    got = {}
    for r in R.expand_query(ask, words, tech).collect():
        got.setdefault(r["query_id"], set()).add(r["term"])
    assert got == {1: {"语言", "翻译", "used YOLO", "目标检测", "图像", "视觉"}, 2: {"别的", "图像 things", "目标检测", "图像"}, 3: {"X1", "未知"}}
    tree = spark.createDataFrame([("T", "m1", "deep"), ("T", "m2", "deep"), ("U", "m3", "ab")], "top string, mid string, term string")
    texts = spark.createDataFrame([(1, "deep ab"), (2, None)], "id int, text string")
    assert {(r["id"], r["top"]): round(r["score"], 6) for r in R.identify_directions(texts, tree).collect()} == {(1, "T"): 0.8, (1, "U"): 0.2}
    wanted = spark.createDataFrame([(9, ["Deep", "zz"])], "query_id int, dirs array<string>")
    assert [round(r["direction"], 6) for r in R.direction_match(wanted, texts, tree).collect()] == [round((0.3 + 0.7 * 0.8) / 2, 6)]


def test_recall_without_an_index_keeps_only_asked_words(spark, monkeypatch):
    rows = [(1, "Élan vital", "the x_1 thé"), (2, "other", None), (3, None, "  "), (4, "bathe, THE ²", "the"), (5, "und the und", "und"), (6, None, None)]
    docs = spark.createDataFrame(rows, "id long, name string, text string")
    queries = spark.createDataFrame([(1, "the elan"), (2, "the"), (3, "he th"), (4, "zzz"), (5, None), (6, "ath und_")], "query_id int, text string")
    want = R.recall_or_fallback(queries, R.build_index(docs, ["name", "text"]), 3).select("query_id", "doc_id", "bm25", "route")
    stored, plain = [], R.store_index
    monkeypatch.setattr(R, "store_index", lambda *a, **k: stored.append(plain(*a, **k)) or stored[0])
    made = R.asked_recall(queries, docs, ["name", "text"], 3).select("query_id", "doc_id", "bm25", "route").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, want.collect())) and {r["route"] for r in made} == {"words", "contains"}
    assert stored[0].n_docs == 6 and {r["term"] for r in stored[0].vocab.collect()} == {"the", "elan", "und"}
    monkeypatch.setattr(R, "folded", lambda df: None)  # too many words to be looked for in each text
    made = R.asked_recall(queries, docs, ["name", "text"], 3).select("query_id", "doc_id", "bm25", "route").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, want.collect()))


def test_like_fallback_and_match_store_no_index_of_all_words(spark, sf, monkeypatch):
    from lodestar.operators import stored_index
    from lodestar.plans import matching

    def whole(*a, **k):
        raise AssertionError("texts are cut into an array of words each")

    monkeypatch.setattr(stored_index, "tokenize_words", whole)
    assert matching.like_fallback(spark, sf).count() == 10 and matching.match_topk(spark, sf).count() == 15


def test_match_on_nothing(spark):
    docs = spark.createDataFrame([], "id long, name string, research_areas string, university string, recruiting boolean")
    assert R.match(spark.createDataFrame([(1, "x y")], "query_id int, text string"), docs, 5).count() == 0


def test_longest_terms_equal_drop_substrings(spark):
    terms = ["工程", "软件工程", "件工程", "软件工程师", "abc", "xabcx", "bc", "abd"]
    df = spark.createDataFrame([(1, t) for t in terms] + [(2, "abc"), (2, "abc")], "id int, term string")
    got = sorted(map(tuple, J.longest_terms(df).collect()))
    assert got == [(1, "abd"), (1, "xabcx"), (1, "软件工程师"), (2, "abc")]


def test_universities_by_name_note_or_department(spark):
    u = spark.createDataFrame([("甲大学", ""), ("乙大学", "医"), ("丙大学", None)], "name string, note string")
    d = spark.createDataFrame([("丙大学", "医学院"), ("丙大学", "医院"), ("甲大学", None)], "univ_name string, dept_name string")
    assert sorted(r["name"] for r in W.search_universities(u, d, "医").collect()) == ["丙大学", "乙大学"]


def row_by_row(rows):
    people, urls = set(), {}
    for name, university, url, title, lab, _ in rows:
        if (name, university) in people and name is not None:
            continue
        if url is not None and url in urls:
            urls[url]["title"], urls[url]["lab"] = title, lab if lab is not None else urls[url]["lab"]
            continue
        people.add((name, university))
        urls[url if url is not None else object()] = {"name": name, "university": university, "title": title, "lab": lab}
    return sorted((v["name"] or "", v["university"], v["title"], v["lab"] or "") for v in urls.values())


@pytest.mark.parametrize("left_over", [0, 3, 50_000])
def test_exact_upsert_equals_row_by_row(spark, monkeypatch, left_over):
    monkeypatch.setattr(M, "LEFT_OVER", left_over)
    rng = random.Random(left_over)
    schema = "name string, university string, profile_url string, title string, lab_name string, seq long"
    rows = [(rng.choice([*"abcdefghij", None]), rng.choice("UV"), rng.choice([*map(str, range(12)), None, "0", "0"]), f"t{i}", rng.choice([None, f"l{i}"]), i) for i in range(150)]
    old = [("a", "U", "0", "t", None), ("z", "V", "99", "t", "l")]
    reappears = [("y", "U", "0", "n1", None, 200), ("y", "U", "77", "n2", "k", 201), ("y", "U", "78", "n3", None, 202)]  # absorbed first, then stored, then known
    chain = [(f"c{i // 2}", "U", f"u{(i + 1) // 2}", "t", None, 300 + i) for i in range(14)]  # each row waits for the one before it
    new = rows + reappears + chain
    got = M.upsert_people(spark.createDataFrame(old, schema.rsplit(",", 1)[0]), spark.createDataFrame(new, schema).repartition(3), last=("title",), exact=True)
    assert sorted((r["name"] or "", r["university"], r["title"], r["lab_name"] or "") for r in got.collect()) == row_by_row([(*o, -1) for o in old] + new)


def test_feedback_of_ids_with_far_apart_steps(spark, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 4)
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i * 1024, rng.random() < 0.4) for i in range(900)]
    want = {}
    for i, _, up in rows:
        want[i] = min(1.0, max(0.0, want.get(i, 0.5) + (0.02 if up else -0.01)))
    df = spark.createDataFrame(rows, "id int, seq long, positive boolean").repartition(5)
    got = {r["id"]: r["score"] for r in M.apply_feedback(df).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert M.apply_feedback(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [0, 2000])
def test_large_dictionaries_give_what_small_ones_do(spark, monkeypatch, most):
    monkeypatch.setattr(J, "FOLDED", most)
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abC", k=rng.randint(1, 4))) for _ in range(40)})
    rows = [(i, "".join(rng.choices("abC ", k=rng.randint(0, 9))) or None) for i in range(60)]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {tuple(r) for r in J.mentions(texts, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(i, w) for i, t in rows for w in words if w in (t or "")}
    terms = [(f"D{i % 5}", w) for i, w in enumerate(words)] + [("D9", "aaaaa")]
    cross = J.direction_cross(texts.withColumnRenamed("text", "areas"), spark.createDataFrame(terms, "direction string, term string"))
    tree = spark.createDataFrame([(f"T{i % 3}", f"m{i % 4}", w) for i, w in enumerate(words)], "top string, mid string, term string")
    wanted = spark.createDataFrame([(1, ["ab", "T1"]), (2, [words[0].upper()])], "query_id int, dirs array<string>")
    made = [sorted(map(tuple, df.collect())) for df in (cross, R.identify_directions(texts, tree).selectExpr("id", "top", "round(score, 6)"), R.direction_match(wanted, texts, tree))]
    assert all(made)
    kept = test_large_dictionaries_give_what_small_ones_do.__dict__.setdefault("made", made)
    assert made == kept


def test_terms_are_counted_within_their_text(spark, capsys):
    from lodestar.functions.text import term_counts

    df = spark.createDataFrame([(1, "b a b a a"), (2, ""), (3, None), (4, "x")], "id long, text string")
    counted = df.select(term_counts(F.split("text", " ")).alias("x")).collect()
    assert [[tuple(e) for e in r["x"] or []] for r in counted] == [[("a", 3), ("b", 2)], [("", 1)], [], [("x", 1)]]
    assert df.select(term_counts(F.array().cast("array<string>")).alias("x")).first()["x"] == []
    made = R.build_index(df, ["text"])
    assert {tuple(r) for r in made["entries"].collect()} == {(1, "a", 3, 5), (1, "b", 2, 5), (4, "x", 1, 1)}
    made["postings"].explain()
    assert "Exchange" not in capsys.readouterr().out


def test_session_terms_travel_in_lines(spark):
    docs = spark.createDataFrame([(1, "Aa bb aa, c"), (2, " "), (3, None), (4, "bb")], "doc_id long, areas string")
    events = spark.createDataFrame([(7, 1, 1, 1), (7, 2, 2, 2), (7, 3, 3, 1), (8, 4, 1, 4), (8, 5, 2, 3)], "session_id long, event_id long, ts long, doc_id long")
    made = decayed_terms(events, lines=W.session_lines(docs))
    got = {(r["session_id"], r["term"]): round(r["weight"], 6) for r in made.collect()}
    assert got == {(7, "aa"): 3.28, (7, "bb"): 1.64, (8, "bb"): 0.8}
    results = spark.createDataFrame([(7, 1, 0.5), (8, 1, 0.5), (8, 4, 0.5), (8, 2, 0.5), (9, 4, 0.5)], "session_id long, doc_id long, score double")
    texts = docs.withColumnRenamed("areas", "research_areas")
    plain, lined = ({(r["session_id"], r["doc_id"]): round(r["hybrid"], 9) for r in R.session_rerank(results, made, texts, lines=x).collect()} for x in (None, W.session_lines(docs)))
    assert plain == lined and len(lined) == 5
