"""Text functions and predicates on hand-made rows, one for each semantic trap."""

import re

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import predicates as P
from lodestar.functions import text as X
from lodestar.plans import registry


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "hit"), [("Research software", False), ("AR/VR", True), ("AR技术", False), ("ar", True), ("x ar1", False), (None, None)])
def test_keyword_rule(spark, text, hit):
    assert one(spark, P.keyword_match(F.col("t"), "AR"), t=text) == hit
    assert one(spark, P.keyword_match_term("t", "k"), t=text, k="AR") == hit


def test_long_or_han_keywords_are_substrings(spark):
    assert one(spark, P.keyword_match(F.col("t"), "Vision"), t="computer visionary") and one(spark, P.keyword_match(F.col("t"), "软件"), t="大软件工程")
    assert one(spark, P.keyword_match(F.col("t"), "UI/UX"), t="good ui/ux.")


def plain_tokens(text):
    clean = (text or "").strip()
    if not clean:
        return set()
    parts = [p.strip().lower() for p in re.split(r"[\s,，、；;。.]+", text)]
    out = {clean.lower()} | {p for p in parts if 2 <= len(p) <= 30}
    return out | {p[i : i + 4] for p in parts for i in range(len(p) - 1)}


@pytest.mark.parametrize("text", ["软件工程师", "ab", "a", "", None, "  x ,y;z ", "one two，three。四五六七八", "A" * 40 + " b"])
def test_window_tokens(spark, text):
    got = one(spark, X.tokenize_windows(F.col("t")), t=text)
    assert set(got) == plain_tokens(text) and len(got) == len(set(got))


def test_window_tokens_of_han(spark):
    assert set(one(spark, X.tokenize_windows(F.col("t")), t="软件工程师")) == {"软件工程师", "软件工程", "件工程师", "工程师", "程师"}


def test_window_tokens_of_many_texts(spark):
    """Texts are cut together, and control characters are characters like others."""
    texts = ["ab\x01cd", "x\x00", " a b\n", "😀漢字😀 ,b", *(f"Wort{i} wort{i}," * (i % 5) for i in range(300)), "y" * 70_000 + " zz" * 400_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", X.tokenize_windows(F.col("t")).alias("got"))
    for i, got in df.collect():
        assert set(got) == plain_tokens(texts[i]) and len(got) == len(set(got))


def test_windows_of_very_many_kinds_of_characters(spark):
    text = "".join(chr(c) for c in range(0x3400, 0x18000) if not 0xD800 <= c < 0xE000 and chr(c) not in "，、；。").lower()
    assert X._pieces(pd.Series([text, "abc"])).map(lambda t: set(t.split("\n"))).tolist() == [plain_tokens(text) - {text}, {"abc", "bc"}]


def test_word_and_mixed_tokens(spark):
    assert one(spark, X.tokenize_words(F.col("t")), t="École d'Été, GPT-4!") == ["ecole", "d", "ete", "gpt", "4"]
    assert one(spark, X.tokenize_mixed(F.col("t")), t="GPT-4 图a像学") == ["gpt-4", "a", "图像", "像学", "图像学"]


def test_antichain(spark):
    assert one(spark, X.drop_substrings(F.col("t")), t=["工程", "软件工程", "件工程", "软件工程", "abc"]) == ["软件工程", "abc"]


@settings(max_examples=20, deadline=None)
@given(terms=st.lists(st.text("abc", min_size=1, max_size=5), max_size=6), seed=st.randoms())
def test_antichain_ignores_order(spark, terms, seed):
    other = list(terms)
    seed.shuffle(other)
    assert one(spark, X.drop_substrings(F.col("t")), t=terms or ["a"]) == one(spark, X.drop_substrings(F.col("t")), t=other or ["a"])


@settings(max_examples=20, deadline=None)
@given(terms=st.lists(st.text("ab", min_size=1, max_size=9) | st.integers(60, 70).map(lambda n: "ab" * (n // 2) + "a" * (n % 2)), max_size=8))
def test_maximal_terms_equal_all_pairs(spark, terms):
    terms = terms or ["a"]
    assert one(spark, X.maximal_terms(F.col("t")), t=terms) == [t for t in dict.fromkeys(terms) if len(t) >= 3 and not any(len(u) > len(t) and t in u for u in terms)]


def test_maximal_terms_of_a_text_are_found_in_its_row(spark, sf):
    plan = registry.queries()["term_antichain"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1 and "Aggregate" not in plan  # the view joins labels


def test_jaccard_ends(spark):
    j = X.jaccard(F.col("a"), F.col("b"))
    assert (one(spark, j, a="", b=None), one(spark, j, a="ab", b=""), one(spark, j, a="abc", b="abc"), one(spark, j, a="abc", b="bcd")) == (1.0, 0.0, 1.0, 1 / 3)


def test_names(spark):
    good = P.valid_person(F.col("n"), F.col("u"), exact=("通知公告",), roots=("校友",))
    expected = {"张三": True, "基金校友": False, "通知公告": False, "清华大学": False, "Wei Wang": True, "wei wang": False, "张": False, "一二三四五六": False, None: False, "某某": True}
    assert {n: one(spark, good, n=n, u="清华大学") for n in expected} == expected
    assert one(spark, X.clean_name(F.col("n")), n="张三 教授（博导）") == "张三" and one(spark, X.clean_name(F.col("n")), n="x") == ""


def test_boolean_filter(spark):
    rows = [(1, "张三", "机器学习"), (2, "李四", "数据库 副教授"), (3, "王五", None), (4, "赵六", "教授 vision")]
    df = spark.createDataFrame(rows, "id int, name string, area string")
    ids = lambda q: [r["id"] for r in df.where(P.boolean_filter(q, {"name": "name", "area": "area"})).orderBy("id").collect()]
    assert ids("") == [1, 2, 3, 4] and ids("张三|area:VISION") == [1, 4] and ids("-数据库") == [1, 3, 4] and ids('"教授"') == [4] and ids("教授") == [2, 4] and ids("name=李四 area:数据库") == [2] and ids("name:李四 -area:数据库") == []


def test_dates_quota_gpa(spark):
    t = "报名 2022-01-01 起 2024年9月1日 止 2025-10-02，招收 12 名，GPA ≥ 3.5，排名前 20%"
    assert one(spark, X.extract_dates(F.col("t")), t=t) == ["2024年9月1日", "2025-10-02"] and one(spark, X.deadline(F.col("t")), t=t) == "2025-10-02" and one(spark, X.deadline(F.col("t")), t="none") is None
    assert (one(spark, X.extract_quota(F.col("t")), t=t), one(spark, X.extract_gpa(F.col("t")), t=t), one(spark, X.extract_rank(F.col("t")), t=t)) == (12, 3.5, 20)


def test_note_rules_at_their_edges(spark):
    rows = [
        ("2025-02-30 2025/2/28 2022-12-31 2049.12.31 2050-01-01 2025年13月1日 2026年6月", ["2025/2/28", "2049.12.31"], None, None, None),
        ("招收若干名；计划接收 ３０ 人", [], 30, None, None),
        ("招收对象：本科三年级以上的优秀学生若干共计 12 名", [], None, None, None),
        ("共有 8 个招生名额", [], 8, None, None),
        ("招收 99999999999 人", [], None, None, None),
        ("要求 gpa>=3.2 以上", [], None, 3.2, None),
        ("GPA 3.2", [], None, None, None),
        ("GPA 优秀，GPA ＝3.1，GPA≥4", [], None, 4.0, None),
        ("成绩在前 15 名，排前３０％", [], None, None, 15),
        ("排名前 20，专业前 10%", [], None, None, None),
        ("排前25%", [], None, None, 25),
        (None, [], None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    t = F.col("t")
    found = df.select(X.extract_dates(t).alias("d"), X.extract_quota(t).alias("q"), X.extract_gpa(t).alias("g"), X.extract_rank(t).alias("r")).orderBy("i").collect()
    assert [tuple(r) for r in found] == [r[1:] for r in rows]


def test_areas_between_label_and_end_mark(spark):
    rows = [
        ("研究方向：短。但是后面还有。尾", "短。但是后面还有"),
        ("研究方向：短", None),
        ("研究方向 没有冒号的一段文字", None),
        ("研究兴趣：机器学习与\n数据挖掘", None),
        ("研究方向：" + "长" * 301 + "。研究领域：足够长的另一段文字。", "足够长的另一段文字"),
        ("research   INTERESTS large models and data; other", "large models and data"),
        ("主要研究方向为图像与视觉和语言。", "为图像与视觉和语言"),
        ("个人简介 长期从事机器学习与数据挖掘研究；成果多。", "长期从事机器学习与数据挖掘研究；成果多"),
        (None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(X.extract_areas(F.col("t"))).collect()] == [r[1] for r in rows]


def test_like_pattern_takes_wildcards_literally(spark):
    assert one(spark, P.has("t", "50%_\\"), t="a 50%_\\ b") and not one(spark, P.has("t", "5%b"), t="5xb") and one(spark, P.has("t", "AbC"), t="xabcx")


def test_links_and_sites(spark):
    hrefs = {"": True, "#a": True, "javascript:x()": True, "mailto:a@b": True, "tel:1": True, "/f.PDF": True, "/a.html": False, None: True}
    assert {h: one(spark, P.skip_href(F.col("h")), h=h) for h in hrefs} == hrefs
    same = P.same_site(F.col("a"), F.col("b"))
    assert one(spark, P.site_of(F.col("a")), a="http://u@cs.pku.edu.cn:80/a") == "pku.edu.cn" and one(spark, same, a="http://cs.pku.edu.cn", b="http://www.pku.edu.cn/") and not one(spark, same, a="http://a.com", b="http://b.com") and one(spark, same, a="nope", b="http://b.com") is False


def test_home_redirect(spark):
    c = P.is_home_redirect(F.col("r"), F.col("f"), F.col("t"), F.col("n"))
    assert one(spark, c, r="http://a.b/x/y", f="http://a.b/", t="long enough title of a page", n=5) and not one(spark, c, r="http://a.b/", f="http://a.b/", t="t", n=0)
    assert one(spark, c, r="http://a.b/x", f="http://a.b/x", t="首页", n=1) and not one(spark, c, r="http://a.b/x", f="http://a.b/x", t="师资队伍", n=1)


def test_cleaning(spark):
    strict = P.clean_people_strict(F.col("n"), F.col("u"), words=("首页",))
    expected = {"张三": True, "返回首页": False, "http://x": False, "<b>": False, "张": False, "计算机系": False, "张3": False, "首页": False, "北大": False}
    assert {n: one(spark, strict, n=n, u="北大") for n in expected} == expected
    assert one(spark, P.long_areas_to_null(F.col("t")), t="x" * 81) is None and one(spark, P.long_areas_to_null(F.col("t")), t="x," * 60) is not None and one(spark, P.long_areas_to_null(F.col("t")), t="short") == "short"


def test_small_rules(spark):
    assert one(spark, X.area_tags(F.col("t")), t="机器学习，数据。x、图像；,,太长太长太长太长太长太长太长太长 e f") == ["机器学习", "图像", "e", "f"]
    assert one(spark, X.snippet(F.col("t"), 5), t=" a \n b  cdef ") == "a b c…" and one(spark, X.snippet(F.col("t"), 50), t="a  b") == "a b"
    assert one(spark, X.gpa_bucket(F.col("g")), g=3.75) == "mid" and one(spark, X.gpa_match_bucket(F.col("g")), g=3.75) == "high"
    assert [one(spark, X.gpa_factor(F.col("g"), F.col("r"), F.col("t")), g=g, r=r, t=t) for g, r, t in ((3.8, 10.0, True), (3.5, 10.0, True), (2.0, 50.0, False), (2.0, 10.0, False))] == [1.0, 0.85, 0.6, 0.85]
    assert one(spark, X.strip_prefix(F.col("o"), F.col("u")), o="清华大学计算机系", u="清华大学") == "计算机系" and one(spark, X.strip_prefix(F.col("o"), F.col("u")), o="清华计算机系", u="清华大学") == "计算机系"
    assert one(spark, X.normalize_term(F.col("t"), {"ml": "机器学习"}), t=" ML ") == "机器学习" and one(spark, X.normalize_term(F.col("t"), {"ml": "x"}), t=" Other ") == "Other"
    assert one(spark, X.extract_title(F.col("t")), t="他是副教授、博导") == "副教授" and one(spark, X.extract_email(F.col("t")), t="写信 a.b@x.edu.cn。") == "a.b@x.edu.cn" and one(spark, X.extract_email(F.col("t")), t="a@b") is None
    assert one(spark, X.extract_areas(F.col("t")), t="研究方向：图像，视觉与语言模型。其他") == "图像，视觉与语言模型" and one(spark, X.is_recruiting(F.col("t")), t="欢迎报考")
    assert one(spark, X.char_count_han(F.col("t")), t="a中b文") == 2 and one(spark, X.tier_boost(F.col("t")), t="北京大学软件") == 1.3 and one(spark, X.tier_boost(F.col("t")), t=None) == 1.0
    assert one(spark, X.cross_domain(F.col("t"), [("media", ["a"]), ("law", ["b", "c"])]), t="law and media") == ["a"] and one(spark, X.cross_domain(F.col("t"), [("law", ["b"])]), t=None) == []
    assert one(spark, X.first_rule(F.col("t"), [("北京|清华", "北京"), ("大学", "其他")], "?"), t="清华大学") == "北京"


def test_templates_and_json(spark):
    df = spark.createDataFrame([("Dear {name}, {x}{y}", {"name": "Li", "x": None, "y": "{name}"})], "t string, v map<string,string>")
    assert df.select(X.render_template(F.col("t"), F.col("v")).alias("r")).first()["r"] in ("Dear Li, {name}", "Dear Li, Li")
    noisy = 'Sure:\n```json\n{"a": "one", "b": "two words"}\n``` done'
    assert one(spark, X.salvage_json(F.col("t"), ["a", "b", "c"]), t=noisy) == {"a": "one", "b": "two words", "c": None}
    assert one(spark, X.salvage_json(F.col("t"), ["a"]), t='{"a": "kept", "b": broken}') == {"a": "kept"}
    assert tuple(one(spark, X.edu_dates(F.col("t")), t="2021.9 至今")) == ("2021.09", "2025.06") and tuple(one(spark, X.edu_dates(F.col("t")), t="none")) == (None, None)
    long = "x" * 3600 + "MARK tail"
    assert one(spark, X.promote_section(F.col("t"), "MARK"), t=long).startswith("MARK tail\nxxx") and one(spark, X.promote_section(F.col("t"), "MARK"), t="a MARK") == "a MARK"


def test_scores(spark):
    venues = {"CVPR": "A", "CHI": "A", "ICME": "B"}
    assert tuple(one(spark, X.venue_counts(F.col("t"), venues), t="machine learning at cvpr, CVPR, icme")) == (2, 1, 0)
    assert tuple(one(spark, X.venue_counts(F.col("t"), venues, word_boundary=True), t="machine learning at cvpr")) == (1, 0, 0)
    assert one(spark, X.activity_score(F.col("b"), F.col("p"), F.lit(20)), b="NSFC", p="2022 2024") == 100 and one(spark, X.activity_score(F.col("b"), F.col("p"), F.lit(1)), b=None, p="2023") == 61
    assert one(spark, X.interests(F.col("a"), F.col("b")), a=["s1", "s1", "s2"], b=["t1", "s2", "t2", "t3", "t4"]) == "s1；s2；t1；t2；t3"
    assert one(spark, X.match_reason(F.col("t")), t=["软件工程", "工程", "图像处理"]) == "匹配方向：图像处理、软件工程"


def test_jaccard_meets_its_sets_once(spark, capsys):
    from lodestar.functions import text
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("abab", "abc"), ("", None), ("a", "ab"), ("ab", "ab")], "a string, b string").select(text.jaccard(F.col("a"), F.col("b")).alias("j"))
    assert [round(r["j"], 6) for r in df.collect()] == [0.333333, 1.0, 0.0, 1.0]
    df.explain()
    assert "array_union" not in capsys.readouterr().out


def test_counted_windows_equal_cut_ones(spark, monkeypatch):
    """Small bounds, so that texts are counted in many parts; characters of two code units, control characters, whole texts of any length."""
    from lodestar.operators.aggregates import idf, window_idf

    texts = ["abc abcdef, abcdef", "abc", " A ", ",,,", "", None, " \t", "İx ß", "😀😀ab 😀😀ab", "a\0b\0c", "abcdefg" * 5, "one two three four five six seven eight", "ONE two three four five six seven eight ", "x.y", "机器学习，数据", "0\x0b1"]
    df = spark.createDataFrame(list(enumerate(texts * 3)), "id long, t string").repartition(2)
    cut = idf(df.select(X.tokenize_windows(F.col("t")).alias("terms")), top=10_000)
    want = {(r["term"], r["df"], round(r["idf"], 9)) for r in cut.collect()}
    assert len(want) > 60 and ("one two three four five six seven eight", 6) in {x[:2] for x in want}
    assert {(r["term"], r["df"], round(r["idf"], 9)) for r in window_idf(df, "t", top=10_000).collect()} == want
    best = sorted(want, key=lambda x: (-x[1], x[0].encode()))[:40]
    assert {(r["term"], r["df"]) for r in window_idf(df, "t", top=40).collect()} == {x[:2] for x in best}
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": [(t or "").lower() for t in texts], "whole": [(t or "").strip().lower() for t in texts]})

    def counts():
        out = {}
        for made in X.window_counts([batch] * 70):
            for term, digest, n in zip(*(made.column(c).to_pylist() for c in ("term", "digest", "df")), strict=True):
                out[term or digest] = out.get(term or digest, 0) + n
        return out

    whole = counts()
    for name in ("_TOGETHER", "_HELD"):
        monkeypatch.setattr(X, name, 20)
    assert counts() == whole and max(whole.values()) >= 140
