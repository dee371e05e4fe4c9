"""Page extraction on one hand-made page for each layout and strategy."""

import pytest

from lodestar.functions.predicates import HAN  # noqa: F401
from lodestar.operators import pages as E
from pyspark.sql import functions as F

BASE = "http://cs.x.edu.cn/szdw/list.htm"


@pytest.fixture(scope="module")
def facts_of(spark):
    def made(*pages):
        rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
        return E.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))

    return made


def test_parse_tolerates_broken_html(facts_of):
    r = facts_of((BASE, "<html><head><title> A  b </title><meta name='Description' content='d &amp; e'></head><body><p>one<p>two <b>bold<br>x</p><script>var a='<p>';</script><a href='../t/1.htm'>张三</a></div></body>"), (BASE, None), ("http://x/", "<a href='http://[bad'>x</a>")).collect()
    assert (r[0]["title"], r[0]["meta_description"]) == ("A b", "d & e") and "one" in r[0]["text"] and "var a" not in r[0]["text"] and r[0]["scripts"] == ["var a='<p>';"]
    assert (r[0]["links"][0]["url"], r[0]["links"][0]["text"]) == ("http://cs.x.edu.cn/t/1.htm", "张三")
    assert r[1]["links"] == [] and r[1]["text"] == "" and r[2]["links"][0]["url"] == ""


LAYOUTS = {
    "dl": "<dl><dt>职称</dt><dd>教授</dd><dt>研究方向</dt><dd>图像处理与机器学习</dd></dl>",
    "th": "<table><tr><th>职称</th><td>教授</td></tr><tr><th>研究方向</th><td>图像处理与机器学习</td></tr></table>",
    "td": "<table><tr><td>职称</td><td>教授</td></tr><tr><td>研究方向</td><td>图像处理与机器学习</td></tr></table>",
    "strong": "<p><strong>职称:</strong> 教授</p><p><strong>研究方向:</strong> 图像处理与机器学习</p>",
    "meta": "<meta name='description' content='教授，研究方向：图像处理与机器学习'>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_profile_layouts(facts_of, layout):
    r = E.extract_profile(facts_of((BASE, LAYOUTS[layout]))).first()
    assert (r["title"], r["areas"]) == ("教授", "图像处理与机器学习")


def test_profile_precedence_and_links(facts_of):
    html = "<p>研究方向：正文里的研究方向。邮箱 a@x.edu.cn 欢迎报考</p>" + LAYOUTS["dl"] + "<a href='https://orcid.org/1'>o</a><a href='https://scholar.google.com/c?u=1'>g</a>"
    r = E.extract_profile(facts_of((BASE, html))).first()
    assert (r["areas"], r["title"], r["email"], r["recruiting"], r["orcid"], r["google_scholar"]) == ("正文里的研究方向", "教授", "a@x.edu.cn", True, "https://orcid.org/1", "https://scholar.google.com/c?u=1")
    long = E.extract_profile(facts_of((BASE, "<p>" + "研" * 130 + "</p>"))).first()
    assert long["areas"] == "研" * 100


def test_person_links_by_strategy(facts_of):
    html = "<ul><li><a href='/a/x1.htm'>张三</a> 教授</li><li><a href='/teacher/li.htm'>李四</a></li><li><a href='/n/9.htm'>王五</a></li><li><a href='/nav'>通知公告栏目</a></li></ul>"
    got = {r["name"]: r["strategy"] for r in E.person_links(E.extract_links(facts_of((BASE, html)))).collect()}
    assert "下一页" not in {r["name"] for r in E.person_links(E.extract_links(facts_of((BASE, "<a href='x.htm'>下一页</a>")))).collect()}
    assert got["张三"] == 1 and got["李四"] == 2 and got["王五"] == 4 and "通知公告栏目" not in got


def test_records_scripts_and_people(facts_of, spark):
    cards = "".join(f"<div class='c'>{n} 教授<a href='/p/{i}.htm'>详情</a></div>" for i, n in enumerate(["张三", "李四", "王五"]))
    script = "<script>var d=[{\"name\":\"赵六\",\"url\":\"/p/7.htm\",\"title\":\"讲师\"},{\"x\":1,\"nothing\":\"here at all\"}]</script>"
    nav = "".join(f"<li class='n'>链接{i}a<a href='/n{i}'>x</a></li>" for i in range(9))
    facts = facts_of((BASE, cards + nav), (BASE, script), (BASE, nav))
    assert sorted((r["page_id"], r["name"], r["title"]) for r in E.repeated_records(facts).collect()) == [(0, "张三", "教授"), (0, "李四", "教授"), (0, "王五", "教授")]
    assert [tuple(r)[3:6] for r in E.script_records(facts).collect()] == [("赵六", "/p/7.htm", "讲师")]
    listing = facts_of((BASE, "<li><a href='/szdw/1.htm'>张三</a> 教授</li><li><a href='http://other.com/1.htm'>李四</a> 教授</li>"))
    profile = facts_of(("http://cs.x.edu.cn/szdw/1.htm", "<h1>张三</h1><p>副教授 研究方向：软件工程与软件测试。</p>"))
    got = E.extract_people(listing, profile, "某大学").collect()
    assert [(r["name"], r["title"], r["areas"]) for r in got] == [("张三", "副教授", "软件工程与软件测试")]


def test_names_labs_notices(facts_of):
    assert E.resolve_person_name(facts_of((BASE, "<title>首页-李四-计算机</title><h1>王五</h1>"))).first()["name"] in ("首页", "李四")
    lab = E.extract_lab(facts_of((BASE, "<title>视觉实验室-某大学</title><p>负责人：张三</p><p>成员：李四、王五；赵六</p><p>研究方向：图像分析与场景理解。</p>"))).first()
    assert (lab["lab_name"], lab["pi"], lab["members"], lab["areas"]) == ("视觉实验室", "张三", ["李四", "王五", "赵六"], "图像分析与场景理解")
    n = E.extract_notice(facts_of((BASE, "<title>2025年夏令营通知</title><p>发布 2025-05-01，招收 30 名，GPA 3.5，截止 2025年6月10日，a@b.cn</p>"))).first()
    assert n["category"] == "camp" and n["published_at"] == "2025-05-01" and '"deadline":"2025年6月10日"' in n["extra_json"] and '"quota":30' in n["extra_json"]


def test_page_classes_and_ties(facts_of):
    pages = [("http://x/a", "<title>师资队伍</title>"), ("http://x/lab/1", "<title>智能实验室</title>"), ("http://x/notice", "<title>通知</title><p>2025-01-02</p>"), ("http://x/a", "<title>招生计划</title>"), ("http://x/a", "<title>x</title>"), ("http://x/a", "<title>计划通知</title>")]
    got = [r["page_type"] for r in E.classify_page(facts_of(*pages)).orderBy("page_id").collect()]
    assert got == ["teacher_list", "lab", "notice", "plan", "unknown", "plan"]


def test_supervisors_prose_and_authors(facts_of, spark):
    facts = facts_of((BASE, "<title>t</title><table><tr><td>姓名</td><td>专业</td></tr><tr><td>张三</td><td>软件</td><td>2</td></tr></table>"), (BASE, "<title>only notice</title>"))
    got = {(r["page_id"], r["category"], r["item"]) for r in E.extract_supervisor_rows(facts).collect()}
    assert (0, "plan", "张三 | 软件 | 2") in got and (1, "notice", "only notice") in got
    texts = spark.createDataFrame([(1, "某大学 导师：张三、李四。"), (2, "某大学的王五教授 研究方向：图像。"), (3, "别校 导师：赵六")], "page_id int, text string")
    assert {(r["page_id"], r["name"]) for r in E.mine_prose_people(texts, "某大学").collect()} >= {(1, "张三"), (1, "李四")} and not any(r["page_id"] == 3 for r in E.mine_prose_people(texts, "某大学").collect())
    items = spark.createDataFrame([(1, "作者：张三，李四\n研究方向：图像。")], "item_id int, text string")
    assert {r["name"] for r in E.mine_author_lists(items).collect()} == {"张三", "李四"}


def test_frontier_and_lists(facts_of, spark):
    html = "<a href='list2.htm'>2</a><a href='list3.htm'>3</a><a href='x.htm'>下一页</a><a href='a.htm'>张三</a><a href='?page=4'>more</a>"
    links = E.extract_links(facts_of((BASE, html)))
    got = {r["url"].rsplit("/", 1)[1] for r in E.crawl_frontier(links, spark.createDataFrame([("http://cs.x.edu.cn/szdw/list3.htm",)], "url string")).collect()}
    assert got == {"list2.htm", "x.htm", "list.htm?page=4"}
    found = E.discover_list_pages(E.extract_links(facts_of(("http://cs.x.edu.cn/", "<a href='/szdw/js.htm'>师资队伍</a><a href='/szdw/fjs.htm'>副高</a><a href='/news/1.htm'>新闻</a>")))).collect()
    assert {(r["url"].rsplit("/", 1)[1], r["hop"]) for r in found} == {("js.htm", 1), ("fjs.htm", 3)}
    colleges = E.discover_colleges(E.extract_links(facts_of(("http://www.x.edu.cn/", "<a href='http://cs.x.edu.cn/'>计算机学院</a><a href='http://art.x.edu.cn/'>艺术学院</a>"))), "http://www.x.edu.cn/").collect()
    assert [r["text"] for r in colleges] == ["计算机学院"]


def test_addresses(spark):
    from urllib.parse import urljoin

    base = "http://a.b/c/d.htm?q=1#f"
    for href in ("http://z/x", "//h/p", "/r", "?x=2", "#g", "e.htm", "s/t.htm", ""):
        got = spark.createDataFrame([(base, href)], "b string, h string").select(E.resolve_url(F.col("b"), F.col("h")).alias("u")).first()["u"]
        assert got.split("#")[0] == urljoin(base, href).split("#")[0], href
    got = spark.createDataFrame([("http://x/l.htm",), ("http://x/l?page=1&k=2",), ("http://x/l",), ("http://x/l_3.html",)], "u string").select(E.page_variants(F.col("u"), 3).alias("v")).collect()
    assert [r["v"] for r in got] == [["http://x/l_2.htm", "http://x/l_3.htm"], ["http://x/l?page=2&k=2", "http://x/l?page=3&k=2"], ["http://x/l?pageNo=2", "http://x/l?pageNo=3"], ["http://x/l_2.html", "http://x/l_3.html"]]


def test_pages_by_paths(spark):
    base = "http://cs.x.edu.cn"
    rows = [
        (1, base + "/labs/", "Our page", "x" * 200 + " Research  Group list"),
        (2, base + "/lab/", "", "x" * 301 + "实验室"),
        (3, base + "/research/", "Labour law", "none"),
        (4, base + "/other/", "实验室", ""),
        (5, base + "/kyjg/", None, "AI Lab"),
        *((10 + i, base + p, "招生简章", None) for i, p in enumerate(E.NOTICE_PATHS[:9])),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, title string, text string")
    links = spark.createDataFrame(
        [(1, 0, base + "/g1.htm", "视觉课题组"), (1, 1, base + "/news.htm", "新闻"), (1, 2, "http://other.org/lab.htm", "实验室"), (1, 3, base + "/kyjg/", "实验室"), (4, 0, base + "/g2.htm", "课题组"), (5, 0, base + "/g3.htm", "研究组")],
        "page_id long, at int, url string, text string",
    )
    bases = spark.createDataFrame([(base,), (base,), ("http://none.edu",)], "base string")
    got = [(r["n"], r["url"].removeprefix(base)) for r in E.discover_by_paths(pages, bases, "lab", links).orderBy("n").collect()]
    assert got == [(1, "/labs/"), (2, "/g1.htm"), (3, "/kyjg/"), (4, "/g3.htm")]
    got = [(r["n"], r["url"].removeprefix(base)) for r in E.discover_by_paths(pages, bases, "notice").orderBy("n").collect()]
    assert got == [(i + 1, p) for i, p in enumerate(E.NOTICE_PATHS[:5])]


def test_parser_hands_facts_on_before_a_batch_ends():
    import pyarrow as pa

    html = "<p>x</p>" * (E.SLICE_CHARS // 16)
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, 4, 5], "url": ["u"] * 5, "html": [html, html, None, html, html]})
    out = list(E._parser([("page_id", pa.int64()), ("text", pa.string())])(iter([batch])))
    assert [b.column("page_id").to_pylist() for b in out] == [[1, 2], [3, 4, 5]] and out[1].column("text")[0].as_py() == ""


def test_parse_gives_only_columns_asked(spark):
    pages = spark.createDataFrame([(1, BASE, "<title>t</title><p>x<a href='a.htm'>n</a></p>")], "page_id long, url string, html string")
    r = E.parse(pages, ["page_id", "links"]).first()
    assert r.asDict().keys() == {"page_id", "links"} and r["links"][0]["url"] == "http://cs.x.edu.cn/szdw/a.htm"


def test_titles_as_written(spark):
    from lodestar.functions.text import written_title

    rows = [("<title> a &amp; b\n c</title><title>d</title>",), ("<title>and&amp</title>",), ("<title>&quot;q</title>",), ("<title></title><title>z</title>",), ("<title>open",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "html string").select(written_title(F.col("html"))).collect()]
    assert got == ["a & b c", "and&amp", "&quot;q", "", "", None]
