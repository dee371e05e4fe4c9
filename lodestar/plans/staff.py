"""Queries of page extraction over pages that name people: a page of each kind for every supplier, with what must be found in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as E
from ..sources.fixtures import table
from .registry import query

#: id, a name of three Han characters, host: one row a supplier. Spark and DuckDB run it alike.
_S = "SELECT s_suppkey AS id, translate(lpad(CAST(s_suppkey % 1000 AS VARCHAR(9)), 3, '0'), '0123456789', '张王李刘陈杨黄周吴徐') AS han, concat('http://cs', CAST(s_suppkey AS VARCHAR(9)), '.x.edu') AS host FROM {supplier}"
_SQL = f"s AS ({_S.format(supplier='supplier')})"

_LIST = "<title>师资队伍</title><ul><li><a href='/t/a1.htm'>赵{han}</a> 教授</li><li><a href='/teacher/li.htm'>钱{han}</a></li><li><a href='/n/{id}.htm'>孙{han}</a></li><li><a href='/nav'>通知公告栏目</a></li></ul><a href='list2.htm'>2</a><a href='list3.htm'>3</a><a href='?page=4'>more</a><a href='x.htm'>下一页</a>"
_CARDS = "<div class='c'>赵{han} 教授<a href='/p/1.htm'>详情</a></div><div class='c'>钱{han} 讲师<a href='/p/2.htm'>详情</a></div><div class='c'>孙{han}<a href='/p/3.htm'>详情</a></div><p class='n'><a href='/n1'>x</a></p><script>var d=[{\"name\":\"李{han}\",\"url\":\"/p/{id}.htm\",\"title\":\"讲师\"},{\"x\":1,\"nothing\":\"here at all\"}]</script>"
_PROFILE = "<title>赵{han}-某大学</title><h1>赵{han}</h1><dl><dt>职称</dt><dd>副教授</dd><dt>邮箱</dt><dd>p{id}@x.edu.cn</dd></dl><p>研究方向：图像处理与机器学习{id}。</p><p>诚招学生</p><a href='https://orcid.org/{id}'>o</a>"
_LAB = "<title>视觉{han}实验室-某大学</title><p>负责人：赵{han}</p><p>成员：钱{han}、孙{han}；李{han}</p><p>研究方向：图像分析与理解{id}。</p>"
_NOTICE = "<title>2025年夏令营通知</title><p>发布 2025-05-01，计划招收 {id} 名，GPA ≥ 3.5，排名前20%，截止 2025年6月10日，n{id}@b.cn</p>"
_TABLE = "<title>名单</title><table><tr><td>姓名</td><td>专业</td></tr><tr><td>赵{han}</td><td>软件</td><td>{id}</td></tr><tr><td>钱{han}</td><td>网络</td><td>2</td></tr></table>"
_HOME = "<title>首页</title><a href='/xy/cs.htm'>计算机学院</a><a href='http://soft.cs{id}.x.edu/'>软件学院</a><a href='/xy/law.htm'>法学院</a><a href='/szdw/js.htm'>师资队伍</a><a href='/szdw/fjs.htm'>副高</a><a href='/news/1.htm'>新闻</a>"
_PROSE = "某大学 导师：赵{han}、钱{han}。其他内容"


def _suppliers(spark, sf_dir):
    return spark.sql(_S, supplier=table(spark, sf_dir, "supplier"))


def _filled(template):
    return F.replace(F.replace(F.lit(template), F.lit("{han}"), F.col("han")), F.lit("{id}"), F.col("id").cast("string"))


def _facts(spark, sf_dir, template, path):
    return E.parse(_suppliers(spark, sf_dir).select(F.col("id").alias("page_id"), F.concat("host", F.lit(path)).alias("url"), _filled(template).alias("html")))


@query(f"""WITH {_SQL} SELECT id AS page_id, host || '/t/a1.htm' AS url, '赵' || han AS name, 1 AS strategy FROM s UNION ALL SELECT id, host || '/teacher/li.htm', '钱' || han, 2 FROM s UNION ALL SELECT id, host || '/n/' || id || '.htm', '孙' || han, 4 FROM s""")
def person_links(spark, sf_dir):
    return E.person_links(E.extract_links(_facts(spark, sf_dir, _LIST, "/szdw/list.htm"))).select("page_id", "url", "name", "strategy")


@query(f"""WITH {_SQL} SELECT id AS page_id, 'div.c' AS fp, '赵' || han AS name, '教授' AS title, '/p/1.htm' AS href FROM s UNION ALL SELECT id, 'div.c', '钱' || han, '讲师', '/p/2.htm' FROM s UNION ALL SELECT id, 'div.c', '孙' || han, NULL, '/p/3.htm' FROM s""")
def repeated_records(spark, sf_dir):
    found = E.repeated_records(_facts(spark, sf_dir, _CARDS.replace("孙{han}<a", "孙{han} <a"), "/szdw/"))
    return found.select("page_id", "fp", "name", "title", F.regexp_replace("href", "^http://[^/]*", "").alias("href"))


@query(f"""WITH {_SQL} SELECT id AS page_id, '李' || han AS name, '/p/' || id || '.htm' AS href, '讲师' AS title FROM s""")
def script_records(spark, sf_dir):
    return E.script_records(_facts(spark, sf_dir, _CARDS, "/szdw/")).select("page_id", "name", "href", "title")


@query(f"""WITH {_SQL} SELECT id AS page_id, '副教授' AS title, 'p' || id || '@x.edu.cn' AS email, '图像处理与机器学习' || id AS areas, true AS recruiting, 'https://orcid.org/' || id AS orcid, '赵' || han AS name FROM s""")
def staff_profiles(spark, sf_dir):
    facts = _facts(spark, sf_dir, _PROFILE, "/t/a1.htm")
    return E.extract_profile(facts).join(E.resolve_person_name(facts), "page_id").select("page_id", "title", "email", "areas", "recruiting", "orcid", "name")


@query(f"""WITH {_SQL} SELECT host || '/t/a1.htm' AS profile_url, '赵' || han AS name, '副教授' AS title, 'p' || id || '@x.edu.cn' AS email, '图像处理与机器学习' || id AS areas FROM s UNION ALL SELECT host || '/teacher/li.htm', '钱' || han, NULL, NULL, NULL FROM s UNION ALL SELECT host || '/n/' || id || '.htm', '孙' || han, NULL, NULL, NULL FROM s""")
def extracted_people(spark, sf_dir):
    lists, profiles = _facts(spark, sf_dir, _LIST, "/szdw/list.htm"), _facts(spark, sf_dir, _PROFILE, "/t/a1.htm")
    return E.extract_people(lists, profiles, "某大学").select("profile_url", "name", "title", "email", "areas")


@query(f"""WITH {_SQL} SELECT id AS page_id, '视觉' || han || '实验室' AS lab_name, '赵' || han AS pi, '图像分析与理解' || id AS areas, array_to_string(list_sort(['钱' || han, '孙' || han, '李' || han]), '|') AS members, false AS recruiting FROM s""")
def extracted_labs(spark, sf_dir):
    return E.extract_lab(_facts(spark, sf_dir, _LAB, "/lab/1.htm")).select("page_id", "lab_name", "pi", "areas", F.array_join("members", "|").alias("members"), "recruiting")


@query(f"""WITH {_SQL} SELECT id AS page_id, 'camp' AS category, '2025-05-01' AS published_at, '2025年6月10日' AS deadline, CAST(id AS VARCHAR) AS quota, '3.5' AS gpa, '20' AS rank, 'n' || id || '@b.cn' AS email FROM s""")
def extracted_notices(spark, sf_dir):
    found = E.extract_notice(_facts(spark, sf_dir, _NOTICE, "/tzgg/1.htm"))
    part = lambda key, name: F.get_json_object("extra_json", f"$.{key}").alias(name)
    return found.select("page_id", "category", "published_at", part("deadline", "deadline"), part("quota", "quota"), part("gpaReq", "gpa"), part("rankReq", "rank"), part("email", "email"))


@query(f"""WITH {_SQL} SELECT id AS page_id, k.kind, k.page_type FROM s CROSS JOIN (VALUES ('list', 'teacher_list'), ('lab', 'lab'), ('notice', 'notice'), ('home', 'teacher_list'), ('table', 'unknown')) k(kind, page_type)""")
def page_classes(spark, sf_dir):
    out = None
    for kind, template, path in (("list", _LIST, "/szdw/list.htm"), ("lab", _LAB, "/lab/1.htm"), ("notice", _NOTICE, "/tzgg/1.htm"), ("home", _HOME, "/"), ("table", _TABLE, "/x/1.htm")):
        made = E.classify_page(_facts(spark, sf_dir, template, path)).select("page_id", F.lit(kind).alias("kind"), "page_type")
        out = made if out is None else out.union(made)
    return out


@query(f"""WITH {_SQL} SELECT id AS page_id, 'plan' AS category, '赵' || han || ' | 软件 | ' || id AS item FROM s UNION ALL SELECT id, 'plan', '钱' || han || ' | 网络 | 2' FROM s""")
def supervisor_rows(spark, sf_dir):
    found = E.extract_supervisor_rows(_facts(spark, sf_dir, _TABLE, "/x/1.htm"))
    return found.select("page_id", "category", "item").where("not item like '姓名%'")


@query(f"""WITH {_SQL} SELECT id AS page_id, '赵' || han AS name FROM s UNION ALL SELECT id, '钱' || han FROM s""")
def people_in_prose(spark, sf_dir):
    texts = _suppliers(spark, sf_dir).select(F.col("id").alias("page_id"), _filled(_PROSE).alias("text"))
    return E.mine_prose_people(texts, "某大学").select("page_id", "name")


@query(f"""WITH {_SQL} SELECT id AS item_id, '赵' || han AS name, '副研究员' AS title FROM s UNION ALL SELECT id, '钱' || han, '副研究员' FROM s""")
def authors_in_lists(spark, sf_dir):
    items = _suppliers(spark, sf_dir).select(F.col("id").alias("item_id"), _filled("作者：赵{han}，钱{han}\n副研究员").alias("text"))
    return E.mine_author_lists(items).select("item_id", "name", "title")


@query(f"""WITH {_SQL} SELECT id AS page_id, host || '/szdw/list2.htm' AS url FROM s UNION ALL SELECT id, host || '/szdw/list.htm?page=4' FROM s UNION ALL SELECT id, host || '/szdw/x.htm' FROM s UNION ALL SELECT id, host || '/n/' || id || '.htm' FROM s WHERE id < 1000""")
def frontier(spark, sf_dir):
    links = E.followable(E.extract_links(_facts(spark, sf_dir, _LIST, "/szdw/list.htm")))
    return E.crawl_frontier(links, _suppliers(spark, sf_dir).select(F.concat("host", F.lit("/szdw/list3.htm")).alias("url")))


@query(f"""WITH {_SQL} SELECT id AS page_id, host || '/xy/cs.htm' AS url, '计算机学院' AS text FROM s UNION ALL SELECT id, 'http://soft.cs' || id || '.x.edu/', '软件学院' FROM s""")
def college_links(spark, sf_dir):
    return E.discover_colleges(E.extract_links(_facts(spark, sf_dir, _HOME, "/")), "http://x.edu/")


@query(f"""WITH {_SQL} SELECT host || '/szdw/js.htm' AS url, 1 AS hop FROM s UNION ALL SELECT host || '/szdw/fjs.htm', 3 FROM s""")
def list_pages(spark, sf_dir):
    return E.discover_list_pages(E.extract_links(_facts(spark, sf_dir, _HOME, "/"))).select("url", "hop")


# Pages at the known paths of 40 sites, one a part: whether title or text say what they are, and where, goes by p_partkey.
_SITED = """SELECT p_partkey AS id, concat('http://s', CAST(p_partkey % 40 AS VARCHAR(9)), '.x.edu') AS base, CAST(p_partkey / 40 AS BIGINT) % 70 AS path,
    CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, ' 实验室 通知公告 招生') ELSE p_brand END AS title,
    concat(CASE p_partkey % 3 WHEN 1 THEN rpad('.', 350, '.') ELSE rpad('.', 450, '.') END, ' 联合实验室 推免报名') AS text FROM {part} WHERE p_size < 26"""
_DIV = _SITED.replace("CAST(p_partkey / 40 AS BIGINT)", "(p_partkey - p_partkey % 40) / 40")


def _by_path(kind: str) -> str:
    rule = E.PATH_RULES[kind]
    way = ", ".join(f"('{w}', {i})" for i, w in enumerate(rule.paths))
    says = "id % 3 = 0" + (" OR id % 3 = 1" if rule.head >= 400 else "")
    return f"""SELECT '{kind}' AS kind, base, row_number() OVER (PARTITION BY base ORDER BY path) AS n, base || way AS url FROM (SELECT DISTINCT base, CAST(path AS INTEGER) AS path FROM p WHERE {says}) JOIN (VALUES {way}) w(way, i) ON i = path
QUALIFY n <= {rule.enough}"""


@query(f"""WITH p AS ({_DIV.format(part="part")}) {_by_path("lab")} UNION ALL {_by_path("notice")}""")
def pages_by_paths(spark, sf_dir):
    sited = spark.sql(_DIV, part=table(spark, sf_dir, "part")).withColumn("path", F.col("path").cast("int"))
    out = None
    for kind, rule in E.PATH_RULES.items():
        ways = F.array(*map(F.lit, rule.paths))
        pages = sited.where(F.col("path") < len(rule.paths)).select(F.col("id").alias("page_id"), F.concat("base", F.element_at(ways, F.col("path") + 1)).alias("url"), "title", "text")
        found = E.discover_by_paths(pages, sited.select("base"), kind).select(F.lit(kind).alias("kind"), "base", F.col("n").cast("long").alias("n"), "url")
        out = found if out is None else out.union(found)
    return out
