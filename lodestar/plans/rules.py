"""Queries of name, link and note rules, labels and scores of single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import joins as J
from ..operators import pages as E
from ..operators import retrieval as R
from ..operators import searches as Q
from ..operators import windows as W
from ..sources import feeds as S
from ..sources.fixtures import cte, table, view
from .registry import query

_HAN = "一-鿿"
_CLEAN = rf"regexp_replace(regexp_replace(coalesce(name, ''), '（[^）]*）|\([^)]*\)|副教授|教授|博士生导师|博士|导师|讲师|研究员|院士|老师', '', 'g'), '[\x00-\x7f\s·•、，。：；　]', '', 'g')"


@query(rf"""WITH {cte("han_names")} SELECT id, trim(coalesce(name, '')) = '' OR coalesce(regexp_matches(name, '返回'), false) AS bad, coalesce(regexp_matches(name, '^[{_HAN}]{{2,5}}$'), false) AS han,
coalesce((regexp_matches(name, '^[{_HAN}]{{2,5}}$') OR regexp_matches(name, '^[A-Z][a-z]+(\s[A-Z][a-z]+){{1,3}}$')) AND NOT regexp_matches(name, '返回') AND trim(name) <> '' AND NOT regexp_matches(name, '(大学|学院|研究所|研究院|实验室|中心)$') AND name <> university, false) AS valid,
NOT (length(trim(coalesce(name, ''))) NOT BETWEEN 2 AND 12 OR regexp_matches(trim(coalesce(name, '')), '[0-9]|^返回|^(?i:http|www\.)|^<|(大学|学院|系|所|中心|实验室)$')) AS strict,
CASE WHEN regexp_matches({_CLEAN}, '^[{_HAN}]{{2,5}}$') THEN {_CLEAN} ELSE '' END AS cleaned, length(regexp_replace(coalesce(name, ''), '[^{_HAN}]', '', 'g')) AS n_han FROM han_names""")
def checked_names(spark, sf_dir):
    name, university = F.col("name"), F.col("university")
    false = lambda c: F.coalesce(c, F.lit(False))
    return view(spark, sf_dir, "han_names").select("id", false(P.is_bad_name(name, roots=("返回",))).alias("bad"), false(P.is_han_name(name)).alias("han"), P.valid_person(name, university, roots=("返回",)).alias("valid"), P.clean_people_strict(name, university).alias("strict"), X.clean_name(name).alias("cleaned"), X.char_count_han(name).alias("n_han"))


# Expected fields of each kind of note, stated from how the view makes it, not by rules over its text.
@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 9 AS INTEGER) AS kind, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders),
d AS (SELECT *, kind = 3 AND TRY_CAST('2025-' || k % 14 || '-' || k % 34 AS DATE) IS NOT NULL AS dated FROM o)
SELECT id, CASE kind WHEN 0 THEN '正教授' WHEN 1 THEN 'Associate Professor' WHEN 4 THEN '研究员' WHEN 6 THEN 'Lecturer' END AS title,
CASE kind WHEN 0 THEN lower(p) || ' systems and data' WHEN 1 THEN 'large scale ' || p || ' learning' WHEN 4 THEN s || ' 长期从事机器学习与数据挖掘方面的研究工作' WHEN 7 THEN 'short ' || p END AS areas,
CASE WHEN kind = 3 THEN '2026/1/2' END AS deadline, CASE WHEN dated THEN 2 WHEN kind = 3 THEN 1 ELSE 0 END AS n_dates,
CAST(CASE kind WHEN 2 THEN k % 90 WHEN 5 THEN k % 7 WHEN 7 THEN 25 END AS DOUBLE) AS quota, CAST(CASE WHEN kind = 2 THEN '3.' || k % 10 END AS DOUBLE) AS gpa, CAST(CASE kind WHEN 2 THEN k % 50 WHEN 5 THEN k % 30 END AS DOUBLE) AS rank,
kind IN (4, 5, 6) AS recruiting, kind IN (0, 6) AS faculty, kind = 5 AS notice FROM d""")
def note_fields(spark, sf_dir):
    t = F.col("text")
    return view(spark, sf_dir, "notes").select("id", X.extract_title(t).alias("title"), X.extract_areas(t).alias("areas"), X.deadline(t).alias("deadline"), F.size(X.extract_dates(t)).alias("n_dates"), X.extract_quota(t).cast("double").alias("quota"), X.extract_gpa(t).alias("gpa"), X.extract_rank(t).cast("double").alias("rank"), X.is_recruiting(t).alias("recruiting"), P.likely_faculty(t).alias("faculty"), P.notice_relevant(t).alias("notice"))


_HREF = "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '#top' WHEN 2 THEN 'javascript:void(0)' WHEN 3 THEN 'MAILTO:a@b.c' WHEN 4 THEN concat('/files/', CAST(event_id AS VARCHAR(20)), '.PDF') WHEN 5 THEN concat('//h.example.org/', CAST(event_id AS VARCHAR(20))) WHEN 6 THEN concat('?page=', CAST(event_id AS VARCHAR(20))) ELSE concat('/list/', CAST(event_id AS VARCHAR(20)), '.htm') END"
_BASE = "concat('http://cs.example.edu/dir', CAST(user_id AS VARCHAR(20)), '/index.htm')"


@query(f"""WITH l AS (SELECT event_id, {_HREF} AS href, {_BASE} AS base, user_id FROM events)
SELECT event_id, href = '' OR href LIKE '#%' OR href LIKE 'java%' OR href LIKE 'MAIL%' OR href LIKE '%.PDF' AS skipped,
CASE WHEN href = '' THEN base WHEN href LIKE '#%' THEN base || href WHEN href LIKE 'java%' OR href LIKE 'MAIL%' THEN href WHEN href LIKE '//%' THEN 'http:' || href WHEN href LIKE '?%' THEN base || href ELSE 'http://cs.example.edu' || href END AS url FROM l""")
def resolved_links(spark, sf_dir):
    links = table(spark, sf_dir, "events").select("event_id", F.expr(_HREF).alias("href"), F.expr(_BASE).alias("base"))
    return links.select("event_id", P.skip_href(F.col("href")).alias("skipped"), E.resolve_url(F.col("base"), F.col("href")).alias("url"))


@query("""SELECT event_id, event_id % 5 > 0 AND (event_id % 3 < 2 OR (event_id % 4 < 2 AND user_id % 4 < 2)) AS home FROM events""")
def home_redirects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = F.expr("case when event_id % 5 > 0 then 'http://u.edu/szdw/a.htm' else 'http://u.edu/' end")
    final = F.expr("case event_id % 3 when 0 then 'http://u.edu/' when 1 then 'http://u.edu/index.jsp' else 'http://u.edu/szdw/a.htm' end")
    title = F.expr("case event_id % 4 when 0 then 'Home' when 1 then null when 2 then 'Our Faculty' else 'A long title of some other page' end")
    return e.select("event_id", P.is_home_redirect(asked, final, title, F.expr("user_id % 4")).alias("home"))


@query("""WITH t AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '清华大学' WHEN 1 THEN '上海交通大学' WHEN 2 THEN '华中科技大学' ELSE '某学院' END AS university, CASE s_suppkey % 5 WHEN 0 THEN '清华园的老师' WHEN 1 THEN '上海交通的老师' WHEN 2 THEN '华中科技大学主页' WHEN 3 THEN '某学院和清华大学' ELSE '无' END AS title FROM supplier)
SELECT id, CASE university WHEN '清华大学' THEN contains(title, '清华大学') WHEN '上海交通大学' THEN contains(title, '上海交通') WHEN '华中科技大学' THEN contains(title, '华中科技') ELSE contains(title, '某学院') END AS named,
id % 3 = 0 OR id % 4 < 2 AS fits FROM t""")
def university_titles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    university = F.expr("case s_suppkey % 4 when 0 then '清华大学' when 1 then '上海交通大学' when 2 then '华中科技大学' else '某学院' end")
    title = F.expr("case s_suppkey % 5 when 0 then '清华园的老师' when 1 then '上海交通的老师' when 2 then '华中科技大学主页' when 3 then '某学院和清华大学' else '无' end")
    fields = F.expr("case when s_suppkey % 3 = 0 then cast(array() as array<string>) when s_suppkey % 4 = 0 then array('Medicine', 'Computer Science') when s_suppkey % 4 = 1 then array('Health Informatics Information') else array('Medicine', null) end")
    return s.select(F.col("s_suppkey").alias("id"), P.title_names_university(title, university).alias("named"), P.in_field(fields).alias("fits"))


@query(f"""WITH {cte("url_checks")} SELECT id, n_name AS university, status_code FROM url_checks JOIN nation ON n_nationkey = univ_id WHERE NOT ok ORDER BY n_name, id""")
def failed_urls(spark, sf_dir):
    checks = view(spark, sf_dir, "url_checks").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = univ_id")).select("id", F.col("n_name").alias("university"), F.lit(None).cast("string").alias("department"), "ok", "status_code")
    return Q.url_check_filter(checks, ok=False).select("id", "university", "status_code")


@query("SELECT item_id AS id, text FROM benchmark ORDER BY item_id LIMIT 25")
def listed_questions(spark, sf_dir):
    return Q.list_questions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("c").alias("category")), "c", 25).select("id", "text")


@query("""SELECT c_custkey AS id, n_name || ' lab, ' || CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '' END AS org, o.name AS university FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT n_name AS name, lower(n_name) AS en FROM nation) o ON contains(lower(n_name || ' lab, ' || CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '' END), split_part(o.en, ' ', 1)) OR contains(lower(n_name || ' lab, '), left(o.name, 2))""")
def affiliations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    people = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("id"), F.expr("concat(n_name, ' lab, ', case when c_custkey % 2 = 0 then n_name else '' end)").alias("org"))
    return J.affiliation_join(people, nation.select(F.col("n_name").alias("name"), F.lower("n_name").alias("en_name"))).select("id", "org", "university")


@query("SELECT s_suppkey AS id, coalesce(r_name, CAST(s_nationkey AS VARCHAR)) AS full_name, r_name AS known FROM supplier LEFT JOIN region ON r_regionkey = s_nationkey")
def looked_up(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("short"))
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value"))
    return J.lookup(J.lookup(rows, names, "short", "full_name"), names, "short", "known", fallback=False).select("id", "full_name", "known")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def customers_not_stored(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return J.not_yet_stored(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), stored, ["id"])


@query("""WITH s AS (SELECT o_custkey % 40 AS query_id, o_orderkey AS id, round(o_totalprice / 500000, 6) AS score FROM orders) SELECT * FROM s WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 7""")
def best_over_floor(spark, sf_dir):
    scored = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("query_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 500000, 6).alias("score"))
    return W.score_floor_topk(scored, 0.3, 7)


@query("SELECT c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance, NULL AS status, 'buyers' AS source FROM customer UNION ALL SELECT s_name, NULL, 'open', 'sellers' FROM supplier")
def united_feeds(spark, sf_dir):
    buyers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("open").alias("status"))
    return W.union_sources({"buyers": buyers, "sellers": sellers}).select("name", "balance", "status", "source")


@query("""WITH t AS (SELECT p_partkey AS id, unnest(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_brand), 'part']))) AS term FROM part) SELECT id, string_agg(coalesce(CASE lower(term) WHEN 'part' THEN '零件' WHEN 'brand#11' THEN '牌' END, term), '|' ORDER BY coalesce(CASE lower(term) WHEN 'part' THEN '零件' WHEN 'brand#11' THEN '牌' END, term)) AS terms FROM t GROUP BY id""")
def merged_terms(spark, sf_dir):
    terms = X.term_union(F.split("p_name", " "), F.array(F.lower("p_brand"), F.lit("part")))
    named = X.normalize_terms(terms, {"part": "零件", "brand#11": "牌"})
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(named), "|").alias("terms"))


@query("""SELECT o_orderkey AS id, least(100, 50 + 8 * (CAST(contains(pubs, '2022') AS INT) + CAST(contains(pubs, '2023') AS INT) + CAST(contains(pubs, '2024') AS INT) + CAST(contains(pubs, '2025') AS INT)) + least(30, o_orderkey % 14 * 3) + 5 * CAST(o_orderkey % 3 = 0 AS INT) + 5 * CAST(o_orderkey % 4 = 0 AS INT)) AS points
FROM (SELECT o_orderkey, CAST(year(o_orderdate) + 24 AS VARCHAR) || ' ' || CAST(o_orderkey % 7 + 2019 AS VARCHAR) AS pubs FROM orders)""")
def activity_scores(spark, sf_dir):
    pubs = F.concat((F.year("o_orderdate") + 24).cast("string"), F.lit(" "), (F.col("o_orderkey") % 7 + 2019).cast("string"))
    bio = F.expr("concat(case when o_orderkey % 3 = 0 then 'NSFC' else '' end, case when o_orderkey % 4 = 0 then ' 重点研发计划' else '' end)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.activity_score(bio, pubs, F.col("o_orderkey") % 14).cast("int").alias("points"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'north' WHEN c_custkey % 3 = 0 THEN 'south' ELSE 'none' END AS province, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'inst' WHEN c_custkey % 5 = 2 THEN '大学计算机' ELSE '某所' END AS department,
CASE WHEN c_custkey % 5 IN (0, 2) THEN 1.3 ELSE 1.0 END AS boost, CASE WHEN gpa >= CASE WHEN top5 THEN 3.7 ELSE 3.3 END AND pct <= 20 THEN 1.0 WHEN gpa < CASE WHEN top5 THEN 3.4 ELSE 3.0 END AND pct > 30 THEN 0.6 ELSE 0.85 END AS factor,
CASE WHEN gpa >= 3.8 THEN 'high' WHEN gpa >= 3.5 THEN 'mid' ELSE 'low' END AS stored, CASE WHEN gpa >= 3.7 THEN 'high' WHEN gpa >= 3.4 THEN 'mid' ELSE 'low' END AS compared,
CASE c_custkey % 4 WHEN 0 THEN '强' WHEN 1 THEN '弱' WHEN 2 THEN '所混合' ELSE '未知' END AS label, CASE c_custkey % 6 WHEN 0 THEN 'a；b' WHEN 1 THEN '' WHEN 2 THEN 'b' WHEN 3 THEN 'a' WHEN 4 THEN 'b' ELSE '' END AS reason
FROM (SELECT *, 2.85 + (c_custkey % 12) / 10.0 AS gpa, c_custkey % 50 AS pct, c_custkey % 2 = 0 AS top5 FROM customer)""")
def person_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("gpa", F.expr("2.85D + (c_custkey % 12) / 10.0D")).withColumn("pct", F.col("c_custkey") % 50).withColumn("top5", F.col("c_custkey") % 2 == 0)
    k = F.col("c_custkey")
    place = F.expr("concat(case when c_custkey % 4 = 1 then 'Harbin ' else '' end, case when c_custkey % 3 = 0 then 'Canton' else '' end)")
    university = F.expr("case c_custkey % 5 when 0 then '清华大学' when 1 then '某某大学' when 2 then '清华大学' else '某某大学' end")
    org = F.expr("case c_custkey % 5 when 0 then '清华大学 inst' when 1 then '某某大学inst' when 2 then '清华大学计算机' else '某所' end")
    own = F.expr("case c_custkey % 5 when 2 then '清华园' else case c_custkey % 5 when 0 then '清华大学' when 1 then '某某大学' else '别的大学' end end")
    code = F.expr("case c_custkey % 4 when 0 then 'strong' when 1 then 'weak' when 2 then 'cas_mix' else 'zzz' end")
    return c.select(k.alias("id"), X.first_rule(place, [("Harbin", "north"), ("Canton", "south")], "none").alias("province"), X.strip_prefix(org, own).alias("department"), X.tier_boost(university).alias("boost"), X.gpa_factor(F.col("gpa"), F.col("pct"), F.col("top5")).alias("factor"),
        X.gpa_bucket(F.col("gpa")).alias("stored"), X.gpa_match_bucket(F.col("gpa")).alias("compared"), X.com_label(code).alias("label"), X.reason_text([(k % 3 == 0, "a"), (k % 2 == 0, "b")]).alias("reason"))


@query("""SELECT doc_id AS id, 'Dear ' || source || ', {missing} ' || lang || '.' AS letter, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id || ' and a' ELSE 'n' || doc_id END AS salvaged, CASE WHEN doc_id % 2 = 0 THEN '2019.' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') END AS began,
CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN '2023.06' END AS ended, CASE WHEN length(text) > 3500 AND instr(text, 'license') > 1 THEN left(substr(text, instr(text, 'license')) || chr(10) || substr(text, 1, instr(text, 'license') - 1), 4000) ELSE left(text, 4000) END AS promoted FROM documents""")
def rendered_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    noisy = F.concat(F.lit('Sure: ```json {"name": "n'), key, F.expr("case when doc_id % 3 = 0 then ' and a\", \"x\": [1,}' else '\"}' end"), F.lit(" ``` done"))
    dates = F.expr("case when doc_id % 2 = 0 then concat('2019年', cast(doc_id % 12 + 1 as string), '月', case when doc_id % 4 = 0 then '至今' else ' - 2022' end) else 'no date' end")
    made = X.edu_dates(dates)
    return d.select(F.col("doc_id").alias("id"), X.render_template(F.lit("Dear {who}, {missing} {lang}."), F.create_map(F.lit("who"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("letter"), X.salvage_json(noisy, ["name"])["name"].alias("salvaged"),
        made["start"].alias("began"), made["end"].alias("ended"), X.promote_section(F.col("text"), "license").alias("promoted"))


_VENUES = {"eaux": "A", "the": "A", "sch": "B", "zzzz": "C"}


@query("SELECT doc_id AS id, CAST(contains(lower(text), 'eaux') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS a, CAST(contains(lower(text), 'sch') AS INT) AS b, CAST(contains(lower(text), 'zzzz') AS INT) AS c FROM documents")
def venues_named(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.venue_counts(F.col("text"), _VENUES).alias("v")).select("id", "v.*")


@query(f"""WITH {cte("docs")}, h AS (SELECT id, sum(CASE WHEN "top" = 'T1' THEN p END) AS t1, sum(CASE WHEN "top" = 'T2' THEN p END) AS t2, sum(p) AS p FROM (SELECT id, "top", CASE WHEN length(term) >= 4 THEN 2 ELSE 1 END AS p FROM docs JOIN (VALUES ('T1', 'the'), ('T1', 'ther'), ('T2', 'eaux'), ('T2', 'sch')) v("top", term) ON contains(lower(coalesce(research_areas, '')), term)) GROUP BY id),
d(query_id, n, dir, "top") AS (VALUES (1, 2, 'ther', 'T1'), (1, 2, 'sch', 'T2'), (2, 1, 'T2', 'T2')),
m AS (SELECT query_id, n, id, dir, CASE WHEN contains(lower(coalesce(research_areas, '')), lower(dir)) THEN 0.3 ELSE 0 END + 0.7 * coalesce(CASE "top" WHEN 'T1' THEN t1 ELSE t2 END / p, 0) AS part FROM docs CROSS JOIN d LEFT JOIN h USING (id))
SELECT query_id, id, round(least(1.0, sum(part) / n), 6) AS direction FROM m GROUP BY query_id, n, id HAVING sum(part) > 0""")
def direction_matches(spark, sf_dir):
    tree = spark.createDataFrame([("T1", "m1", "the"), ("T1", "m1", "ther"), ("T2", "m2", "eaux"), ("T2", "m2", "sch")], "top string, mid string, term string")
    wanted = spark.createDataFrame([(1, ["ther", "sch"]), (2, ["T2"])], "query_id int, dirs array<string>")
    return R.direction_match(wanted, view(spark, sf_dir, "docs").select("id", F.col("research_areas").alias("text")), tree)


@query("""WITH r AS (SELECT c_custkey AS query_id, c_mktsegment AS dir, n_name || ' studies' AS target, CASE WHEN c_custkey % 3 = 0 THEN 'knows IRON well' ELSE ' ' END AS background FROM customer JOIN nation ON c_nationkey = n_nationkey),
dict AS (SELECT DISTINCT r_name AS direction, n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey), f AS (SELECT query_id, target AS text FROM r UNION ALL SELECT query_id, background FROM r WHERE trim(background) <> ''),
said AS (SELECT DISTINCT query_id, d.direction FROM f JOIN (SELECT * FROM dict UNION SELECT direction, direction FROM dict) d ON contains(f.text, d.term))
SELECT query_id, dir AS term FROM r UNION SELECT query_id, trim(text) FROM f UNION SELECT query_id, term FROM said JOIN dict USING (direction) UNION SELECT query_id, 'METALS' FROM f WHERE contains(text, 'IRON')""")
def expanded_queries(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    dictionary = nation.join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select(F.col("r_name").alias("direction"), F.col("n_name").alias("term"))
    requests = table(spark, sf_dir, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.array("c_mktsegment").alias("dirs"), F.concat("n_name", F.lit(" studies")).alias("target"), F.expr("case when c_custkey % 3 = 0 then 'knows IRON well' else ' ' end").alias("background"))
    return R.expand_query(requests, dictionary, spark.createDataFrame([("IRON", "METALS")], "word string, direction string")).select("query_id", "term")


@query("""SELECT p_partkey AS id, array_to_string(list_slice(string_split(p_name, ' '), 1, 4), '|') AS tags, CASE p_partkey % 3 WHEN 0 THEN '匹配方向：软件工程、机器人' WHEN 1 THEN '匹配方向：人工智能' ELSE '综合匹配' END AS reason FROM part""")
def shaped_results(spark, sf_dir):
    terms = F.expr("case p_partkey % 3 when 0 then array('件工程', '软件工程', '工程', '机器人', '机器') when 1 then array('人工智能', '工智能') else array('a') end")
    shaped = R.shape_recommendations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("research_areas"), terms.alias("matched_terms")))
    return shaped.select("id", F.array_join("tags", "|").alias("tags"), "reason")


@query("""WITH q AS (SELECT r_regionkey AS query_id, count(s_suppkey) FILTER (s_acctbal > 9000) AS n_results FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_regionkey),
u AS (SELECT string_agg(n_name, '|' ORDER BY n_name) AS uncrawled FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9700)) SELECT query_id, n_results, uncrawled, CASE WHEN n_results = 0 THEN 'none' ELSE 'partial' END AS hint FROM q CROSS JOIN u""")
def coverage_hints(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    results = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").join(nation, F.expr("s_nationkey = n_nationkey")).select(F.col("n_regionkey").alias("query_id"))
    crawled = table(spark, sf_dir, "customer").where("c_acctbal > 9700").select(F.col("c_nationkey").alias("n_nationkey"))
    uncrawled = nation.join(crawled, "n_nationkey", "left_anti").select(F.col("n_name").alias("name"))
    made = R.coverage_hint(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id")), results, uncrawled)
    return made.select("query_id", "n_results", F.coalesce(F.nullif(F.array_join("uncrawled", "|"), F.lit(""))).alias("uncrawled"), "hint")


@query(f"""WITH {cte("universities", "departments")} SELECT name FROM universities u WHERE contains(name, '1') OR contains(note, 'law') OR EXISTS (SELECT 1 FROM departments d WHERE d.univ_name = u.name AND contains(dept_name, '1'))
UNION ALL SELECT 'FURN:' || name FROM universities u WHERE contains(name, 'FURN') OR EXISTS (SELECT 1 FROM departments d WHERE d.univ_name = u.name AND contains(dept_name, 'FURN'))""".replace(" OR contains(note, 'law')", ""))
def universities_found(spark, sf_dir):
    universities, departments = view(spark, sf_dir, "universities"), view(spark, sf_dir, "departments")
    found = W.search_universities(universities, departments, "FURN").select(F.concat(F.lit("FURN:"), "name").alias("name"))
    return W.search_universities(universities, departments, "1").select("name").union(found)
