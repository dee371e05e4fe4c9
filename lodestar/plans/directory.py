"""Queries of the directory: figures, distributions, searches, links and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import boolean_filter, has
from ..functions.text import cross_domain
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import searches as Q
from ..operators import windows as W
from ..sources import feeds as S
from ..sources.fixtures import DIRECTION_TERMS, cte, direction_terms, table, view
from .registry import query
from .sqltext import keyword


@query(f"""WITH {cte("people", "universities", "crawl_events")}
SELECT (SELECT count(*) FROM people) AS total_people, (SELECT count(DISTINCT university) FROM people) AS total_universities, (SELECT count(DISTINCT department) FROM people) AS total_areas,
(SELECT count(*) FROM universities WHERE NOT contains(coalesce(tier, ''), '211')) AS total985, (SELECT count(DISTINCT university) FROM people JOIN universities u ON u.name = university) AS matched_universities, (SELECT count(*) FROM crawl_events) AS total_logs""")
def directory_overview(spark, sf_dir):
    return A.overview(*[view(spark, sf_dir, v) for v in ("people", "universities", "crawl_events")])


@query(f"WITH {cte('people', 'universities')} SELECT university, count(*) AS n, any_value(u.tier) AS tier FROM people LEFT JOIN universities u ON u.name = university GROUP BY university ORDER BY n DESC, university LIMIT 10")
def distribution_topn(spark, sf_dir):
    return A.distribution(view(spark, sf_dir, "people"), view(spark, sf_dir, "universities"), 10)


@query(f"WITH {cte('people', 'universities')} SELECT tier, count(*) AS n FROM people JOIN universities u ON u.name = university GROUP BY tier")
def tier_counts(spark, sf_dir):
    return A.tier_counts(view(spark, sf_dir, "people"), view(spark, sf_dir, "universities"))


@query(f"WITH {cte('people', 'universities')} SELECT p.id, p.university, u.rank, u.tier FROM people p JOIN universities u ON u.name = p.university")
def people_with_university(spark, sf_dir):
    return J.people_with_university(view(spark, sf_dir, "people"), view(spark, sf_dir, "universities")).select("id", "university", "rank", "tier")


@query(f"WITH {cte('people', 'universities')} SELECT id, university FROM people WHERE university IN (SELECT name FROM universities WHERE tier IN ('ASIA', 'EUROPE'))")
def people_of_tiers(spark, sf_dir):
    return J.restrict_to_tiers(view(spark, sf_dir, "people"), view(spark, sf_dir, "universities"), ["ASIA", "EUROPE"]).select("id", "university")


_DOMAINS = [("media", ["digital media", "communication"]), ("law", ["legal informatics"])]


@query(f"""WITH {cte("universities")}, top AS (SELECT * FROM universities WHERE tier IN ('ASIA', 'EUROPE', 'AMERICA') ORDER BY rank, name LIMIT 50)
SELECT name, rank, tier, CASE WHEN contains(note, 'media') THEN 'digital media|communication' WHEN contains(note, 'law') THEN 'legal informatics' ELSE '' END AS domains FROM top
WHERE name NOT IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000) ORDER BY rank, name LIMIT 8""")
def uncrawled_antijoin(spark, sf_dir):
    crawled = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).select(F.col("n_name").alias("university"))
    found = J.uncrawled_universities(view(spark, sf_dir, "universities"), crawled, ["ASIA", "EUROPE", "AMERICA"], 8)
    return found.select("name", "rank", "tier", F.array_join(cross_domain(F.col("note"), _DOMAINS), "|").alias("domains"))


@query(f"""WITH {cte("universities", "departments")}, d AS (SELECT univ_name, string_agg(dept_name || ':' || com_status, ',' ORDER BY dept_name, com_status) AS nested, bool_or(com_status IN ('strong', 'mix_ds', 'cas_mix')) AS has_strong,
bool_and(com_status NOT IN ('strong', 'mix_ds', 'cas_mix')) AS all_weak FROM departments GROUP BY univ_name) SELECT name, coalesce(nested, '') AS nested, has_strong, all_weak FROM universities LEFT JOIN d ON univ_name = name""")
def nest_departments(spark, sf_dir):
    departments = view(spark, sf_dir, "departments")
    nested = J.nest_departments(view(spark, sf_dir, "universities"), departments)
    flags = A.com_flags(departments).withColumnRenamed("univ_name", "name")
    return nested.join(flags, "name", "left").select("name", F.array_join(F.transform("departments", lambda d: F.concat(d["n"], F.lit(":"), d["c"])), ",").alias("nested"), "has_strong", "all_weak")


@query(f"WITH {cte('people')} SELECT id, name, university, department FROM people WHERE contains(lower(university), 'n_1') AND department ILIKE '%mach%' ORDER BY university, name, id LIMIT 500")
def search_people(spark, sf_dir):
    return Q.search_people(view(spark, sf_dir, "people"), university="n_1", department="mach").select("id", "name", "university", "department")


@query(f"""WITH {cte("docs")} SELECT id FROM docs WHERE (contains(lower(research_areas), 'the') AND NOT contains(lower(university), 'src1')) OR contains(lower(research_areas), 'eaux') OR (contains(lower(name), '77') AND contains(lower(research_areas), 'der'))""")
def boolean_search(spark, sf_dir):
    condition = boolean_filter("area:the -univ:src1|area:eaux|name=77 area:der", {"name": "name", "area": "research_areas", "univ": "university"})
    return view(spark, sf_dir, "docs").where(condition).select("id")


@query(f"""WITH {cte("people")}, k AS (SELECT *, CASE WHEN name ILIKE '%001%' THEN 1 WHEN department ILIKE '%001%' THEN 2 WHEN university ILIKE '%001%' THEN 3 END AS kind FROM people)
SELECT id, kind, (SELECT count(DISTINCT profile_url) FROM k WHERE kind IS NOT NULL) AS total FROM k WHERE kind IS NOT NULL ORDER BY kind, id LIMIT 30""")
def global_search(spark, sf_dir):
    return W.global_search(view(spark, sf_dir, "people"), "001").select("id", "kind", "total")


@query(f"WITH {cte('people')} SELECT university, count(*) AS n FROM people GROUP BY university")
def count_by_university(spark, sf_dir):
    return A.count_by(view(spark, sf_dir, "people"), "university")


@query(f"WITH {cte('people')} SELECT count(*) AS n FROM people WHERE contains(lower(university), 'n_1')")
def count_matching(spark, sf_dir):
    return A.count_matching(view(spark, sf_dir, "people"), has("university", "n_1"))


@query(f"WITH {cte('people')} SELECT DISTINCT department FROM people WHERE department IS NOT NULL")
def distinct_departments(spark, sf_dir):
    return A.distinct_values(view(spark, sf_dir, "people"), "department")


@query(f"WITH {cte('people')}, p AS (SELECT id, university, name FROM people ORDER BY university, name, id LIMIT 500) SELECT id, (SELECT count(*) FROM p) AS total FROM p ORDER BY university, name, id LIMIT 25 OFFSET 50")
def people_page(spark, sf_dir):
    return W.page(view(spark, sf_dir, "people"), ["university", "name", "id"], 50, 25).select("id", "total")


@query(f"""WITH {cte("people", "crawl_events")}, d AS (SELECT university, count(*) AS n, max(ts) AS last FROM crawl_events WHERE type = 'scrape-done' GROUP BY university),
a AS (SELECT DISTINCT university FROM crawl_events WHERE type = 'scrape-start')
SELECT coalesce(d.university, a.university) AS university, coalesce(n, 0) AS n, last, CASE WHEN a.university IS NOT NULL THEN 'RUNNING' ELSE 'DONE' END AS status FROM d FULL JOIN a ON a.university = d.university
ORDER BY CASE WHEN a.university IS NOT NULL AND coalesce(n, 0) = 0 THEN 0 ELSE 1 END, last DESC NULLS LAST, 1 LIMIT 12""")
def crawl_jobs(spark, sf_dir):
    events = view(spark, sf_dir, "crawl_events")
    people = events.where("type = 'scrape-done'").select("university", F.col("ts").alias("scraped_at"))
    return A.crawl_jobs(people, events.where("type = 'scrape-start'"), 12)


@query(f"WITH {cte('url_checks')} SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed FROM url_checks")
def url_check_report(spark, sf_dir):
    return A.url_check_report(view(spark, sf_dir, "url_checks"))


_TERMS = {}
for _d, _t in DIRECTION_TERMS:
    _TERMS.setdefault(_d, []).append(_t)
_HITS = " UNION ALL ".join(f"SELECT id, '{d}' AS direction FROM docs WHERE {' OR '.join(keyword('research_areas', t) for t in ts)}" for d, ts in _TERMS.items())


@query(f"WITH {cte('docs')}, h AS ({_HITS}) SELECT direction, count(*) AS n FROM h GROUP BY direction ORDER BY n DESC, direction LIMIT 10")
def area_heat(spark, sf_dir):
    return A.area_heat(view(spark, sf_dir, "docs"), direction_terms(spark), 10, text_col="research_areas")


@query(f"""WITH {cte("docs", "people_years")}, h AS ({_HITS}), y AS (SELECT DISTINCT id, y FROM people_years WHERE w > 0 AND y BETWEEN 1996 AND 2000),
c AS (SELECT direction, y, count(DISTINCT h.id) AS n FROM h JOIN y ON y.id = h.id GROUP BY direction, y), d AS (SELECT direction, sum(n) AS total FROM c GROUP BY direction HAVING max(n) >= 2),
g AS (SELECT direction, total, unnest(range(1996, 2001)) AS y FROM d)
SELECT direction, CAST(total AS BIGINT) AS total, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY g.y) AS series FROM (SELECT g.direction, g.total, g.y, c.n FROM g LEFT JOIN c ON c.direction = g.direction AND c.y = g.y) g GROUP BY direction, total ORDER BY total DESC, direction LIMIT 10""")
def area_trend(spark, sf_dir):
    made = A.area_trend(view(spark, sf_dir, "docs"), view(spark, sf_dir, "people_years"), direction_terms(spark), 1996, 2000, text_col="research_areas")
    return made.select("direction", "total", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


@query("""WITH c AS (SELECT o_orderpriority AS concept, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT DISTINCT concept, unnest(range(1990, 2006)) AS year FROM c)
SELECT g.concept, g.year, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.concept = g.concept AND c.year = g.year""")
def trend_grid(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("concept"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return J.trend_grid(counts, 1990, 2005)


@query(f"""WITH {cte("universities")}, t(template_id, template) AS (VALUES (1, '{{name}} faculty {{year}}'), (2, 'site {{en}} staff')) SELECT name, template_id, replace(replace(replace(template, '{{name}}', name), '{{en}}', name), '{{year}}', '2025') AS query FROM universities CROSS JOIN t""")
def crawl_query_grid(spark, sf_dir):
    universities = view(spark, sf_dir, "universities").withColumn("en_name", F.lit(None).cast("string"))
    templates = spark.createDataFrame([(1, "{name} faculty {year}"), (2, "site {en} staff")], "template_id int, template string")
    return J.query_grid(universities, templates, 2025).select("name", "template_id", "query")


@query("""WITH d AS (SELECT n_nationkey AS position, n_name AS name, CAST(n_regionkey AS VARCHAR) AS tier FROM nation), p AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' campus' WHEN 2 THEN left(n_name, 3) ELSE 'zzz' END AS org FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT org, name, tier FROM (SELECT DISTINCT org FROM p) JOIN d ON contains(name, org) OR contains(org, name) QUALIFY row_number() OVER (PARTITION BY org ORDER BY name <> org, position) = 1)
SELECT id, p.org, m.name AS linked, coalesce(m.tier, '双非') AS tier FROM p LEFT JOIN m ON m.org = p.org""")
def linked_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    org = F.expr("case s_suppkey % 4 when 0 then n_name when 1 then n_name || ' campus' when 2 then left(n_name, 3) else 'zzz' end")
    people = table(spark, sf_dir, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select(F.col("s_suppkey").alias("id"), org.alias("org"))
    dim = nation.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("tier"))
    return J.link_name(people, dim, "org").select("id", "org", "linked", "tier")


_NOTICES = """notices AS (SELECT event_id AS id, 'http://n/' || event_id AS url, n_name AS university, CASE event_type WHEN 'view' THEN 'admission' WHEN 'click' THEN 'experience' WHEN 'error' THEN 'teacher' ELSE 'camp' END AS category,
props AS title, event_type AS snippet, CAST(user_id AS VARCHAR) AS source, ts AS published_at FROM events JOIN nation ON n_nationkey = user_id % 25)"""


@query(f"""WITH {_NOTICES} SELECT id, category FROM notices WHERE contains(lower(university), 'n_1') AND (title ILIKE '%1%' OR snippet ILIKE '%1%' OR source ILIKE '%1%')
ORDER BY CASE category WHEN 'admission' THEN 0 WHEN 'experience' THEN 1 WHEN 'teacher' THEN 2 ELSE 3 END, published_at DESC, url LIMIT 1000""")
def search_notices(spark, sf_dir):
    category = F.expr("case event_type when 'view' then 'admission' when 'click' then 'experience' when 'error' then 'teacher' else 'camp' end")
    events = table(spark, sf_dir, "events").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = user_id % 25"))
    notices = events.select(F.col("event_id").alias("id"), F.concat(F.lit("http://n/"), F.col("event_id").cast("string")).alias("url"), F.col("n_name").alias("university"), category.alias("category"), F.col("props").alias("title"), F.col("event_type").alias("snippet"), F.col("user_id").cast("string").alias("source"), F.col("ts").alias("published_at"))
    return Q.search_notices(notices, university="n_1", q="1").select("id", "category")


@query(f"""WITH {cte("universities", "departments")} SELECT name, rank FROM universities u WHERE EXISTS (SELECT 1 FROM departments d WHERE d.univ_name = u.name AND com_status IN ('strong', 'mix_ds', 'cas_mix')) AND (name ILIKE '%i%' OR note ILIKE '%i%' OR EXISTS (SELECT 1 FROM departments d WHERE d.univ_name = u.name AND dept_name ILIKE '%i%'))""")
def filter_universities(spark, sf_dir):
    universities = view(spark, sf_dir, "universities").withColumn("province", F.lit(None).cast("string"))
    return Q.filter_universities(universities, view(spark, sf_dir, "departments"), com="hasStrong", q="i").select("name", "rank")


@query(f"""WITH {cte("universities", "departments")} SELECT name, 'with' AS panel FROM universities WHERE name IN (SELECT univ_name FROM departments WHERE dept_name <> 'BUILDING' AND com_status = 'strong') UNION ALL
SELECT name, 'without' FROM universities WHERE name NOT IN (SELECT univ_name FROM departments WHERE dept_name <> 'BUILDING' AND com_status = 'strong')""")
def directory_panels(spark, sf_dir):
    departments = view(spark, sf_dir, "departments").where("dept_name <> 'BUILDING' and com_status = 'strong'")
    having, lacking = Q.directory_panels(view(spark, sf_dir, "universities"), departments)
    return having.select("name", F.lit("with").alias("panel")).union(lacking.select("name", F.lit("without")))


@query(f"""WITH {cte("people")}, labs AS (SELECT s_suppkey AS lab_id, s_name AS lab_name, n_name AS university, s_suppkey * 7 % 1500 AS member FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT member, university, arg_min(lab_name, lab_id) AS lab FROM labs GROUP BY member, university)
SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN department END, lab) AS lab_name FROM people LEFT JOIN f ON f.member = id AND f.university = people.university""")
def backfilled_labs(spark, sf_dir):
    people = view(spark, sf_dir, "people").select("id", F.col("id").cast("string").alias("name"), "university", F.expr("case when id % 3 = 0 then department when id % 3 = 1 then '' end").alias("lab_name"))
    labs = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).select(F.col("s_suppkey").alias("lab_id"), F.col("s_name").alias("lab_name"), F.col("n_name").alias("university"), F.array(F.expr("cast(s_suppkey * 7 % 1500 as string)")).alias("members"))
    return J.backfill_lab(people, labs).select("id", "lab_name")


@query("""WITH y AS (SELECT o_custkey AS id, year(o_orderdate) + 20 AS y, count(*) AS w FROM orders GROUP BY ALL), p AS (SELECT id, sum(w) AS works, sum(w) * 100 AS cited, max(y) FILTER (w > 0 AND y BETWEEN 2015 AND 2030) AS active_year FROM y GROUP BY id)
SELECT c_name AS name, works::INTEGER AS works_count, CASE WHEN cited >= 5000 THEN '教授' WHEN cited >= 800 THEN '副教授' ELSE '讲师/研究员' END AS title, active_year, c_mktsegment || '；' || c_name AS research_areas FROM p JOIN customer ON c_custkey = id WHERE works >= 2""")
def author_dump(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), (F.year("o_orderdate") + 20).alias("year")).agg(F.count("*").alias("works_count"))
    per = years.groupBy("c_custkey").agg(F.sum("works_count").alias("works_count"), (F.sum("works_count") * 100).alias("cited_by_count"), F.collect_list(F.struct("year", "works_count")).alias("counts_by_year"))
    topic = F.array(F.struct(F.col("c_name").alias("display_name"), F.struct(F.col("c_mktsegment").alias("display_name")).alias("subfield")))
    dump = per.join(table(spark, sf_dir, "customer"), "c_custkey").select(F.to_json(F.struct(F.col("c_name").alias("display_name"), "works_count", "cited_by_count", "counts_by_year", topic.alias("topics"))).alias("json"))
    return S.read_author_dump(dump).select("name", "works_count", "title", "active_year", "research_areas")


@query("""SELECT c_name AS name, '教授' AS title, c_mktsegment || '；' || CAST(c_nationkey AS VARCHAR) AS research_areas FROM customer""")
def person_search(spark, sf_dir):
    person = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name_zh"), F.lit("").alias("position"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    dump = table(spark, sf_dir, "customer").select("c_custkey", person.alias("p")).groupBy((F.col("c_custkey") % 40).alias("page")).agg(F.to_json(F.struct(F.collect_list("p").alias("data"))).alias("json"))
    return S.read_person_search(dump, "u").select("name", "title", "research_areas")
