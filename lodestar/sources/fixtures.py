"""Stand-in views: the engine's tables derived from the generic test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "universities": """SELECT n_name AS name, n_nationkey + 1 AS rank, r_name AS tier,
        CASE WHEN n_nationkey % 5 = 0 THEN 'media school' WHEN n_nationkey % 7 = 0 THEN 'law school' ELSE '' END AS note
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "people": """SELECT c_custkey AS id, c_name AS name, n_name AS university, c_mktsegment AS department,
        concat('http://p.example.org/', CAST(c_custkey AS VARCHAR(20))) AS profile_url, c_acctbal >= 5000 AS recruiting
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "departments": """SELECT DISTINCT n_name AS univ_name, c_mktsegment AS dept_name,
        CASE (n_nationkey + length(c_mktsegment)) % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 2 THEN 'mix_ds' ELSE 'unknown' END AS com_status
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "people_years": """SELECT o_custkey AS id, year(o_orderdate) AS y, count(*) AS w, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) AS c
        FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "people_terms": """SELECT DISTINCT o_custkey AS id, p_name AS area
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "docs": """SELECT d.doc_id AS id, concat('doc ', CAST(d.doc_id AS VARCHAR(20))) AS name, d.source AS university, d.lang AS tier,
        d.text AS research_areas, coalesce(l.quality, 0) = 1 AS recruiting FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "session_events": """SELECT user_id AS session_id, event_id, ts, event_id % (SELECT count(*) FROM {documents}) AS doc_id
        FROM {events} WHERE event_type IN ('click', 'view')""",
    "crawl_events": """SELECT event_id, ts, n_name AS university, value, concat('why ', props) AS message,
        CASE event_type WHEN 'view' THEN 'scrape-start' WHEN 'click' THEN 'scrape-progress' WHEN 'purchase' THEN 'scrape-done'
        WHEN 'error' THEN 'scrape-error' ELSE 'heartbeat' END AS type FROM {events} JOIN {nation} ON n_nationkey = user_id % 25""",
    "url_checks": """SELECT event_id AS id, user_id % 25 AS univ_id, event_type <> 'error' AS ok,
        CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status_code, ts AS verified_at FROM {events}""",
    "selections": """SELECT o_orderkey % 500 AS advisor_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' THEN 'mid' ELSE 'low' END AS gpa_bucket FROM {orders}""",
    "feedback": "SELECT user_id AS id, event_id AS seq, event_type <> 'error' AS positive FROM {events}",
    "han_names": """SELECT id, han, university, CASE id % 10 WHEN 0 THEN concat(han, '教授') WHEN 1 THEN concat(han, '大学') WHEN 2 THEN concat('Prof. ', han) WHEN 3 THEN concat(han, '（博导）') WHEN 4 THEN 'Wei Wang' WHEN 5 THEN 'wei wang'
        WHEN 6 THEN '  ' WHEN 7 THEN concat('返回', han) WHEN 8 THEN NULL ELSE han END AS name FROM (SELECT c_custkey AS id, n_name AS university, translate(CAST(c_custkey AS VARCHAR(20)), '0123456789', '张王李赵刘陈杨黄周吴') AS han FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) x""",
    "notes": """SELECT o_orderkey AS id, concat(CASE o_orderkey % 9 WHEN 0 THEN concat('研究方向：', lower(o_orderpriority), ' systems and data。正教授，博导') WHEN 1 THEN concat('Research Interests: large scale ', o_orderpriority, ' learning; Associate Professor')
        WHEN 2 THEN concat('计划招收', CAST(o_orderkey % 90 AS VARCHAR(20)), ' 名，GPA ≥ 3.', CAST(o_orderkey % 10 AS VARCHAR(20)), '，排名前', CAST(o_orderkey % 50 AS VARCHAR(20)), '%') WHEN 3 THEN concat('截止 2025年', CAST(o_orderkey % 14 AS VARCHAR(20)), '月', CAST(o_orderkey % 34 AS VARCHAR(20)), '日 或 2026/1/2')
        WHEN 4 THEN concat('个人简介 ', o_orderstatus, ' 长期从事机器学习与数据挖掘方面的研究工作。特聘研究员，诚招学生') WHEN 5 THEN concat(CAST(o_orderkey % 7 AS VARCHAR(20)), '个招生名额，欢迎联系。成绩排在前', CAST(o_orderkey % 30 AS VARCHAR(20)), '％') WHEN 6 THEN 'We are looking for students. Our faculty: Lecturer'
        WHEN 7 THEN '接收２５名，研究领域:short' ELSE '' END, ' ', o_orderpriority) AS text FROM {orders}""",
    "notices": """SELECT concat('http://n.example.org/', CAST(event_id % 997 AS VARCHAR(20))) AS url, event_id AS seq, event_type AS category, user_id % 25 AS univ_id,
        props AS title, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS extra_json FROM {events}""",
}

#: Latin direction words for the queries; D2b is an alias that counts again.
DIRECTION_TERMS = [("D1", "the"), ("D1", "ing"), ("D2", "of"), ("D2", "ouen"), ("D2b", "of"), ("D2b", "ouen"), ("D3", "sch"), ("D3", "auch"), ("D4", "eaux"), ("D4", "for")]
QUERIES = [(1, "the of and thering"), (2, "leaux elle que"), (3, "nicht aulich sch")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` without tier and recruiting: read from documents alone if no document has two labels, so that no text is shuffled to meet its label."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is not null and n > 1")
    columns = ["id", "name", "university", "research_areas"]
    if not labels.isEmpty():
        return view(spark, sf_dir, "docs").select(*columns)
    documents = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "concat('doc ', CAST(doc_id AS VARCHAR(20))) AS name", "source AS university", "text AS research_areas")
    return spread(documents.select(*columns), "id")


def cte(*names: str) -> str:
    """The views as common table expressions for SQL."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)


def values(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""
    one = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def direction_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIRECTION_TERMS, "direction string, term string")


def match_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, text string")
