"""Queries of table changes, retention, cascades and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import conversation_title
from ..operators import aggregates as A
from ..operators import mutations as M
from ..operators import windows as W
from ..sources.fixtures import cte, table, view
from .registry import query


def _arrivals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("name"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("university"),
        F.concat(F.lit("http://x/"), (F.col("event_id") % 613).cast("string")).alias("profile_url"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("lab_name"), F.col("event_id").alias("seq"))
    return rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")


@query("""WITH r AS (SELECT 'n' || user_id || '-' || event_id % 7 AS name, 'u' || user_id % 5 AS university, 'http://x/' || event_id % 613 AS profile_url, event_type AS title, CASE WHEN event_id % 4 > 0 THEN event_type END AS lab_name, event_id % 2 AS fresh, event_id AS seq FROM events),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY name, university ORDER BY fresh, seq) = 1)
SELECT profile_url, arg_min(name, fresh * 1000000000 + seq) AS name, arg_min(university, fresh * 1000000000 + seq) AS university, arg_max(title, fresh * 1000000000 + seq) AS title, arg_max(lab_name, fresh * 1000000000 + seq) FILTER (lab_name IS NOT NULL) AS lab_name FROM f GROUP BY profile_url""")
def upsert_people(spark, sf_dir):
    return M.upsert_people(*_arrivals(spark, sf_dir))


@query(f"""WITH {cte("notices")} SELECT url, arg_max(title, (seq % 2) * 1000000000 + seq) AS title, arg_max(category, (seq % 2) * 1000000000 + seq) AS category, arg_max(extra_json, (seq % 2) * 1000000000 + seq) FILTER (extra_json IS NOT NULL) AS extra_json FROM notices GROUP BY url""")
def upsert_notices(spark, sf_dir):
    rows = view(spark, sf_dir, "notices")
    return M.upsert_notices(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select("url", "title", "category", "extra_json")


@query(f"""WITH RECURSIVE {cte("feedback")}, o AS (SELECT id, CASE WHEN positive THEN 0.02 ELSE -0.01 END AS d, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM feedback),
s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, CAST(0.5 AS DOUBLE) AS x FROM o UNION ALL SELECT s.id, o.n, greatest(0.0, least(1.0, s.x + o.d)) FROM s JOIN o ON o.id = s.id AND o.n = s.n + 1)
SELECT id, round(arg_max(x, n), 6) AS score FROM s GROUP BY id""")
def feedback_scores(spark, sf_dir):
    return M.apply_feedback(view(spark, sf_dir, "feedback")).select("id", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT user_id AS name, event_type AS university, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'remove' ELSE 'toggle' END AS action FROM events),
c AS (SELECT name, university, max(seq) FILTER (action = 'remove') AS cut FROM e GROUP BY ALL)
SELECT e.name, e.university, max(seq) AS seq FROM e JOIN c ON c.name = e.name AND c.university = e.university WHERE action = 'toggle' AND (cut IS NULL OR seq > cut) GROUP BY e.name, e.university HAVING count(*) % 2 = 1""")
def favourites(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("university"), F.col("event_id").alias("seq"), F.expr("case when event_id % 50 = 0 then 'remove' else 'toggle' end").alias("action"))
    return M.toggle_set(events)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'patched' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'seg' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0""")
def patched_people(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    patch = rows.where("id % 3 = 0").select("id", F.expr("case when id % 2 = 0 then 'patched' end").alias("name"), F.lit("seg").alias("segment"))
    return M.delete_ids(M.partial_update(rows, patch), rows.where("id % 7 = 0"))


@query(f"WITH {cte('docs')} SELECT min(id) AS id, research_areas FROM docs GROUP BY university, research_areas")
def dedupe_first(spark, sf_dir):
    return W.keep_first(view(spark, sf_dir, "docs"), ["university", "research_areas"], ["id"]).select("id", "research_areas")


@query(f"WITH {cte('docs')} SELECT research_areas, count(*) AS n FROM docs GROUP BY research_areas HAVING count(*) > 1")
def duplicate_report(spark, sf_dir):
    return A.duplicate_report(view(spark, sf_dir, "docs"), ["research_areas"])


@query("SELECT conv_id, count(*) AS message_count, max(turn) AS updated_at, left(trim(regexp_replace(coalesce(arg_min(text, turn), ''), '\\s+', ' ', 'g')), 30) || CASE WHEN length(trim(regexp_replace(coalesce(arg_min(text, turn), ''), '\\s+', ' ', 'g'))) > 30 THEN '…' ELSE '' END AS title FROM conversations GROUP BY conv_id")
def conversation_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    titles = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return A.message_counts(turns).join(titles, "conv_id").select("conv_id", "message_count", "updated_at", conversation_title(F.coalesce("text", F.lit(""))).alias("title"))


@query("SELECT conv_id, string_agg(turn || ':' || role || ':' || length(text), ',' ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id")
def conversation_detail(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    made = A.conversation_detail(turns.select("conv_id").distinct(), turns)
    return made.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], F.length(m["text"]).cast("string"))), ",").alias("messages"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 3")
def context_window(spark, sf_dir):
    return W.context_window(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("WITH c AS (SELECT conv_id, max(turn) AS u FROM conversations GROUP BY conv_id ORDER BY u DESC, conv_id LIMIT 50) SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM c)")
def retain_sessions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return W.retain_newest(A.message_counts(turns), turns, 50)[1].select("conv_id", "turn", "role")


@query("SELECT event_type AS type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS version FROM events QUALIFY version <= 5")
def last_versions(spark, sf_dir):
    return W.last_versions(table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), "event_id"), 5, "type", "event_id")


@query(f"WITH {cte('crawl_events')}, l AS (SELECT event_id, type, ts FROM crawl_events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT event_id, type, row_number() OVER (ORDER BY ts, event_id) AS seq FROM l")
def event_history(spark, sf_dir):
    return W.event_history(view(spark, sf_dir, "crawl_events"), 100).select("event_id", "type", "seq")


_CASCADE = [W.Source("signup"), W.Source("purchase", cap=6), W.Source("click", below=12, counts=("signup",), cap=5), W.Source("view", below=20, cap=4), W.Source("error", below=14)]


@query("""WITH r AS (SELECT user_id % 25 AS university, user_id || '-' || event_id % 9 AS name, event_type AS source, event_id AS seq FROM events),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY university, name, source ORDER BY seq) = 1),
t1 AS (SELECT * FROM o WHERE source = 'signup'),
t2 AS (SELECT * FROM t1 UNION ALL SELECT * FROM (SELECT o.* FROM o WHERE source = 'purchase' AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.university = o.university AND t1.name = o.name) QUALIFY row_number() OVER (PARTITION BY university ORDER BY seq) <= 6)),
t3 AS (SELECT * FROM t2 UNION ALL SELECT * FROM (SELECT o.* FROM o WHERE source = 'click' AND (SELECT count(*) FROM t2 WHERE t2.university = o.university AND t2.source = 'signup') < 12 AND NOT EXISTS (SELECT 1 FROM t2 WHERE t2.university = o.university AND t2.name = o.name) QUALIFY row_number() OVER (PARTITION BY university ORDER BY seq) <= 5)),
t4 AS (SELECT * FROM t3 UNION ALL SELECT * FROM (SELECT o.* FROM o WHERE source = 'view' AND (SELECT count(*) FROM t3 WHERE t3.university = o.university) < 20 AND NOT EXISTS (SELECT 1 FROM t3 WHERE t3.university = o.university AND t3.name = o.name) QUALIFY row_number() OVER (PARTITION BY university ORDER BY seq) <= 4)),
t5 AS (SELECT * FROM t4 UNION ALL SELECT * FROM (SELECT o.* FROM o WHERE source = 'error' AND (SELECT count(*) FROM t4 WHERE t4.university = o.university) < 14 AND NOT EXISTS (SELECT 1 FROM t4 WHERE t4.university = o.university AND t4.name = o.name)))
SELECT university, name, source, seq FROM t5""")
def cascade(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("university"), F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 9).cast("string")).alias("name"), F.col("event_type").alias("source"), F.col("event_id").alias("seq"))
    return W.coverage_cascade(rows, _CASCADE)


@query("SELECT o_custkey AS id, round(count(*) / (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)), 6) AS share FROM orders GROUP BY o_custkey")
def max_normalized(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return W.max_normalize(counts, "n", "share").select("id", F.round("share", 6).alias("share"))


@query("""WITH n AS (SELECT 'u' || user_id % 5 AS university, event_type AS category, event_id AS seq, 't' || event_id AS title FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY university, category ORDER BY seq) AS k FROM n)
SELECT university, category, count(*) AS total, string_agg(title, ',' ORDER BY k) FILTER (k <= 8) AS items FROM r GROUP BY university, category""")
def notice_digest(spark, sf_dir):
    notices = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("university"), F.col("event_type").alias("category"), F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"))
    return A.notice_digest(notices).select("university", "category", "total", F.array_join("items", ",").alias("items"))
