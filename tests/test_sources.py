"""Sources on small payloads, and streams against their batch results."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.operators.retrieval import build_index
from lodestar.operators.windows import decayed_terms, last_n
from lodestar.sources import feeds as S
from lodestar.sources.snapshots import Snapshots
from lodestar.streaming import feeds as L
from lodestar.streaming.segments import current_index, maintain_index


def js(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o, ensure_ascii=False),) for o in objects], "json string")


def test_author_dump(spark):
    topic = lambda n: {"display_name": f"t{n}", "subfield": {"display_name": f"s{n // 2}"}, "field": {"display_name": "Computer Science"}}
    a = {"display_name": "Li", "works_count": 9, "cited_by_count": 900, "orcid": "o", "topics": [topic(n) for n in range(6)], "counts_by_year": [{"year": 2014, "works_count": 5, "cited_by_count": 1}, {"year": 2020, "works_count": 2, "cited_by_count": 3}, {"year": 2022, "works_count": 0, "cited_by_count": 9}]}
    r = S.read_author_dump(js(spark, a, {"display_name": "few", "works_count": 1}, "not json", {"display_name": "bare", "works_count": 2})).orderBy("name").collect()
    assert [x["name"] for x in r] == ["Li", "bare"] and r[0]["title"] == "副教授" and r[0]["research_areas"] == "s0；s1；s2；t0；t1" and r[0]["active_year"] == 2020 and [tuple(c) for c in r[0]["counts_by_year"]] == [(2020, 2, 3), (2022, 0, 9)]
    assert r[1]["fields"] == [] and r[1]["active_year"] is None


def test_search_payloads(spark):
    people = js(spark, {"data": [{"id": "1", "name": "San Zhang", "name_zh": "张三", "org": "o", "position": "", "tags": ["a", "b"], "email": "e"}, {"id": "2", "name": "", "name_zh": None}]})
    assert [(r["name"], r["title"], r["research_areas"]) for r in S.read_person_search(people, "u").collect()] == [("张三", "教授", "a；b")]
    hit = lambda n, notes: {"@pid": "p", "info": {"author": n, "url": "w", "notes": {"note": notes}}}
    dblp = js(spark, {"result": {"hits": {"hit": [hit("Li Si 0001", [{"@type": "affiliation", "text": "X University, Dept"}]), hit("Other", [{"@type": "award", "text": "X University"}])]}}})
    assert [(r["name"], r["department"]) for r in S.read_dblp_authors(dblp, "x university").collect()] == [("Li Si", "X University, Dept")]
    s2 = js(spark, {"data": [{"authorId": "a", "name": "N", "affiliations": ["X Univ"], "hIndex": 20, "citationCount": 5}, {"authorId": "a", "name": "N", "affiliations": ["X Univ"], "hIndex": 20, "citationCount": 5}, {"authorId": "b", "name": "M", "affiliations": None}]})
    assert [(r["author_id"], r["title"]) for r in S.read_s2_authors(s2, "x univ").collect()] == [("a", "教授")]
    rest = js(spark, '{"list":[{"jsxm":"张三","link":"/a","zc":"教授"},{"name":"abc","url":"/bbbbbbbbbbbb"}]}')
    assert [tuple(r) for r in S.read_person_list_json(rest).collect()] == [("张三", "/a", "教授")]


def test_list_payloads_with_long_names(spark):
    long = js(spark, '{"list":[{"xm":"王李张张张张","link":"/p/100000"},{"xm":"张","link":"/p/0000000000"}]}')
    assert [tuple(r) for r in S.read_person_list_json(long, longest=None).collect()] == [("王李张张张张", "/p/100000", None)]
    assert S.read_person_list_json(long).count() == 0


def test_question_bank(spark):
    files = [("a.csv", "category,question,hint\nalgo,what is x,say y\n# note,z\nos,why,\n"), ("b.txt", "# nets\nwhat is tcp\n[db] what is sql\nand then\n\n"), ("c.json", '[{"category":"","question":"q?","hint":"h"},{"question":" "}]')]
    got = {(r["file"], r["category"], r["question"], r["hint"]) for r in S.read_question_bank(spark.createDataFrame(files, "file string, content string")).collect()}
    assert got == {("a.csv", "algo", "what is x", "say y"), ("a.csv", "os", "why", None), ("b.txt", "nets", "what is tcp", None), ("b.txt", "db", "what is sql", None), ("b.txt", "db", "and then", None), ("c.json", "综合", "q?", "h")}


def test_dimension_paths_and_cache(spark, tmp_path):
    old, seed = spark.createDataFrame([("a", 1)], "name string, v int"), spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "name string, v int")
    once = S.load_dimension(old, seed, ["name"])
    assert sorted(map(tuple, S.load_dimension(once, seed, ["name"]).collect())) == [("a", 1), ("b", 2)]
    texts = lambda t: spark.createDataFrame([(t,)], "text string")
    assert {r["path"] for r in S.mine_paths(texts("Allow: /faculty/list\nDisallow: /admin"), "robots").collect()} == {"/faculty/list"}
    assert {r["path"] for r in S.mine_paths(texts("<loc> http://x/szdw/a </loc><loc>http://x/n</loc>"), "sitemap").collect()} == {"http://x/szdw/a"}
    assert {r["path"] for r in S.mine_paths(texts("fetch('/api/teacher'); $.get(\"/news\")"), "js").collect()} == {"/api/teacher"}
    path = str(tmp_path / "cache")
    assert S.materialize(spark, seed, path).count() == 3 and S.materialize(spark, old, path).count() == 3
    S.invalidate(spark, path)
    assert S.materialize(spark, old, path).count() == 1
    log = spark.createDataFrame([("u", 200, "m", "t")], "url string, status int, message string, created_at string")
    for _ in range(2):
        S.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


@pytest.fixture
def stored(spark, tmp_path, sf):
    """Events as files, one after another."""
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    for day in ("2024-01-01", "2024-01-11", "2024-01-21"):
        events.where((F.col("ts") >= F.to_timestamp(F.lit(day))) & (F.col("ts") < F.to_timestamp(F.lit(day)) + F.expr("interval 10 days"))).coalesce(1).write.mode("append").parquet(path)
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path), str(tmp_path)


def run(writer, folder):
    q = writer.trigger(availableNow=True).option("checkpointLocation", f"{folder}/{uuid.uuid4().hex}").start()
    assert q.awaitTermination(120), "the stream doesn't end"
    return q


def test_session_interest_stream_equals_batch(spark, stored):
    events, stream, folder = stored
    areas = F.concat(F.col("event_type"), F.lit(" ,"), (F.col("event_id") % 7).cast("string"), F.lit("x"))
    named = lambda df: df.select(F.col("user_id").alias("session_id"), "ts", "event_id", areas.alias("areas"))
    run(L.session_interest(named(stream), keep_ms=40 * 86_400_000).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")), folder)
    rows = spark.read.parquet(f"{folder}/out").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["batch"]):
        last[r["session_id"]] = json.loads(r["terms"])
    want = {}
    for r in decayed_terms(last_n(named(events), 20)).collect():
        want.setdefault(r["session_id"], {})[r["term"]] = r["weight"]
    assert set(last) == set(want)
    assert all(abs(last[s][t] - w) < 1e-9 for s, terms in want.items() for t, w in terms.items()) and all(set(last[s]) == set(want[s]) for s in want)


def test_index_follows_changes(spark, tmp_path):
    schema = "id long, op string, text string, seq long"
    step, path = maintain_index(f"{tmp_path}/ix", ["text"]), f"{tmp_path}/ix"
    first = spark.createDataFrame([(1, "insert", "a b b", 1), (2, "insert", "c", 2), (3, "insert", "d", 3)], schema)
    second = spark.createDataFrame([(1, "update", "a z", 4), (2, "delete", None, 5), (4, "insert", "x", 6), (4, "update", "y y", 7)], schema)
    for n, batch in enumerate([first, second]):
        step(batch, n)
    step(second, 1)  # a replay
    got = sorted(map(tuple, current_index(spark, path)["postings"].collect()))
    want = build_index(spark.createDataFrame([(1, "a z"), (3, "d"), (4, "y y")], "id long, text string"), ["text"])["postings"]
    assert got == sorted(map(tuple, want.collect()))


def test_jobs_and_tables(spark, stored, tmp_path):
    events, stream, folder = stored
    kinds = F.expr("case when event_type = 'view' then 'scrape-start' when event_type = 'purchase' then 'scrape-done' else 'x' end")
    jobs = lambda df: df.select((F.col("user_id") % 5).cast("string").alias("job"), "ts", "event_id", kinds.alias("type"))
    run(L.dedupe_jobs(jobs(stream), keep_ms=40 * 86_400_000).writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/jobs/batch={i}")), folder)
    got = spark.read.parquet(f"{folder}/jobs")
    active, want = {}, set()
    for r in jobs(events).orderBy("ts", "event_id").collect():
        if r["type"] == "scrape-done":
            active[r["job"]] = False
        elif r["type"] == "scrape-start" and not active.get(r["job"]):
            active[r["job"]] = True
            want.add(r["event_id"])
    assert {r["event_id"] for r in got.collect()} == want
    rows = spark.createDataFrame([("a", "u", "x", "t", 1), ("a", "u", "y", "t2", 2), ("b", "u", "x", "t3", 3)], "name string, university string, profile_url string, title string, seq long")
    step = L.upsert_stream(f"{folder}/people")
    step(rows.where("seq < 3"), 0)
    step(rows.where("seq = 3"), 1)
    step(rows.where("seq = 3"), 1)
    assert [(r["profile_url"], r["name"], r["title"]) for r in L.current_table(spark, f"{folder}/people").collect()] == [("x", "a", "t3")]
    L.compact(spark, f"{folder}/people")
    L.compact(spark, f"{folder}/people")
    step(rows.where("seq = 2").withColumn("seq", F.lit(9).cast("long")), 2)
    assert [(r["profile_url"], r["name"], r["title"]) for r in L.current_table(spark, f"{folder}/people").orderBy("profile_url").collect()] == [("x", "a", "t3")]
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    L.conversation_log(f"{folder}/turns")(turns, 0)
    L.conversation_log(f"{folder}/turns")(turns.where("conv_id = 3"), 1)
    L.retain(spark, f"{folder}/turns", 1)
    assert {r["conv_id"] for r in Snapshots(spark, f"{folder}/turns").read().collect()} == {1}
    kept, own = L.conversation_state(spark, f"{folder}/turns", 1)
    assert [tuple(r) for r in kept.collect()] == [(1, 2, 1)] and own.count() == 2


def test_feed_is_stored_by_many_tasks_and_replayed_in_order(spark, tmp_path):
    rows = [(n * 7919 % 4000, n) for n in range(4000)]
    events = spark.createDataFrame(rows, "ts long, event_id long").repartition(4)
    step, path = L.event_feed(str(tmp_path)), str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        step(events, 0)
        step(events.where("event_id < 5"), 1)
        step(events.where("event_id < 5"), 1)  # replayed
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.parquet(path)
    assert stored.count() == 4005 and stored.where("batch = 0").select(F.input_file_name()).distinct().count() > 1
    want = [i for _, i in (sorted(rows) + sorted(r for r in rows if r[1] < 5))[-50:]]
    assert [r["event_id"] for r in L.replay(spark, path, 50).orderBy("seq").collect()] == want


def test_state_is_kept_by_time_and_late_events_are_dropped(spark, tmp_path):
    """Each run reads one more file; the watermark is an hour behind the newest event of the runs before."""
    hour = 3600
    schema = "session_id long, ts timestamp, event_id long, areas string"
    runs = [
        [(1, 0, 1, "a1, b1"), (1, 60, 2, "b1"), (2, 0, 3, "c1")],
        [(2, 10 * hour, 4, "d1")],  # the watermark passes 9 hours, and session 1 is 2 hours old
        [(1, 60, 5, "late"), (1, 12 * hour, 6, "e1"), (2, 11 * hour, 7, "d1")],
    ]
    def made(rows):
        return spark.createDataFrame(rows, "session_id long, at long, event_id long, areas string").selectExpr("session_id", "timestamp_seconds(1000000 + at) as ts", "event_id", "areas")

    out, states = [], []
    for n, rows in enumerate(runs):
        made(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = L.session_interest(stream, n=2, decay=0.5, keep_ms=2 * hour * 1000)
        started = query.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state")
        started = started.foreachBatch(lambda b, i: out.extend((n, r["session_id"], json.loads(r["terms"]), r["n_events"]) for r in b.collect())).start()
        started.awaitTermination()
        states.append(started.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sorted(out, key=str) == sorted([(0, 1, {"a1": 0.5, "b1": 1.5}, 2), (0, 2, {"c1": 1.0}, 1), (1, 2, {"c1": 0.5, "d1": 1.0}, 2), (2, 1, {"e1": 1.0}, 1), (2, 2, {"d1": 1.5}, 2)], key=str)
    assert len(states) == 3 and states[0] > 0
