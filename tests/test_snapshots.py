"""Tables with snapshots under replays, crashes at every step and writers at the same time; index segments."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators.retrieval import build_index
from lodestar.sources.snapshots import Conflict, Manifest, Snapshots
from lodestar.streaming import feeds as L
from lodestar.streaming.segments import _segment, current_index, maintain_index

NOTICES = "url string, title string, extra_json string, seq long"


class Crash(Exception):
    pass


def batches(spark):
    rows = [[("a", "t1", "x", 1), ("b", "t2", None, 2)], [("a", "t3", None, 3), ("c", "t4", "y", 4)], [("b", "t5", "z", 5), (" ", "no", None, 6)]]
    return [spark.createDataFrame(r, NOTICES) for r in rows]


def notices(spark, path):
    return sorted((r["url"], r["title"], r["extra_json"]) for r in L.current_table(spark, path, "notices").collect())


WANT = [("a", "t3", "x"), ("b", "t5", "z"), ("c", "t4", "y")]


@pytest.mark.parametrize("replayed", [0, 1, 2])
def test_any_batch_may_be_replayed_around_compaction(spark, tmp_path, replayed):
    path, all_of = str(tmp_path), batches(spark)
    step = L.upsert_stream(path, "notices")
    for n, b in enumerate(all_of):
        step(b, n)
    step(all_of[replayed], replayed)
    assert notices(spark, path) == WANT
    assert L.compact(spark, path, "notices")
    step(all_of[replayed], replayed)
    assert notices(spark, path) == WANT and len(Snapshots(spark, path).manifest().parts) == 1
    assert L.compact(spark, path, "notices") and notices(spark, path) == WANT
    step(spark.createDataFrame([("c", "t6", None, 0)], NOTICES), 3)
    assert notices(spark, path) == [*WANT[:2], ("c", "t6", "y")]


@pytest.mark.parametrize("at", ["write_part", "publish"])
@pytest.mark.parametrize("after", [False, True])
def test_crashes_at_each_step_lose_nothing(spark, tmp_path, monkeypatch, at, after):
    path, all_of = str(tmp_path), batches(spark)
    step, real = L.upsert_stream(path, "notices"), getattr(Snapshots, at)

    def crash(self, x):
        if after:
            real(self, x)
        raise Crash

    def crashing(f):
        with monkeypatch.context() as m, pytest.raises(Crash):
            m.setattr(Snapshots, at, crash)
            f()

    for n, b in enumerate(all_of):
        crashing(lambda b=b, n=n: step(b, n))
        step(b, n)  # the stream starts again with the same batch
        crashing(lambda: L.compact(spark, path, "notices"))
        step(b, n)
    assert notices(spark, path) == WANT
    L.compact(spark, path, "notices")
    table = Snapshots(spark, path)
    assert table.expire(keep=1, unnamed_after=-1) > 0 and table.expire(keep=1, unnamed_after=-1) == 0
    assert notices(spark, path) == WANT
    step(all_of[2], 2)
    assert notices(spark, path) == WANT


def test_a_batch_that_comes_during_compaction_stays(spark, tmp_path, monkeypatch):
    path, all_of = str(tmp_path), batches(spark)
    step, real = L.upsert_stream(path, "notices"), Snapshots.write_part
    step(all_of[0], 0)
    step(all_of[1], 1)

    def meanwhile(self, rows):
        name = real(self, rows)
        with monkeypatch.context() as m:
            m.setattr(Snapshots, "write_part", real)
            step(all_of[1], 1)
            step(all_of[2], 2)
        return name

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "write_part", meanwhile)
        assert L.compact(spark, path, "notices")
    assert notices(spark, path) == WANT and [p.level for p in Snapshots(spark, path).manifest().parts] == [1, 0]


def test_a_version_is_published_once(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path))
    table.publish(Manifest(1, (), {"w": 4}))
    with pytest.raises(Conflict):
        table.publish(Manifest(1, (), {"w": 5}))
    assert table.manifest() == Manifest(1, (), {"w": 4}) and Manifest.read(table.manifest().text()) == table.manifest()
    with pytest.raises(FileNotFoundError):
        table.read()


def test_expired_versions_can_be_read_as_long_as_they_are_kept(spark, tmp_path):
    table, rows = Snapshots(spark, str(tmp_path)), spark.range(3)
    for n in range(3):
        assert table.append(rows, n) and not table.append(rows, n)
    before = table.manifest()
    table.rewrite(lambda df: df.drop("batch").distinct())
    assert table.read(before.parts).count() == 9 and table.read().count() == 3
    assert table.expire(keep=2) == 0 and table.read(before.parts).count() == 9
    assert table.expire(keep=1) == 3 and table.read().count() == 3


def test_conversations_that_were_retained_stay_so_after_a_replay(spark, tmp_path):
    path, schema = str(tmp_path), "conv_id long, turn long, role string, text string"
    first = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y"), (2, 0, "user", "z")], schema)
    second = spark.createDataFrame([(3, 5, "user", "w")], schema)
    step = L.conversation_log(path)
    step(first, 0)
    step(second, 1)
    L.retain(spark, path, 2)
    step(first, 0)
    step(second, 1)
    kept, turns = L.conversation_state(spark, path, 5)
    assert sorted(map(tuple, kept.collect())) == [(1, 2, 1), (3, 1, 5)] and turns.count() == 3


def same(index, docs):
    want = build_index(docs, ["text"])
    for name in ("postings", "vocab"):
        assert sorted(map(tuple, index[name].collect())) == sorted(map(tuple, want[name].collect())), name
    assert sorted(map(tuple, index["doc_len"].collect())) == sorted(map(tuple, want["doc_len"].collect()))


def test_segments_equal_a_new_index_and_stay_few(spark, tmp_path):
    rng, path, state, seq = random.Random(3), str(tmp_path), {}, 0
    steps = {w: maintain_index(path, ["text"], w, fanout=3) for w in ("one", "two")}
    most = 0
    for n in range(14):
        rows = []
        for _ in range(rng.randint(0, 6)):
            i, text = rng.randrange(12), " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 5)))
            op = rng.choice(["insert", "update", "update", "delete"])
            rows.append((i, op, None if op == "delete" else text, seq))
            state[i] = None if op == "delete" else text
            seq += 1
        batch = spark.createDataFrame(rows, "id long, op string, text string, seq long")
        writer = ("one", "two")[n % 2]
        steps[writer](batch, n // 2)
        steps[writer](batch, n // 2)  # replayed
        most = max(most, len(Snapshots(spark, path).manifest().parts))
    assert most <= 6 and max(p.level for p in Snapshots(spark, path).manifest().parts) == 2
    same(current_index(spark, path), spark.createDataFrame([(i, t) for i, t in state.items() if t is not None], "id long, text string"))
    docs = Snapshots(spark, path, ("docs", "postings", "vocab"))
    oldest = docs.read(docs.manifest().parts[:1], "docs")
    assert oldest.where("deleted").count() == 0 and oldest.count() == oldest.select(F.countDistinct("doc_id")).first()[0]


def test_postings_of_a_segment_are_counted_in_their_text(spark):
    rows = [(1, "insert", "a b a", 1), (2, "insert", None, 2), (1, "update", "b c b B", 3), (3, "delete", "x", 4)]
    made = _segment(spark.createDataFrame(rows, "id long, op string, text string, seq long"), ["text"])
    assert "Exchange hashpartitioning" not in made["postings"]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made["postings"].collect())) == [(1, "b", 3), (1, "c", 1)]
    assert sorted(map(tuple, made["vocab"].collect())) == [("b", 1), ("c", 1)]
    assert sorted(map(tuple, made["docs"].select("doc_id", "deleted").collect())) == [(1, False), (2, False), (3, True)]


def test_number_of_segments_after_many_batches(spark, tmp_path, monkeypatch):
    from lodestar.streaming import segments

    table = Snapshots(spark, str(tmp_path), segments.TABLES)
    monkeypatch.setattr(Snapshots, "write_part", lambda self, rows: f"part-{random.random()}")
    monkeypatch.setattr(segments, "_segment", lambda batch, columns: {})
    monkeypatch.setattr(segments, "_merge", lambda table, parts, oldest: table.merge(parts, {}))
    step, nothing, most = maintain_index(str(tmp_path), ["text"]), spark.range(0), 0
    for n in range(600):
        step(nothing, n)
        if n % 50 == 0:
            table.expire(keep=1)
    assert len(table.manifest().parts) <= 8 * 4 and table.manifest().marks == {"stream": 599}
