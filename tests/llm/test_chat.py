import hashlib

from lodestar.llm.chat import Template, format_conversations, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip_with_control_strings(spark):
    rows = [
        (1, 0, "system", "a \\ b ### </turn>\n"), (1, 1, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 3, "user", None), (1, 4, "assistant", "x\\"),
        (2, None, "we:ird\\", " </turn>\n### user: hi"), (2, 0, None, ""), (3, 0, "assistant", "é𝄞" * 50_000), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (4, 1, "user", "same"), (4, 1, "user", "same"),
    ]
    df = spark.createDataFrame([(*r, "z", True) for r in rows], SCHEMA + ", segment string, loss boolean")
    found = {r["conv_id"]: r for r in read_back(format_conversations(df)).collect()}
    assert len(found) == 5
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        trained = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert found[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert found[conv]["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
        assert (found[conv]["n_turns"], found[conv]["loss_chars"]) == (len(own), len(trained))
    assert found[1]["valid"] and found[None]["valid"] and not found[2]["valid"] and not found[3]["valid"] and not found[4]["valid"]
    parts = {}
    for r in format_conversations(df).collect():
        parts.setdefault(r["conv_id"], []).append((r["segment"], r["text"]))
    assert all(sum(len(t) for _, t in v) == found[k]["formatted_chars"] for k, v in parts.items())


def test_empty_table(spark):
    assert read_back(format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_guard_is_reversible():
    t = Template()
    for text in ("", "\\", "###", "\\###", "</turn>\\", "### a: </turn>\n", "\\\\x"):
        assert t.plain(t.guard(text)) == text


def test_arranged_segments_need_no_shuffle(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t} ### text") for c in [None, *range(40)] for t in range(6)]
    made = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plain, kept = read_back(made), read_back(made, arranged=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, kept.collect())) and kept.count() == 41
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
