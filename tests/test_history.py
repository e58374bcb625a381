"""Questions about histories, on small tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarry.operators import history


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SUMMARY = "session_id string, project string, model string, request string, investigated string, learned string, completed string, next_steps string, generated_at string"


def test_summaries_and_handoff(spark):
    s = spark.createDataFrame([("s1", "p", "synth-x", "mirror backup", None, None, None, None, "1"), ("s2", "p", "m", "other", None, "Backup", None, None, "2"), ("s3", "q-bench", "synth-y", "zzz", None, None, None, None, "3")], SUMMARY)
    assert [r.session_id for r in history.summary_search(s, "the backup").collect()] == ["s2", "s1"]
    assert history.summary_search(s, "the of").count() == 3
    assert {r.session_id for r in history.real_summaries(s).collect()} == {"s2", "s3"}
    o = spark.createDataFrame([("s1", "p", "decision", f"t{i}", str(i)) for i in range(7)], "session_id string, project string, kind string, title string, ts string")
    got = rows(history.handoff(s, o, "p", current="s2"))
    assert ("summary", "mirror backup", "1") in got and len(got) == 6


def test_newest_turns_and_digest(spark):
    t = spark.createDataFrame([("s", 0, "user", "Please do it\nnow"), ("s", 1, "assistant", "ok\n- Found the cause"), ("s", 2, "user", "x" * 50)], "session_id string, idx int, role string, content string")
    assert [r.idx for r in history.newest_that_fit(t, 75).orderBy("idx").collect()] == [1, 2]
    assert rows(history.rule_digest(t)) == [("s", "Please do it", "Found the cause")]


def test_restore_and_repair(spark):
    size = "session_id string, bytes long"
    live, backup = spark.createDataFrame([("a", 100), ("b", 90)], size), spark.createDataFrame([("a", 100), ("b", 100), ("c", 5)], size)
    assert rows(history.restorable(live, backup)) == [("b", "truncated"), ("c", "deleted")]
    entry = "session_id string, idx int, uuid string, content string"
    stored = spark.createDataFrame([("s", 0, "u0", "a"), ("s", 1, "u1", "b"), ("s", 2, "u2", "c")], entry)
    now = spark.createDataFrame([("s", 0, "u0", "a"), ("s", 2, "u2", ""), ("s", 3, "u3", "new")], entry)
    assert rows(history.repair(now, stored)) == [("s", 0, "u0", "a", "live"), ("s", 1, "u1", "b", "stored"), ("s", 2, "u2", "c", "stored"), ("s", 3, "u3", "new", "live")]


def test_files_and_logs(spark, tmp_path):
    stub = json.dumps({"type": "ai-title", "sessionId": "x", "aiTitle": "t"})
    f = spark.createDataFrame([("/p/x.jsonl", len(stub), stub + "\n"), ("/p/y.jsonl", len(stub), stub), ("/p/z.jsonl", 900, stub)], "path string, length long, text string")
    assert rows(history.stub_transcripts(f)) == [("/p/x.jsonl",)]
    for k in range(2):
        (tmp_path / f"log.{k}").write_text("\n".join(json.dumps({"ts": f"2024-01-0{k + 1}T0{i}:00:00", "level": "E" if i else "W", "component": f"net.{i}", "message": f"m{k}{i}"}) for i in range(3)))
    got = [r.message for r in history.recent_errors(spark, str(tmp_path), 2, "net", "E", "2024-01-01").collect()]
    assert got == ["m12", "m11"]


def test_counters(spark):
    memory = spark.createDataFrame([("p", "X", "env", 2, "open", None)], "project string, name string, domain string, n long, status string, notes string")
    seen = spark.createDataFrame([("p", "X", "env"), ("p", "X", "env"), ("p", "Y", "env")], "project string, name string, domain string")
    counted = history.count_names(memory, seen)
    assert rows(counted) == [("p", "X", "env", 4, "open", None), ("p", "Y", "env", 1, "open", None)]
    decided = spark.createDataFrame([("p", "X", "env", "rejected", "no such name")], "project string, name string, domain string, status string, notes string")
    assert ("p", "X", "env", 4, "rejected", "no such name") in rows(history.triage(counted, decided))


def test_searches(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 5.0)], "id int, score double")
    b = spark.createDataFrame([(1, 0.2), (3, 0.9)], "id int, score double")
    assert history.mixed_search({"doc": a}).first()["score"] == 9.0
    assert {(r.kind, r.id) for r in history.mixed_search({"doc": a, "symbol": b}).collect()} == {("doc", "1"), ("doc", "2"), ("symbol", "1"), ("symbol", "3")}
    assert rows(history.weighted_hybrid(a, b)) == [(1, 0.5), (2, 0.0), (3, 0.5)]
    corpus = spark.createDataFrame([(1, "x"), (7, "host 10.0.0.9 up"), (8, "10.0.0.9")], "id int, text string")
    assert [(r.id, r.source) for r in history.global_search(spark, corpus, a, "what about 10.0.0.9").collect()] == [(1, "search"), (2, "search"), (8, "literal"), (7, "literal")]
    assert history.global_search(spark, corpus, a, "plain words").count() == 2
    hits = a.withColumn("size", F.lit(10))
    assert [r.id for r in history.recall_in_time(hits, 6.0, 5, F.col("size")).collect()] == [1] and history.recall_in_time(hits, 10.0, 5, F.col("size")).count() == 0
    r = spark.createDataFrame([(1, "a b c"), (2, "a")], "query_id int, response string")
    m = spark.createDataFrame([(1, ["a", "c"]), (2, ["a", "z"])], "query_id int, markers array<string>")
    assert rows(history.markers_found(r, m)) == [(1, True), (2, False)]
