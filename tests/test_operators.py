"""Operators on small tables: maintenance, ingest, resolution, ranking, streams."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import grounding, ranking, resolve, retrieval, tables, textindex
from quarry.scope import Scope, resolve_scope
from quarry.sources import documents, transcripts
from quarry.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- scope and tables -----------------------------------------------------------------------------


def test_scope(spark):
    df = spark.createDataFrame([("a", "u"), ("b", "v"), (None, "u")], "project string, user string")
    assert rows(df.filter(Scope.parse("a,-b").predicate()).select("project")) == [("a",)]
    assert rows(df.filter(Scope.parse("-a").predicate()).select("project")) == [("b",)]  # null passes no exclude list
    assert df.filter(Scope.parse("all").predicate()).count() == 3
    assert rows(df.filter(Scope.parse("@u").predicate(user="user")).select("project")) == [("a",), (None,)]
    assert resolve_scope(None, None, ("w",), "c").projects == ("w",) and resolve_scope("x", "y", None, None).projects == ("x",)
    assert resolve_scope(None, None, None, "c").projects == ("c",) and resolve_scope(None, None, None, None) == Scope()


def test_upserts(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert rows(tables.upsert(old, new, ["k"], "v")) == [(1, 1, "c"), (2, 5, "b"), (3, 1, "e")]
    assert rows(tables.insert_missing(old, new, ["k"])) == [(1, 1, "a"), (2, 5, "b"), (3, 1, "e")]
    values = spark.createDataFrame([(1, "z"), (2, None)], "k int, x string")
    assert rows(tables.update_from(old, values, ["k"], ["x"])) == [(1, 1, "z"), (2, 5, "b")]


def test_snapshot_diff_and_fingerprint(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", None)], "path string, hash string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "3"), ("r", None)], "path string, hash string")
    assert rows(tables.snapshot_diff(a, b)) == [("p", "unchanged"), ("q", "changed"), ("r", "unchanged"), ("s", "new")]
    assert ("s", "deleted") in rows(tables.snapshot_diff(b, a))
    files = spark.createDataFrame([(5, 10), (7, 20)], "mtime long, size long")
    assert rows(tables.fingerprint(files)) == [(2, 7, 30)] and rows(tables.fingerprint(files.limit(0))) == [(0, None, 0)]


def test_samples_and_cuts(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    picked = [r.n for r in tables.even_sample(df, 5, [F.asc("n")]).orderBy("n").collect()]
    assert picked == [0, 25, 50, 74, 99]
    assert tables.running_cut(df, 10, F.col("n"), [F.asc("n")]).count() == 5
    hits = spark.createDataFrame([(1, 900), (2, 50)], "id int, size int")
    assert rows(retrieval.disclose(hits, 100, [F.asc("id")], F.col("size")).select("id")) == [(1,)]  # the first always


def test_ignore_rules_last_match_wins(spark):
    paths = spark.createDataFrame([("a.log",), ("keep.log",), ("build/x.py",), ("src/build.py",), ("docs/a/b.md",)], "path string")
    got = {r.path: r.skipped for r in tables.ignore_decision(paths, ["# note", "*.log", "!keep.log", "build/", "docs/**/*.md"]).collect()}
    assert got == {"a.log": True, "keep.log": False, "build/x.py": True, "src/build.py": False, "docs/a/b.md": True}


def test_corruption(spark):
    cases = [(b"\0" * 10, 10, "ZEROED"), (b"ab\0cdefgh", 9, "PARTIAL_ZERO"), (b"ab", 10, "SHRUNK"), (b"hello", 5, "OK"), (b"\xff\xfea\0b\0", 6, "OK"), (b"", 0, "OK")]
    df = spark.createDataFrame(cases, "c binary, n int, w string")
    got = df.select("w", tables.corruption(F.col("c"), F.col("n"), F.lit(False)).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


# --- ingest ---------------------------------------------------------------------------------------


@pytest.fixture
def folder(tmp_path):
    project = tmp_path / "-home-user-demo"
    project.mkdir()
    say = lambda **x: json.dumps(x)
    user = lambda ts, content: say(type="user", timestamp=ts, message={"role": "user", "content": content})
    lines = [
        say(type="ai-title", aiTitle="First"),
        user("2024-01-01T00:00:00Z", "plain \u0000text"),
        "{not json",
        say(type="assistant", timestamp="2024-01-01T00:00:05Z", message={"role": "assistant", "model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}, "content": [
            {"type": "text", "text": "same length A"}, {"type": "text", "text": "same length B"},
            {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/a.py", "old_string": "x", "new_string": "y"}},
        ]}),
        user("bad time", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "failed"}]),
        say(type="permission-mode"),
        say(type="ai-title", aiTitle="Last"),
    ]
    (project / "s1.jsonl").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_ingest_keeps_every_block(spark, folder):
    parsed = transcripts.parse_lines(transcripts.read_lines(spark, str(folder)))
    of = transcripts.blocks(parsed)
    turns = transcripts.turns(of)
    got = [(r.idx, r.role, r.content_type, r.content) for r in turns.orderBy("idx").collect()]
    assert [g[:3] for g in got] == [(0, "user", "text"), (1, "assistant", "text"), (2, "assistant", "text"), (3, "assistant", "tool_use"), (4, "user", "tool_result")]
    assert got[0][3] == "plain text"
    calls = transcripts.tool_calls(of)
    call = calls.collect()[0]
    assert (call.tool_name, call.is_error, call.tool_output, call.duration_ms) == ("Edit", True, "failed", None)
    assert rows(transcripts.file_touches(calls).select("file_path", "op")) == [("/a.py", "edit")]
    s = transcripts.sessions(turns, parsed).collect()[0]
    assert (s.title, s.total_turns, s.tokens_in, s.tokens_out, s.project) == ("Last", 5, 3, 4, "demo")
    bad = transcripts.damaged(parsed).collect()
    assert len(bad) == 1 and bad[0].bad == 1
    after = transcripts.after_cursor(parsed, spark.createDataFrame([("s1", 3)], "session_id string, line_no int"))
    assert after.count() == 3


def test_stream_equals_batch_and_redelivery_adds_nothing(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "turns"), str(tmp_path / "cp")
    for again in (checkpoint, checkpoint, str(tmp_path / "fresh")):
        incremental.ingest_stream(spark, str(folder), out, again).trigger(availableNow=True).start().awaitTermination()
    batch = transcripts.turns(transcripts.blocks(transcripts.parse_lines(transcripts.read_lines(spark, str(folder)))))
    keys = ["session_id", "line_no", "block_no", "content"]
    assert rows(spark.read.parquet(out).select(*keys)) == rows(batch.select(*keys))


def test_windows_and_attribution_on_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:10", "view"), (1, "2024-01-01 00:00:50", "use"), (1, "2024-01-01 02:00:00", "use"), (2, "2024-01-01 00:00:00", "view")], "k int, ts string, t string")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    hit = incremental.attribute(events.filter("t = 'view'"), events.filter("t = 'use'"), "k").collect()
    assert len(hit) == 1 and str(hit[0].shown_ts) == "2024-01-01 00:00:10"
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.tumbling(stream, "1 hour", "t", late="1 minute").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("tumbled").select("t", "n")) == rows(incremental.tumbling(events, "1 hour", "t").select("t", "n"))
    assert rows(incremental.session_windows(events, "30 minutes", "k").select("k", "n")) == [(1, 1), (1, 2), (2, 1)]


def test_markdown(spark):
    text = "# Top\nintro\n```\n# not a heading\n```\n## Section A\na\n### Sub\ns\n## Section B\nb"
    got = dict(documents.sections(text))
    assert list(got) == ["Top", "Top > Section A", "Top > Section A > Sub", "Top > Section B"]
    assert got["Top > Section A"] == "## Section A\na\n### Sub\ns" and got["Top"] == text
    assert list(documents.sections("plain")) == [("(no heading)", "plain")]
    assert list(documents.chunks("aa\n\nbb\n\n" + "c" * 25, 10)) == ["aa\n\nbb", "c" * 10, "c" * 10, "c" * 5]
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert documents.markdown_chunks(df).count() == 4


def test_edit_replay(spark):
    edits = [("p", 1, "write", None, "one two one", False), ("p", 2, "edit", "one", "1", False), ("p", 3, "edit", "o", "0", True), ("p", 4, "edit", "zzz", "", False), ("q", 1, "edit", "a", "b", False)]
    df = spark.createDataFrame(edits, "path string, seq int, op string, old string, new string, replace_all boolean")
    assert rows(documents.replay_edits(df)) == [("p", "1 tw0 0ne", 3, 1), ("q", "", 0, 1)]


def test_changelog(spark):
    df = spark.createDataFrame([(1, "## [1.0]\n### Added\n- a\n- b\n### Fixed\n* c\n## 0.9\n- d")], "doc_id long, text string")
    assert rows(documents.changelog_sections(df)) == sorted([(1, "1.0", "Added", 2), (1, "1.0", "Fixed", 1), (1, "0.9", "Fixed", 1)], key=str)


# --- names ----------------------------------------------------------------------------------------


def probes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "probe string")


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_rewriting_strategies(spark):
    names = named(spark, "DATABASE_URL", "LAUNCHDARKLY_SDK_KEY", "API_USER_TOKEN", "STRIPE_SECRET_KEY", "SENTRY_DSN", "MAIL_HOST")
    p = probes(spark, "DATABASE_URL", "databaseUrl", "LD_SDK_KEY", "USER_API_TOKEN", "STRIPE_KEY", "SENTRYY_DSN", "MAIL_TOKEN", "NODE_ENV", "WHOLLY_OTHER_THING")
    got = {r.probe: (r.verdict, r.strategy, r.name) for r in resolve.rewrite(p, names, accepted=["NODE_ENV"], abbreviations={"LD": "LAUNCHDARKLY"}).collect()}
    assert got["DATABASE_URL"] == ("OK", "exact", "DATABASE_URL")
    assert got["databaseUrl"] == ("REPLACE", "case_normalize", "DATABASE_URL")
    assert got["LD_SDK_KEY"] == ("REPLACE", "acronym", "LAUNCHDARKLY_SDK_KEY")
    assert got["USER_API_TOKEN"] == ("REPLACE", "token_set", "API_USER_TOKEN")
    assert got["STRIPE_KEY"] == ("REPLACE", "token_edit", "STRIPE_SECRET_KEY")
    assert got["SENTRYY_DSN"][0] == "REPLACE" and got["SENTRYY_DSN"][2] == "SENTRY_DSN"
    assert got["NODE_ENV"] == ("ACCEPT_SDK", "catalog", "NODE_ENV")
    assert got["WHOLLY_OTHER_THING"] == ("RESIDUAL", "none", None) and len(got) == 9
    assert resolve.rewrite(p.limit(0), names).count() == 0


def test_cascades(spark):
    flags = named(spark, "checkout-flow-v2", "dark-mode")
    got = {r.probe: (r.name, r.layer) for r in resolve.resolve_names(probes(spark, "dark-mode", "checkout-flow-v1", "zzz"), flags).filter("place = 1").collect()}
    assert got == {"dark-mode": ("dark-mode", 0), "checkout-flow-v1": ("checkout-flow-v2", 1)}
    aliased = spark.createDataFrame([("Acme", ["ACM", "acme inc"])], "name string, aliases array<string>")
    assert rows(resolve.by_alias(probes(spark, "ACM"), aliased)) == [("ACM", "Acme", 1.0)]
    status = {r.probe: r.status for r in resolve.check_names({"flag": resolve.resolve_names(probes(spark, "dark-mode", "dark-mod", "zzz"), flags)}, probes(spark, "dark-mode", "dark-mod", "zzz")).collect()}
    assert status["dark-mode"] == "OK" and status["zzz"] == "UNKNOWN" and status["dark-mod"] in ("TYPO", "UNCERTAIN")


def test_one_token_off_equals_edit_distance(spark):
    from quarry.functions.similarity import token_edits

    words = ["A", "B", "A_B", "B_A", "A_B_C", "A_C", "A_B_C_D", "", "A_A", "A_A_A", "C_B_A", "X_B_C"]
    p, n = spark.createDataFrame([(w,) for w in words], "probe string"), spark.createDataFrame([(w,) for w in words if w != "B"], "name string")
    first = {}
    for r in sorted(p.crossJoin(n).filter(token_edits(F.col("probe"), F.col("name")) == 1).collect(), key=lambda r: r.name, reverse=True):
        first[r.probe] = r.name
    got = {}
    for r in resolve.one_token_off(p, n).filter(token_edits(F.col("probe"), F.col("name")) == 1).collect():
        got[r.probe] = min(got.get(r.probe, r.name), r.name)
    assert got == first and resolve.one_token_off(p, n).count() == resolve.one_token_off(p, n).filter(token_edits(F.col("probe"), F.col("name")) == 1).count()
    many = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("name"))
    probes = spark.range(20_000, 30_000).select(F.concat(F.lit("n"), "id").alias("probe"))
    assert resolve.one_token_off(probes, many).count() <= 20_000


def test_trie_of_routes_equals_expressions(spark):
    from quarry.functions.text import route_regex

    names = ["/", "/*", "*", "/api/users/:id", "/api/users/me", "/api/:kind/*", "/:lang/*", "/:lang/about", "/files/*", "/a/:b/c/:d", "/a.b/[x]", "/a/*/b", "", "/:x"]
    routes = spark.createDataFrame([(m, n) for i, n in enumerate(names) for m in (["GET", "*"] if i % 2 else ["POST"])], "method string, name string")
    paths = ["/", "", "/api/users/7", "/api//users/me/", "/files", "/files/", "/files/a/b", "/en/about", "/a/1/c/2", "/a/1/c", "/aXb/[x]", "/a.b/[x]", "/a/*/b", "a/b", "/x", "//", "/a/z/b", None]
    probes = spark.createDataFrame([(p, m) for p in paths for m in ("GET", "PUT", "POST")], "probe string, method string")
    got = {tuple(r) for r in resolve.match_routes(probes, routes).select("probe", "method", "name").collect()}
    met = probes.join(routes.select(F.col("method").alias("rmethod"), "name"), (F.col("method") == F.col("rmethod")) | (F.col("rmethod") == "*"))
    want = {(r.probe, r.method, r.name) for r in met.filter(F.rlike("probe", route_regex(F.col("name")))).collect()}
    assert got == want and len(want) > 40
    plan = resolve.match_routes(probes, routes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert resolve.match_routes(probes, routes.limit(0)).count() == 0


def test_every_probe_of_a_field_is_answered(spark):
    fields = spark.createDataFrame([("User", "email"), ("Post", "title")] + [(f"M{i:02}", "id") for i in range(60)], "model string, name string")
    p = spark.createDataFrame([("email", "User"), ("email", "Order"), ("emial", "Post"), ("id", "M59"), ("id", "User")], "probe string, model string")
    got = {(r.probe, r.model): (r.name, r.layer) for r in resolve.resolve_fields(p, fields, 0.2).filter("place = 1").collect()}
    assert got == {("email", "User"): ("User.email", 0), ("email", "Order"): ("User.email", 1), ("emial", "Post"): ("User.email", 3), ("id", "M59"): ("M59.id", 0), ("id", "User"): ("M00.id", 1)}
    used = spark.createDataFrame([(i, f"M{i:02}", "id") for i in range(60)], "doc long, model string, name string")
    assert {r.severity for r in grounding.models(used, fields).collect()} == {"ok"}
    other = spark.createDataFrame([(1, "User", "id"), (2, "User", "emial"), (3, "User", "zzz"), (4, "Nope", "id")], "doc long, model string, name string")
    got = {r.doc: (r.severity, r.candidate, r.confidence) for r in grounding.models(other, fields).collect()}
    assert got[1] == ("low", "M00.id", 0.85) and got[3] == ("unknown", None, 0.9) and got[4] == ("unknown", None, 0.92)


def test_fields_and_routes(spark):
    fields = spark.createDataFrame([("User", "email"), ("Post", "title"), ("Post", "emails")], "model string, name string")
    p = spark.createDataFrame([("email", "User"), ("title", "User"), ("emial", "User")], "probe string, model string")
    got = {r.probe: (r.name, r.layer) for r in resolve.resolve_fields(p, fields, 0.2).filter("place = 1").collect()}
    assert got["email"] == ("User.email", 0) and got["title"] == ("Post.title", 1) and got["emial"][0] == "User.email"
    routes = spark.createDataFrame([("GET", "/api/users/:id"), ("*", "/api/users/me"), ("GET", "/files/*")], "method string, name string")
    p = spark.createDataFrame([("/api/users/me", "POST"), ("/api/users/7", "GET"), ("/api/users/7", "PUT"), ("/files/a/b", "GET")], "probe string, method string")
    got = rows(resolve.resolve_routes(p, routes, 0.9).select("probe", "name", "layer"))
    assert got == [("/api/users/7", "/api/users/:id", 1), ("/api/users/me", "/api/users/me", 0), ("/files/a/b", "/files/*", 1)]


# --- ranking --------------------------------------------------------------------------------------


def test_decay_follows_the_e_folding_time(spark):
    f = spark.createDataFrame([(1, "2024-01-03 00:00:00", 2), (1, "2023-11-01 00:00:00", 9)], "turn_id int, ts string, weight int").withColumn("ts", F.to_timestamp("ts"))
    got = ranking.popularity(f, "2024-01-17 00:00:00").collect()
    assert got[0].popularity == pytest.approx(2 * 2.718281828459045**-1)


def test_fusion_exposes_and_orders_by_the_fused_score(spark):
    a = spark.createDataFrame([(1, 0, 9.0), (2, 1, 8.0)], "id int, rank int, score double")
    b = spark.createDataFrame([(2, 0, 0.5), (3, 1, 0.4)], "id int, rank int, score double")
    got = {r.id: (r.rrf_score, r.source_score) for r in retrieval.reciprocal_rank_fusion([a, b]).collect()}
    assert got[2] == (pytest.approx(1 / 62 + 1 / 61), 8.0) and max(got, key=lambda i: got[i][0]) == 2
    assert [r.id for r in retrieval.interleave([b, a], 3).collect()] == [2, 3, 1]


def test_arbiter(spark):
    def decide(wins, losses, ties=5):
        data = [(i, 1, 0) for i in range(wins)] + [(i, 0, 1) for i in range(losses)] + [(i, 1, 1) for i in range(ties)]
        df = spark.createDataFrame(data, "id int, champion_rank int, challenger_rank int").withColumn("ts", F.col("id"))
        return ranking.arbiter(df, 5000).collect()[0].decision

    assert decide(600, 400) == "promote" and decide(590, 410) == "hold" and decide(249, 251) == "demote" and decide(100, 300) == "hold" and decide(0, 0) == "hold"


def test_threshold_sweep_needs_outcomes(spark):
    data = [(0.65 + i / 100, "accepted") for i in range(20)] + [(0.3 + i / 120, "rejected") for i in range(20)]
    df = spark.createDataFrame(data, "sim double, outcome string")
    best = max(ranking.threshold_sweep(df, [0.3, 0.45, 0.55, 0.6, 0.65]).collect(), key=lambda r: (r.f1, -r.threshold))
    assert 0.45 <= best.threshold <= 0.65
    assert ranking.threshold_sweep(df.limit(10), [0.5]).count() == 0


def test_statistics(spark):
    assert ranking.mcnemar(0, 0) == 1.0 and ranking.mcnemar(93, 1) == pytest.approx(9.593e-27, rel=0.01)
    df = spark.createDataFrame([(float(i % 2),) for i in range(200)], "v double")
    r = ranking.bootstrap_mean(df, "v", 300).collect()[0]
    assert 0.38 < r.low < 0.5 < r.high < 0.62


def test_scorer_and_fit(spark):
    df = spark.createDataFrame([(float(i), float(i > 50)) for i in range(100)], "x double, label double")
    weights, _ = ranking.fit_linear(df, ["x"])
    assert weights[0] > 0
    score = spark.range(1).select(ranking.linear_score([F.lit(0.0)] * 7).alias("s")).collect()[0].s
    assert score == pytest.approx(1 / (1 + 2.718281828459045**0.5))


def vectors_of(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@pytest.mark.parametrize(("preset", "least"), [("balanced", 0.9), ("high-recall", 0.95), ("low-memory", 0.9)])
def test_recall_of_the_cell_index(spark, preset, least):
    """As registered: all vectors of sf0.1 in the index, those of ids divisible by 20 as queries."""
    v = vectors_of(spark, "/root/testdata/sf0.1")
    queries = v.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = pairs(retrieval.cosine_top_k(v, queries, 10))
    found = pairs(retrieval.CellIndex.build(v, preset).search(queries, 10))
    assert len(exact) == len(found) == 10 * queries.count() and len(exact & found) >= least * len(exact)


def test_cell_index_takes_and_loses_rows(spark, sf):
    v = vectors_of(spark, sf)
    queries = v.filter("id in (1, 2)").withColumnRenamed("id", "query_id")
    index = retrieval.CellIndex.build(v.filter("id < 300"), "high-recall")
    grown = index.append(v.filter("id >= 250")).append(v.filter("id < 9"))
    assert grown.rows.count() == v.count()
    first = lambda ix: {(r.query_id, r.id) for r in ix.search(queries, 1).collect()}
    assert first(grown) == {(1, 1), (2, 2)} and not first(grown.remove(spark.createDataFrame([(1,), (2,)], "id int"))) & {(1, 1), (2, 2)}
    assert retrieval.CellIndex.build(v.limit(0)).search(queries, 3).count() == 0


def test_nearest_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    r = np.random.default_rng(5)
    data = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4)]
    v = spark.createDataFrame(data, "id long, vector array<double>").repartition(5)
    queries = v.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    got = {(x.query_id, x.id): x.score for x in retrieval.cosine_top_k(v, queries, 5).collect()}
    unit = lambda a: np.array(a) / max(np.linalg.norm(a), 1e-300)
    want = {}
    for q, a in data[:60:7]:
        best = sorted((-round(float(unit(a) @ unit(b)), 9), i) for i, b in data if b is not None)[:5]
        want |= {(q, i): -s for s, i in best}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_ranked_search_alike_in_batches_by_joins_and_stored(spark, tmp_path):
    texts = ["the cat sat", "The cat, the CAT!", None, "", "dogs and cats é1", "cat " * 50, "dog", "the cat sat"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "cat the"), (2, "dog zebra"), (3, "É1"), (4, None), (5, "!")], "query_id long, text string")
    rows = lambda df: {(r.query_id, r.id): r.score for r in df.collect()}
    want = rows(retrieval.bm25(corpus, queries))
    assert rows(retrieval.bm25_top_k(corpus, queries, 20)) == pytest.approx(want)
    index = textindex.TextIndex.build(corpus.filter("id < 3"), str(tmp_path / "a"), 4).append(corpus.filter("id between 3 and 5")).append(corpus.filter("id > 5"))
    assert rows(index.search(queries, 20)) == pytest.approx(want)
    left = corpus.filter("id not in (1, 6)")
    assert rows(index.delete(spark.createDataFrame([(1,), (6,)], "id int")).search(queries, 20)) == pytest.approx(rows(retrieval.bm25(left, queries)))
    # a text without words, a null one and one that is not there go as well; ids come back, with other texts too
    index.delete(spark.createDataFrame([(2,), (3,), (99,), (1,)], "id int"))
    left = corpus.filter("id not in (1, 2, 3, 6)")
    assert rows(index.search(queries, 20)) == pytest.approx(rows(retrieval.bm25(left, queries)))
    more = spark.createDataFrame([(1, "cat back"), (6, "dog"), (3, "")], "id long, text string")
    assert rows(index.append(more).search(queries, 20)) == pytest.approx(rows(retrieval.bm25(left.unionByName(more), queries)))
    index.delete(more.filter("id = 1"))
    assert rows(index.search(queries, 20)) == pytest.approx(rows(retrieval.bm25(left.unionByName(more.filter("id <> 1")), queries)))
    best = [i for _, i in sorted((-x, i) for (q, i), x in want.items() if q == 1)[:2]]
    assert [r.id for r in retrieval.bm25_top_k(corpus, queries.filter("query_id = 1"), 2).orderBy(F.desc("score"), "id").collect()] == best
    assert retrieval.bm25_top_k(corpus.limit(0), queries, 3).count() == 0


def test_stored_search_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 8)
    monkeypatch.setattr(textindex, "FIRST", 2)
    r = np.random.default_rng(9)
    texts = [(i, " ".join(f"t{i % 12}w{x}" for x in r.zipf(1.6, 20) % 200) + " all" * int(r.integers(1, 5))) for i in range(900)]
    corpus = spark.createDataFrame(texts, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(j, f"all t{j}w1 t{j}w7 t{j + 1}w30") for j in range(8)], "query_id long, text string")
    index = textindex.TextIndex.build(corpus, str(tmp_path / "i"), 4)
    got = index.search(queries, 5, reads=True).collect()
    want = {(x.query_id, x.id): x.score for x in retrieval.bm25_top_k(corpus, queries, 5).collect()}
    assert {(x.query_id, x.id): x.score for x in got} == pytest.approx(want)
    read = {x.query_id: x.postings_read / x.postings_held for x in got}
    assert sum(read.values()) < 0.6 * len(read), read
    assert index.search(queries.limit(0), 5).count() == 0 and textindex.TextIndex.build(corpus.limit(0), str(tmp_path / "none")).search(queries, 3).count() == 0
