"""Stores, registries and lint strategies on small tables."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import grounding, lint, resolve, upkeep
from quarry.plans import upkeep as plans
from quarry.sources import code


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ids_follow_names_as_published(spark):
    names = ["", "http://a.b/c?d", "é😀", "x" * 500]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", upkeep.uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_vectors_are_delivered_once(spark):
    schema = "name string, vector array<double>"
    store = spark.createDataFrame([], "id string, name string, vector array<double>")
    first = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0]), ("c", None), ("d", [0.0, 0.0]), ("d", None)], schema)
    store, status = upkeep.upsert_vectors(store, first, 2)
    assert {r.name: r.status for r in status.collect()} == {"a": "inserted", "b": "failed", "c": "failed", "d": "inserted"}
    again, status = upkeep.upsert_vectors(store, spark.createDataFrame([("a", [1.0, 2.0]), ("d", [5.0, 5.0]), ("d", [5.0])], schema), 2)
    assert {r.name: r.status for r in status.collect()} == {"a": "unchanged", "d": "updated"}
    assert sorted((r.name, r.vector) for r in again.collect()) == [("a", [1.0, 2.0]), ("d", [5.0, 5.0])]


def test_groups_on_files_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    upkeep.write_groups(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, project string"), path, "project")
    upkeep.write_groups(spark.createDataFrame([(9, "a")], "id int, project string"), path, "project")
    assert rows(spark.read.parquet(path).select("id", "project")) == [(3, "b"), (9, "a")]


def test_rerank_needs_enough_scores(spark):
    hits = spark.createDataFrame([(1, 1, 9.0, "x"), (1, 2, 8.0, "xx"), (1, 3, 7.0, None), (2, 1, 9.0, "x"), (2, 2, 8.0, None)], "query_id int, id int, score double, text string")
    got = {(r.query_id, r.id): r.place for r in upkeep.rerank(hits, F.length("text")).collect()}
    assert got == {(1, 2): 1, (1, 1): 2, (1, 3): 3, (2, 1): 1, (2, 2): 2}


def test_hashed_vectors_shuffle_rare_words_only(spark):
    """Whichever words the tasks weigh themselves, vectors are those of plain sums, and texts without words have none."""
    import math

    texts = {1: "a b b c", 2: "a b Zeta zeta", 3: "a", 4: "!!", 5: None, 6: "c d e f g h 1 2 3 a"}
    corpus = spark.createDataFrame(list(texts.items()), "id int, text string")
    words = {i: (t or "").lower().replace("!", "").split() for i, t in texts.items()}
    held = {w for ws in words.values() for w in ws}
    place = {r.w: (r.at, 1.0 if r.s % 2 == 0 else -1.0) for r in spark.createDataFrame([(w,) for w in held], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(16)).alias("at"), F.xxhash64(F.lit(1), "w").alias("s")).collect()}
    for weighed in (0, 2, 3, 100):
        got = {r.id: r.vector for r in upkeep.hashed_vectors(corpus, 16, weighed).collect()}
        assert set(got) == {1, 2, 3, 6}
        for i, vector in got.items():
            plain = [0.0] * 16
            for w in set(words[i]):
                at, sign = place[w]
                plain[at] += sign * math.sqrt(words[i].count(w)) * math.log(1 + len(texts) / sum(w in ws for ws in words.values()))
            size = math.sqrt(sum(x * x for x in plain))
            assert all(abs(x / size - y) < 1e-9 for x, y in zip(plain, vector, strict=True))


def test_semantic_search_takes_any_embedder(spark):
    corpus = spark.createDataFrame([(1, "red apple pie"), (2, "blue sky"), (3, "apple apple tree"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(7, "an apple tree")], "query_id long, text string")
    assert [r.id for r in upkeep.semantic_search(corpus, queries, 2).orderBy(F.desc("score")).collect()] == [3, 1]
    assert [r.id for r in upkeep.semantic_search(corpus, queries, 2, where=F.col("id") < 3).orderBy(F.desc("score")).collect()][0] == 1
    length = lambda df: df.select("id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector")).filter("text is not null")
    assert upkeep.semantic_search(corpus, queries, 1, embed=length).first().id == 1
    norms = upkeep.hashed_vectors(corpus, 16).select(F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("n")).distinct().collect()
    assert [r.n for r in norms] == [1.0]


def test_semantic_top5_answers_every_item(spark, tmp_path):
    """Whatever their ids, items with words are compared with every document; ties go to the smaller id."""
    import math

    docs = {0: "red apple pie", 1: "blue sky", 2: "apple apple tree", 3: None, 4: "a tall tree", 5: "sky and sea", 6: "blue sea", 7: "pie"}
    items = {0: "an apple tree", 1: "the blue sea", 7: "pie", 20: "tall sky", 39: "?!", 41: "unheard of"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    both = [(2 * i, t) for i, t in docs.items()] + [(2 * i + 1, t) for i, t in items.items()]
    made = {r.id: r.vector for r in upkeep.hashed_vectors(spark.createDataFrame(both, "id long, text string")).collect()}
    want = []
    for i in items:
        if 2 * i + 1 in made:
            near = sorted((-round(math.sumprod(made[2 * i + 1], made[2 * d]), 9), d) for d in docs if 2 * d in made)[:5]
            want += [(i, d, round(-s, 6)) for s, d in near]
    got = sorted(map(tuple, plans.semantic_top5(spark, str(tmp_path)).collect()))
    assert {i for i, _, _ in got} == {0, 1, 7, 20, 41} and [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))


def test_training_rows_are_the_same_every_time(spark):
    make = upkeep.training_pairs(500)
    a, b = make(spark), make(spark).repartition(3)
    assert rows(a) == rows(b) and a.columns[1:8] == ["bm25", "vector", "recency", "overlap", "same_project", "source", "popularity"]
    assert 0.1 < a.agg(F.avg("label")).first()[0] < 0.9


def test_live_tables_and_lines(spark):
    spark.range(1).createOrReplaceTempView("a_view_that_is_live")
    assert "a_view_that_is_live" in {r.name for r in upkeep.live_tables(spark).collect()}
    df = spark.createDataFrame([("- **Added** a thing. More.",), ("\n## Head\nx",), (None,), ("x" * 300,)], "t string")
    got = [r.s for r in df.select(upkeep.one_line(F.col("t")).alias("s")).collect()]
    assert got[:3] == ["Added a thing.", "Head", ""] and len(got[3]) == 200


ROUTES = [("GET", "/users/:id"), ("POST", "/users"), ("*", "/files/*")]


def test_route_issues(spark):
    calls = [("d", "GET", "https://h/users/7?x=1"), ("d", "DELETE", "/users/7"), ("d", "POST", "/users"), ("e", "GET", "/files/a/b"), ("e", "GET", "/userz"), ("e", "GET", "/qqqqqqq"), ("e", "GET", "/x/${id}")]
    got = {(r.name): (r.severity, round(r.confidence, 2)) for r in grounding.routes(spark.createDataFrame(calls, "doc string, method string, name string"), spark.createDataFrame(ROUTES, "method string, name string")).collect()}
    assert got["https://h/users/7?x=1"] == ("ok", 1.0) and got["/users/7"] == ("low", 0.85) and got["/users"] == ("ok", 1.0) and got["/files/a/b"] == ("ok", 1.0)
    assert got["/userz"][0] == "low" and got["/qqqqqqq"] == ("unknown", 0.9) and "/x/${id}" not in got
    none = spark.createDataFrame([], "method string, name string")
    assert grounding.routes(spark.createDataFrame(calls, "doc string, method string, name string"), none).count() == 0


def test_variable_tiers(spark):
    index = [("DATABASE_URL", "env-example"), ("DATABSE_URL", "source"), ("ONLY_USED_HERE", "source"), ("API_KEY", "zod-schema")]
    asked = [("d", n) for n in ("DATABASE_URL", "DATABSE_URL", "ONLY_USED_HERE", "API_KEYS", "QQQQ")]
    got = {r.name: (r.severity, r.candidate, r.confidence) for r in grounding.env(spark.createDataFrame(asked, "doc string, name string"), spark.createDataFrame(index, "name string, source string")).collect()}
    assert got["DATABASE_URL"] == ("ok", "DATABASE_URL", 1.0) and got["ONLY_USED_HERE"] == ("low", None, 0.55) and got["QQQQ"] == ("unknown", None, 0.92)
    assert got["DATABSE_URL"][:2] == ("low", "DATABASE_URL") and got["API_KEYS"][:2] == ("low", "API_KEY") and 0.6 <= got["DATABSE_URL"][2] < 1
    found = resolve.resolve_env(spark.createDataFrame([("API_KEY",), ("DATABASE_UR",)], "probe string"), spark.createDataFrame([*index, ("API_KEY", "source")], "name string, source string"))
    assert [(r.name, r.source) for r in found.filter("probe = 'API_KEY'").orderBy("place").collect()] == [("API_KEY", "zod-schema"), ("API_KEY", "source")]
    assert found.filter("probe = 'DATABASE_UR' and place = 1").first().name == "DATABASE_URL"


def test_field_issues(spark):
    index = spark.createDataFrame([("User", "email"), ("User", "name"), ("Order", "total")], "model string, name string")
    asked = spark.createDataFrame([("d", "User", "email"), ("d", "User", "total"), ("d", "User", "emails"), ("d", "User", "zzz"), ("d", "Nope", "email")], "doc string, model string, name string")
    got = {r.name: (r.severity, r.candidate) for r in grounding.models(asked, index).collect()}
    assert got == {"User.email": ("ok", "User.email"), "User.total": ("low", "Order.total"), "User.emails": ("low", "User.email"), "User.zzz": ("unknown", None), "Nope.email": ("unknown", None)}


def test_pages_imports_and_prose(spark):
    pages = spark.createDataFrame([("/about",), ("/blog/:slug",)], "name string")
    asked = spark.createDataFrame([("d", "/about"), ("d", "/blog/x"), ("d", "/abouts"), ("d", "/qqqq/zz/y")], "doc string, name string")
    got = {r.name: r.severity for r in grounding.new_pages(asked, pages).collect()}
    assert got == {"/about": "unknown", "/blog/x": "low", "/abouts": "low"}
    exports = spark.createDataFrame([("react", "useState"), ("vue", "ref")], "package string, name string")
    used = spark.createDataFrame([("d", "react", "useState"), ("d", "react", "useStat"), ("d", "react", "zzzz"), ("d", "other", "x"), ("d", "react", "ref")], "doc string, package string, name string")
    got = {r.name: r.severity for r in grounding.imports(used, exports).collect()}
    assert got == {"react.useState": "ok", "react.useStat": "low", "react.zzzz": "unknown", "react.ref": "unknown"}
    told = grounding.phrases(spark.createDataFrame([("d", "We met Acme Rockets Inc and the Acme Rocket Inc of Éclair Shop.")], "doc string, text string"))
    assert {r.name for r in told.collect()} == {"Acme Rockets Inc", "Acme Rocket Inc"}
    issues = grounding.prose(told, spark.createDataFrame([("Acme Rockets Inc",)], "name string")).collect()
    assert [(r.name, r.candidate) for r in issues] == [("Acme Rocket Inc", "Acme Rockets Inc")]
    every = grounding.lint({"page": (asked, pages), "import": (used, exports), "nothing": (asked, pages)})
    assert lint.verdicts(every).first().verdict == "block"


def test_strategies_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(grounding, "STRATEGIES", dict(grounding.STRATEGIES))
    grounding.strategy("mine")(lambda refs, index: refs.select("doc", F.lit("mine").alias("domain"), "name", F.lit("low").alias("severity"), F.lit("x").alias("candidate"), F.lit(0.5).alias("confidence")))
    refs = spark.createDataFrame([("d", "n")], "doc string, name string")
    assert grounding.lint({"mine": (refs, refs)}).first().domain == "mine"
    with pytest.raises(ValueError, match="strategy"):
        grounding.lint({"none": (refs, refs)})


def test_what_speaks_for_a_name_beyond_candidates(spark):
    probes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("E",)], "probe string")
    lines = spark.createDataFrame([("d", 1, "x = A"), ("d", 3, "# TODO: add A"), ("d", 9, "// B is planned"), ("d", 20, "C = 1")], "doc string, n int, text string")
    got = {r.probe: (r.verdict, r.confidence, r.strategy) for r in grounding.beyond_candidates(probes, spark.createDataFrame([("db", "C"), ("db", "A")], "domain string, name string"), lines, spark.createDataFrame([("C",), ("D",)], "name string")).collect()}
    assert got == {"A": ("ACCEPT_SDK", 0.85, "comment_context"), "B": ("ACCEPT_SDK", 0.7, "comment_context"), "C": ("RESIDUAL", 0.6, "cross_domain"), "D": ("RESIDUAL", 0.5, "project_history")}


def test_rewrites_are_applied_to_words_and_logged(spark):
    texts = spark.createDataFrame([("d", "API_KY and MY_API_KY; COST$"), ("e", "nothing here")], "doc string, text string")
    winners = [("API_KY", "REPLACE", 0.9, "API_KEY$1", "trigram"), ("COST", "RESIDUAL", 0.4, None, "suffix"), ("MY_API_KY", "REPLACE", 0.9, "MY", "trigram")]
    made, log = grounding.apply_rewrites(texts, spark.createDataFrame(winners, "probe string, verdict string, confidence double, name string, strategy string"), spark.createDataFrame([("MY_API_KY",)], "name string"))
    assert rows(made) == [("d", "API_KEY$1 and MY_API_KY; COST$"), ("e", "nothing here")]
    assert {(r.probe, r.verdict) for r in log.collect()} == {("API_KY", "REPLACE"), ("COST", "RESIDUAL"), ("MY_API_KY", "blocked")}


def test_exports_and_pages_resolve_in_their_place(spark):
    exports = spark.createDataFrame([("a", "render"), ("b", "renders")], "package string, name string")
    got = resolve.resolve_exports(spark.createDataFrame([("render", "b"), ("render", "a")], "probe string, package string"), exports)
    assert {(r.package, r.name, r.layer) for r in got.collect()} == {("a", "render", 0), ("b", "renders", 1)}
    pages = spark.createDataFrame([("/a", "api"), ("/a", "page"), ("/a/:x", "page")], "name string, kind string")
    got = resolve.check_new_pages(spark.createDataFrame([("/a",), ("/a/b",)], "probe string"), pages)
    assert [(r.probe, r.kind) for r in got.orderBy("probe", "place").collect()] == [("/a", "page"), ("/a", "api"), ("/a/b", "page")]


def test_open_patterns_meet_by_first_segment(spark):
    known = spark.createDataFrame([("GET", "/files/*"), ("GET", "/:any/*"), ("GET", "/*")], "method string, name string")
    got = resolve.resolve_routes(spark.createDataFrame([("/files/a/b", "GET"), ("/other/x", "GET"), ("/", "GET")], "probe string, method string"), known, 1.0)
    assert {r.probe: r.name for r in got.filter("place = 1").collect()} == {"/files/a/b": "/files/*", "/other/x": "/:any/*", "/": "/*"}


def test_names_a_shell_sets_and_flag_calls(spark):
    files = [("/r/a.sh", "echo $PS1 $EDITOR ${DISPLAY} $LC_ALL $MINE $1"), ("/r/b.ts", "Statsig.getConfig('one'); Statsig.getFeatureGate('two'); Statsig.checkGateSync('three'); posthog.getFeatureFlag('four'); flags.get('five'); featureFlags['six']; other.checkGate('no')")]
    got = code.names(spark.createDataFrame(files, "path string, text string"), "env", "flag").collect()
    assert {r.name for r in got if r.domain == "env"} == {"MINE"}
    assert {r.name for r in got if r.domain == "flag"} == {"one", "two", "three", "four", "five", "six"}


def test_slugs_by_the_four_steps(spark):
    from quarry.sources import transcripts

    cases = {
        "-home-al-Documents-projects-my-app": "my-app", "-home-al-projects-a-projects-b": "a-projects-b", "-home-al--config-x": "config-x", "-home-al-work-x": "work-x",
        "--srv-x": "srv-x", "": "_orphan", "_orphan": "_orphan", "-projects-": "-projects-", None: "_orphan",
    }
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    assert {r.f: r.s for r in df.select("f", transcripts.slug_of(F.col("f")).alias("s")).collect()} == cases


def test_edits_come_out_of_transcripts_and_are_replayed(spark, tmp_path):
    import json

    from quarry.sources import documents, transcripts

    def call(ts, name, **given):
        return json.dumps({"type": "assistant", "timestamp": f"2024-01-01T00:00:0{ts}Z", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": f"c{ts}", "name": name, "input": given}]}})

    folder = tmp_path / "-home-al-projects-demo"
    folder.mkdir()
    lines = [
        call(3, "Edit", file_path="/r/a.ts", old_string="two", new_string="2", replace_all=True),
        call(1, "Write", file_path="/r/a.ts", content="one two two three"),
        call(2, "MultiEdit", file_path="/r/a.ts", edits=[{"old_string": "one", "new_string": "1"}, {"old_string": "1 two", "new_string": "1  two"}]),
        call(4, "Read", file_path="/r/a.ts"),
        call(5, "Edit", file_path="\\r\\b.ts", old_string="x", new_string="y"),
        "not json",
    ]
    (folder / "s.jsonl").write_text("\n".join(lines))
    calls = transcripts.tool_calls(transcripts.blocks(transcripts.parse_lines(transcripts.read_lines(spark, str(tmp_path)))))
    edits = transcripts.edit_operations(calls)
    assert [(r.op, r.old) for r in edits.filter("path = '/r/a.ts'").orderBy("seq").collect()] == [("write", ""), ("edit", "one"), ("edit", "1 two"), ("edit", "two")]
    assert transcripts.edit_operations(calls, "b.ts").count() == 1 == transcripts.edit_operations(calls, "nothing.ts").count() + 1
    whole = {r.path: (r.text, r.applied, r.failed) for r in documents.replay_edits(edits.drop("ts")).collect()}
    assert whole["/r/a.ts"] == ("1  2 2 three", 4, 0) and whole["/r/b.ts"] == ("", 0, 1)
    snapshots = spark.createDataFrame([("/r/a.ts", "2024-01-01 00:00:02", "snap two")], "path string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    repository = spark.createDataFrame([("/r/a.ts", "old"), ("/r/b.ts", "x and x")], "path string, text string")
    bases = documents.base_texts(edits, snapshots, repository)
    assert {r.path: (r.source, r.text) for r in bases.collect()} == {"/r/a.ts": ("file-history", "snap two"), "/r/b.ts": ("db-and-git", "x and x")}
    from_base = {r.path: (r.text, r.applied, r.failed) for r in documents.replay_from(edits, bases).collect()}
    assert from_base == {"/r/a.ts": ("snap 2", 1, 0), "/r/b.ts": ("y and x", 1, 0)}
    only_writes = spark.createDataFrame([("/w", 0, "write", "", "t", False)], "path string, seq int, op string, old string, new string, replace_all boolean")
    assert documents.base_texts(only_writes, snapshots, spark.createDataFrame([("/w", "kept")], "path string, text string")).first().source == "write-only"


def test_newest_showing_on_streams(spark, tmp_path):
    from quarry.streaming import incremental

    schema = "k string, ts timestamp"
    for name, data in {"shown": [("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:00:40"), ("z", "2024-01-01 01:00:00")], "used": [("a", "2024-01-01 00:00:50"), ("a", "2024-01-01 00:05:00"), ("z", "2024-01-01 01:00:00")]}.items():
        spark.createDataFrame(data, "k string, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(schema).parquet(str(tmp_path / n)).withWatermark("ts", "10 seconds")
    out = incremental.attribute(read("shown"), read("used"), "k")
    query = out.writeStream.format("memory").queryName("attributed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.k, str(r.used_ts), str(r.shown_ts)) for r in spark.table("attributed").collect()]
    assert ("a", "2024-01-01 00:00:50", "2024-01-01 00:00:40") in got and not any(t == "2024-01-01 00:05:00" for _, t, _ in got)
    assert len({(k, t) for k, t, _ in got}) == len(got)
