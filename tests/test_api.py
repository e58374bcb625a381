"""Each tool over a small memory."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.api import Memory
from quarry.scope import Scope


@pytest.fixture(scope="module")
def memory(spark):
    def table(data, schema):
        df = spark.createDataFrame(data, schema)
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "generated_at", "started_at") if c in df.columns})

    at = "2024-01-{:02d} 00:00:00".format
    return Memory({
        "sessions": table([("s1", "web", "First", at(1)), ("s2", "api", "Second", at(2)), ("s3", None, "Third", at(3))], "session_id string, project string, title string, started_at string"),
        "turns": table([
            (1, "s1", 0, "user", at(1), "text", "fix the database migration", None), (2, "s1", 1, "assistant", at(1), "text", "the migration ran on 10.0.0.12 today", "ran"),
            (3, "s2", 0, "user", at(2), "text", "database pool of the migration", None), (4, "s3", 0, "user", at(3), "text", "migration elsewhere", None), (5, "s1", 2, "assistant", at(4), "tool_use", "migration", None),
        ], "turn_id long, session_id string, idx int, role string, ts string, content_type string, content string, gist string"),
        "tool_calls": table([("s1", "Bash", "boom", True, at(1)), ("s2", "Read", "bad", True, at(2)), ("s2", "Read", "fine", False, at(3))], "session_id string, tool_name string, tool_output string, is_error boolean, ts string"),
        "file_touches": table([("s1", "/r/A.py", "edit", at(1)), ("s2", "/r/b.py", "write", at(2))], "session_id string, file_path string, op string, ts string"),
        "summaries": table([("s1", "web", "m", at(5), "pool", "", "", "", ""), ("s2", "api", "m", at(6), "cache", "", "", "", "")], "session_id string, project string, model string, generated_at string, request string, investigated string, learned string, completed string, next_steps string"),
        "observations": table([("s1", "web", "decision", "Use a pool", "of connections", at(5)), ("s2", "api", "note", "Other", "thing", at(6))], "session_id string, project string, kind string, title string, subtitle string, ts string"),
        "feedback": table([(3, at(30), 3)], "turn_id long, ts string, weight int"),
        "symbols": table([("loadUser", "function", "src/user.py"), ("saveOrder", "function", "src/order.py"), ("Order", "class", "src/order.py")], "name string, kind string, path string"),
        "routes": table([("GET", "/users/:id"), ("POST", "/orders")], "method string, name string"),
        "pages": table([("/about", "page"), ("/blog/:slug", "page")], "name string, kind string"),
        "env": table([("DATABASE_URL", "env-example"), ("DATABASE_URL", "source"), ("DEBUG", "source")], "name string, source string"),
        "fields": table([("User", "email"), ("User", "name"), ("Empty", None)], "model string, name string"),
        "gql_fields": table([("Query", "user")], "model string, name string"),
        "flags": table([("new-ui", "json")], "name string, source string"),
        "workspaces": table([("all", ["web", "api"])], "name string, projects array<string>"),
    })


def ids(df, column="turn_id"):
    return [r[column] for r in df.collect()]


def test_turns(memory):
    assert set(ids(memory.search("database migration"))) == {1, 2, 3, 4} and ids(memory.search("database migration"))[0] == 3  # feedback
    assert set(ids(memory.search("database migration", popular=False))[:2]) == {1, 3}
    assert set(ids(memory.within(Scope(("web",))).search("migration"))) == {1, 2} and ids(memory.within(Scope((), ("web",))).search("migration")) == [3]
    assert memory.search("migration", 3).filter("turn_id = 2").select("preview").collect() in ([], [("ran",)])
    assert {(r.id, r.source) for r in memory.global_search("10.0.0.12").collect()} >= {(2, "search")}
    assert ids(memory.expand([2, 1])) == [1, 2] and [r.shown for r in memory.session_export("s1", full=True).collect()][0] == "fix the database migration"
    assert [r.idx for r in memory.session_export("s1", budget=30).collect()] == [0, 1] and [r.idx for r in memory.session_export("s1", offset=2).collect()] == [2]
    assert memory.rate(1, False, "2024-01-30 00:00:00").filter("turn_id = 1").first().weight == -3
    assert ids(memory.resume("migration pool"), "session_id")[0] == "s2" and memory.topics().count() >= 1


def test_sessions(memory):
    assert ids(memory.sessions(), "session_id") == ["s1", "s3", "s2"] and {r.name: r.n for r in memory.status().collect()}["turns"] == 5
    assert ids(memory.errors(), "session_id") == ["s2", "s1"] and ids(memory.errors("Bash"), "preview") == ["boom"]
    assert ids(memory.files("a.PY"), "file_path") == ["/r/A.py"] and memory.within(Scope(("api",))).files("a.py").count() == 0
    assert ids(memory.summary("pool"), "session_id") == ["s1"] and ids(memory.observations("connections"), "title") == ["Use a pool"]
    assert [r.kind for r in memory.handoff("web").collect()] == ["summary", "decision"] and memory.handoff("web", "s1").count() == 0
    assert ids(memory.workspaces(), "name") == ["all"]
    with pytest.raises(KeyError, match="nothing"):
        memory._of("nothing")


def test_names(memory):
    assert memory.resolve_symbol("loadUsr").first().name == "loadUser" and memory.resolve_route("/users/7", "GET").first().name == "/users/:id"
    assert memory.check_new_page("/blog/x").first().name == "/blog/:slug" and memory.check_flag("new-ui").first().layer == 0
    assert [r.source for r in memory.check_env_var("DATABASE_URL").orderBy("place").collect()] == ["env-example", "source"]
    assert memory.check_db_field("emial", "User").count() in (0, 1) and memory.check_db_field("email", "User").first().name == "User.email" and memory.check_gql_field("user", "Query").first().layer == 0
    got = {r.probe: (r.domain, r.status) for r in memory.check_name("DATABASE_URL").collect()}
    assert got == {"DATABASE_URL": ("env", "OK")} and memory.check_name("qqqqqq").first().status == "UNKNOWN"
    of = lambda *a: tuple(memory.check_name(*a).select("domain", "name", "status").first())
    assert of("email", "auto", "User") == ("db-field", "User.email", "OK") and of("email", "db-field", "Order") == ("db-field", "User.email", "TYPO")
    assert of("User") == ("db-model", "User", "OK") and of("/users/7") == ("route", "/users/:id", "TYPO") and of("loadUser")[0] == "symbol" and of("loadUser", "flag")[2] == "UNKNOWN"
    assert memory.resolve_semantic("save an order").first().name == "saveOrder"


def test_edits(spark, memory):
    edits = spark.createDataFrame([("d", "a.py", "import os\nloadUser(1)\nos.getenv('DATABASE_URL')\nzzzzqq(2)"), ("e", "b.py", "saveOrder()")], "doc string, path string, text string")
    issues, verdicts = memory.lint_proposed_edit(edits)
    assert {r.doc: r.verdict for r in verdicts.collect()} == {"d": "block", "e": "ok"} and {r.name for r in issues.filter("severity = 'unknown'").collect()} == {"zzzzqq"}
    texts, log = memory.rewrite_proposed_edit(spark.createDataFrame([("d", "load_user(1)")], "doc string, text string"), spark.createDataFrame([("load_user",)], "probe string"), spark.createDataFrame([], "name string"))
    assert texts.first().text == "loadUser(1)" and log.first().verdict == "REPLACE"


def test_registries(memory):
    assert ids(memory.symbols("order", kind="class"), "name") == ["Order"] and ids(memory.routes("user"), "name") == ["/users/:id"] and memory.pages().count() == 2
    assert [(r.name, r.sources, r.declared) for r in memory.env_vars().collect()] == [("DATABASE_URL", ["env-example", "source"], True), ("DEBUG", ["source"], False)]
    assert ids(memory.feature_flags(), "name") == ["new-ui"] and {r.model: r.fields for r in memory.db_models().collect()} == {"Empty": 0, "User": 2}
    assert ids(memory.db_fields("User"), "name") == ["email", "name"] and memory.gql_types().count() == 1 and ids(memory.gql_fields("Query"), "name") == ["user"]
