"""The tools of an assistant's memory as methods over one set of tables.

``Memory`` holds named tables (any DataFrames: Parquet, views, streams' sinks) and answers each tool's question
as a DataFrame. Methods of names answer one name or a whole table of probes alike. Tables and columns:

=============  =====================================================================================
sessions       session_id, project, title, started_at, ended_at
turns          turn_id, session_id, idx, role, ts, content_type, content, gist
tool_calls     session_id, tool_name, tool_output, is_error, ts
file_touches   session_id, file_path, op, ts
summaries      session_id, project, model, generated_at, request, investigated, learned, completed, next_steps
observations   session_id, project, kind, title, subtitle, ts
feedback       turn_id, ts, weight
symbols        name, kind, path
routes         method, name
pages          name, kind
env            name, source
fields         model, name
gql_fields     model, name
flags          name, source
workspaces     name, projects
=============  =====================================================================================
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import grounding, history, lint, ranking, resolve, retrieval, upkeep
from quarry.scope import Scope
from quarry.sources import code


@dataclass(frozen=True)
class Memory:
    tables: Mapping[str, DataFrame]
    scope: Scope = field(default_factory=Scope)
    as_of: str = "2024-01-31 00:00:00"

    def within(self, scope: Scope) -> Memory:
        return replace(self, scope=scope)

    def _of(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    def _sessions(self) -> DataFrame:
        return self._of("sessions").filter(self.scope.predicate("project"))

    def _mine(self, name: str) -> DataFrame:
        """Rows of a table of sessions within the scope, with their project and title."""
        known = self._sessions().select("session_id", F.col("project").alias("session_project"), F.col("title").alias("session_title"))
        return self._of(name).join(known, "session_id")

    def _probes(self, names: str | DataFrame, **more: str) -> DataFrame:
        if isinstance(names, DataFrame):
            return names
        spark = next(iter(self.tables.values())).sparkSession
        columns = {"probe": names} | more
        return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))

    # --- turns ------------------------------------------------------------------------------------

    def search(self, query: str, limit: int = 10, popular: bool = True) -> DataFrame:
        """(turn_id, session_id, score, preview): the best turns by BM25 among those in scope, raised by their
        feedback."""
        corpus = self._mine("turns").filter("content_type = 'text'").select(F.col("turn_id").alias("id"), F.col("content").alias("text"))
        asked = self._probes("q").select(F.lit(0).cast("long").alias("query_id"), F.lit(query).alias("text"))
        hits = retrieval.bm25_top_k(corpus, asked, 6 * limit).select(F.col("id").alias("turn_id"), "score")
        if popular and "feedback" in self.tables:
            known = ranking.popularity(self._of("feedback"), self.as_of)
            boost = F.when(F.col("popularity") > 0, 1 + F.log1p("popularity")).otherwise(1.0)
            hits = hits.join(known, "turn_id", "left").select("turn_id", (F.col("score") * boost).alias("score"))
        best = hits.orderBy(F.desc("score"), "turn_id").limit(limit)
        shown = self._of("turns").select("turn_id", "session_id", F.coalesce("gist", F.left("content", F.lit(200))).alias("preview"))
        return best.join(shown, "turn_id").orderBy(F.desc("score"), "turn_id")

    def global_search(self, query: str, limit: int = 20) -> DataFrame:
        """Hits of a search, then turns that hold the query's identifier literally."""
        found = self.search(query, limit).select(F.col("turn_id").alias("id"), "score")
        corpus = self._mine("turns").select(F.col("turn_id").alias("id"), F.col("content").alias("text"))
        return history.global_search(corpus.sparkSession, corpus, found, query, limit)

    def expand(self, turn_ids: list[int]) -> DataFrame:
        return self._mine("turns").filter(F.col("turn_id").isin(turn_ids)).orderBy(F.asc_nulls_last("ts"), "turn_id")

    def rate(self, turn_id: int, up: bool, ts: str) -> DataFrame:
        """The feedback table with a rating."""
        row = self._probes("r").select(F.lit(turn_id).cast("long").alias("turn_id"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(up).alias("up"))
        none = row.limit(0).select("turn_id", "ts", F.lit("").alias("query"), F.col("ts").alias("shown_ts"))
        return self._of("feedback").unionByName(upkeep.feedback_rows(row, none).select("turn_id", "ts", "weight"))

    def session_export(self, session_id: str, budget: int = 100_000, full: bool = False, offset: int = 0, limit: int = 500) -> DataFrame:
        """(idx, role, shown) of a session's turns, by page, as far as the budget of characters goes."""
        shown = F.col("content") if full else F.coalesce("gist", F.left("content", F.lit(200)))
        page = self._mine("turns").filter(F.col("session_id") == session_id).select("session_id", "idx", "role", shown.alias("shown")).orderBy("idx").offset(offset).limit(limit)
        return retrieval.disclose(page, budget, [F.asc("idx")], F.length("shown"), ["session_id"]).select("idx", "role", "shown").orderBy("idx")

    def resume(self, query: str, limit: int = 5) -> DataFrame:
        """(session_id, best_id, best_score, match_count): the sessions of the best hits."""
        hits = self.search(query, 20).select("session_id", F.col("turn_id").alias("id"), "score")
        return retrieval.best_per_session(hits).orderBy(F.desc("best_score"), F.desc("match_count"), "session_id").limit(limit)

    find_sessions = resume

    # --- sessions ---------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        """(name, n): rows of every table there is."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in self.tables.items()]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.orderBy("name")

    def sessions(self, limit: int = 20) -> DataFrame:
        last = self._of("turns").groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("turns"))
        return self._sessions().join(last, "session_id", "left").orderBy(F.desc_nulls_last("last_ts"), "session_id").limit(limit)

    def errors(self, tool: str | None = None, limit: int = 20) -> DataFrame:
        rows = self._mine("tool_calls").filter("is_error")
        rows = rows.filter(F.col("tool_name") == tool) if tool else rows
        return rows.select("session_id", "session_project", "tool_name", F.left("tool_output", F.lit(1000)).alias("preview"), "ts").orderBy(F.desc("ts"), "session_id").limit(limit)

    def files(self, needle: str, limit: int = 50) -> DataFrame:
        rows = self._mine("file_touches").filter(F.contains(F.lower("file_path"), F.lit(needle.lower())))
        return rows.select("file_path", "op", "session_id", "session_project", "ts").orderBy(F.desc("ts"), "file_path").limit(limit)

    def summary(self, query: str, limit: int = 10) -> DataFrame:
        return history.summary_search(self._of("summaries").filter(self.scope.predicate("project")), query, limit)

    def observations(self, query: str, limit: int = 20) -> DataFrame:
        found = retrieval.any_token_matches(self._of("observations").filter(self.scope.predicate("project")), query, F.concat_ws(" ", "title", "subtitle"))
        return found.orderBy(F.desc("match_count"), F.desc("ts"), "title").limit(limit)

    def handoff(self, project: str, current: str | None = None) -> DataFrame:
        return history.handoff(self._of("summaries"), self._of("observations"), project, current)

    def restore(self, backup: DataFrame, live: DataFrame) -> DataFrame:
        return history.restorable(live, backup)

    def workspaces(self) -> DataFrame:
        return self._of("workspaces").orderBy("name")

    # --- names ------------------------------------------------------------------------------------

    def check_name(self, names: str | DataFrame, kind: str = "auto", parent: str = "") -> DataFrame:
        """(probe, domain, name, score, status) over the domains that have a table, in their fixed order: the
        first with a hit decides. A field of another model than ``parent`` is a typo; ``kind`` asks one domain.

        A page is asked for by its kind only.
        """
        probes = self._probes(names)
        of = probes.withColumn("model", F.lit(parent))
        named = lambda table, column="name": lambda: resolve.resolve_names(probes, self._of(table).select(F.col(column).alias("name")).distinct(), limit=1)
        exports = lambda: resolve.resolve_exports(probes.withColumn("package", F.lit(parent)), self._of("exports").select("package", "name"), limit=1)
        domains = {
            "env": ("env", lambda: resolve.resolve_env(probes, self._of("env"), limit=1)),
            "db-field": ("fields", lambda: resolve.resolve_fields(of, self._of("fields"), limit=1)),
            "db-model": ("fields", named("fields", "model")),
            "route": ("routes", lambda: resolve.resolve_routes(probes.withColumn("method", F.lit("GET")), self._of("routes"), limit=1)),
            "gql-field": ("gql_fields", lambda: resolve.resolve_fields(of, self._of("gql_fields"), limit=1)),
            "gql-type": ("gql_fields", named("gql_fields", "model")),
            "flag": ("flags", lambda: resolve.resolve_env(probes, self._of("flags"), limit=1)),
            "css-class": ("css", named("css")),
            "i18n-key": ("i18n", named("i18n")),
            "module-export": ("exports", exports),
            "symbol": ("symbols", named("symbols")),
            "name": ("names", named("names")),
        }
        if kind == "page":
            return resolve.check_names({"page": resolve.check_new_pages(probes, self._of("pages"), limit=1)}, probes)
        asked = [d for d, (table, _) in domains.items() if kind in (d, "auto") and table in self.tables]
        return resolve.check_names({d: domains[d][1]() for d in asked}, probes)

    def resolve_symbol(self, names: str | DataFrame, limit: int = 5) -> DataFrame:
        return resolve.resolve_symbols(self._probes(names), self._of("symbols"), limit=limit)

    def resolve_route(self, path: str | DataFrame, method: str = "*") -> DataFrame:
        return resolve.resolve_routes(self._probes(path, method=method), self._of("routes"))

    def check_new_page(self, path: str | DataFrame) -> DataFrame:
        return resolve.check_new_pages(self._probes(path), self._of("pages"))

    def check_env_var(self, names: str | DataFrame, **options: object) -> DataFrame:
        return resolve.resolve_env(self._probes(names), self._of("env"), **options)

    def check_flag(self, names: str | DataFrame) -> DataFrame:
        return resolve.resolve_env(self._probes(names), self._of("flags"))

    def check_db_field(self, name: str | DataFrame, model: str = "") -> DataFrame:
        return resolve.resolve_fields(self._probes(name, model=model), self._of("fields"))

    def check_gql_field(self, name: str | DataFrame, model: str = "") -> DataFrame:
        return resolve.resolve_fields(self._probes(name, model=model), self._of("gql_fields"))

    def resolve_semantic(self, intent: str, limit: int = 10, embed: Callable[[DataFrame], DataFrame] | None = None, where: Column | None = None) -> DataFrame:
        """(name, kind, path, score): symbols nearest to an intent in words."""
        known = self._of("symbols").withColumn("id", F.shiftright(F.xxhash64("name", "kind", "path"), 2))
        spaced = F.regexp_replace(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2"), "_", " ")
        corpus = known.withColumn("text", code.embedding_text(spaced, F.col("kind"), F.regexp_replace("path", r"[^A-Za-z]+", " ")))
        asked = self._probes("q").select(F.lit(0).cast("long").alias("query_id"), F.lit(intent).alias("text"))
        hits = upkeep.semantic_search(corpus, asked, limit, embed, where)
        return hits.join(known, "id").select("name", "kind", "path", "score").orderBy(F.desc("score"), "name")

    def lint_proposed_edit(self, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(issues, verdicts) of edits (doc, path, text): the names that they use, by domain, in what is known."""
        used = lint.references(edits, "env", "flag").unionByName(lint.called_names(edits))
        issues = lint.ground(used.filter("domain = 'symbol'"), self._of("symbols").select(F.lit("symbol").alias("domain"), "name"))
        for domain, table in (("env", "env"), ("flag", "flags")):
            if table in self.tables:
                issues = issues.unionByName(grounding.STRATEGIES[domain](used.filter(F.col("domain") == domain).select("doc", "name"), self._of(table)))
        return issues, lint.verdicts(issues)

    def rewrite_proposed_edit(self, texts: DataFrame, probes: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(texts, log): texts (doc, text) with the names of ``probes`` replaced by the surest known names."""
        return grounding.apply_rewrites(texts, resolve.rewrite(probes, self._of("symbols").select("name")), blacklist)

    # --- pages of registries ----------------------------------------------------------------------

    def _page(self, table: str, needle: str | None, limit: int, offset: int, **equal: str) -> DataFrame:
        rows = self._of(table)
        return upkeep.browse(rows, [F.asc(c) for c in sorted(rows.columns)], limit, offset, needle, **equal)

    def symbols(self, needle: str | None = None, limit: int = 50, offset: int = 0, **equal: str) -> DataFrame:
        return self._page("symbols", needle, limit, offset, **equal)

    def routes(self, needle: str | None = None, limit: int = 50, offset: int = 0, **equal: str) -> DataFrame:
        return self._page("routes", needle, limit, offset, **equal)

    def pages(self, needle: str | None = None, limit: int = 50, offset: int = 0, **equal: str) -> DataFrame:
        return self._page("pages", needle, limit, offset, **equal)

    def env_vars(self, needle: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """(name, sources, declared) of variables, each once."""
        return upkeep.browse(self._collapsed("env"), [F.desc("declared"), F.asc("name")], limit, offset, needle)

    def feature_flags(self, needle: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return upkeep.browse(self._collapsed("flags"), [F.desc("declared"), F.asc("name")], limit, offset, needle)

    def _collapsed(self, table: str) -> DataFrame:
        return self._of(table).groupBy("name").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max(F.col("source").isin(*resolve.CANONICAL)).alias("declared"))

    def db_models(self) -> DataFrame:
        """(model, fields): models with the number of their fields, none included."""
        return self._of("fields").groupBy("model").agg(F.count("name").alias("fields")).orderBy("model")

    def db_fields(self, model: str) -> DataFrame:
        return self._of("fields").filter(F.col("model") == model).orderBy("name")

    def gql_types(self) -> DataFrame:
        return self._of("gql_fields").groupBy("model").agg(F.count("name").alias("fields")).orderBy("model")

    def gql_fields(self, model: str) -> DataFrame:
        return self._of("gql_fields").filter(F.col("model") == model).orderBy("name")

    def topics(self, limit: int = 20) -> DataFrame:
        """(topic, turns): the topics of user turns, most frequent first."""
        rows = self._mine("turns").filter("role = 'user'").select(text.topic(F.col("content")).alias("topic")).filter("topic <> ''")
        return rows.groupBy("topic").agg(F.count("*").alias("turns")).orderBy(F.desc("turns"), "topic").limit(limit)
