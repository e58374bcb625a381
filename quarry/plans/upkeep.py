"""Stores, registries, grounding strategies and ingest as queries, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import grounding, history, resolve, retrieval, tables, upkeep
from quarry.plans.search import _SCORED_LEX, _TOK, _grams, _jac
from quarry.session import kept, load
from quarry.sources import code, documents, lexer, transcripts, walks

AS_OF = "2024-01-31 00:00:00"
_URL_PATH = r"^[a-z]+://[^/]+([^?#]*)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events")


# --- stores ---------------------------------------------------------------------------------------


def replace_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status, those of status F delivered anew without the cheap ones."""
    old = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return upkeep.replace_groups(old, old.filter("o_orderstatus = 'F' and o_totalprice > 100000"), ["o_orderstatus"])


def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    gone = load(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return upkeep.delete_keys(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


def update_from_values(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of customers replaced by those of the suppliers of the same key, where there are any."""
    values = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return tables.update_from(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), values, ["c_custkey"], ["c_acctbal"])


def id_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    names = load(spark, sf, "supplier").select("s_name").unionByName(load(spark, sf, "customer").select(F.col("c_name").alias("s_name")))
    prefixes = names.select(F.left("s_name", F.lit(17)).alias("prefix")).unionByName(names.select(F.concat(F.left("s_name", F.lit(16)), F.lit("x")).alias("prefix")))
    return upkeep.by_prefix(names, prefixes, "s_name", 17)


def durations(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ["d", "H", "m", "s", "w", ""])), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, sf).select("event_id", upkeep.duration_seconds(F.concat((F.col("event_id") % 90).cast("string"), unit)).alias("seconds"))


def mapped_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The nations of each customer and the next ones, looked up in a map that lacks every third."""
    lists = load(spark, sf, "customer").select("c_custkey", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("NATION_"), (F.col("c_nationkey") + i).cast("string"))).alias("names"))
    mapping = load(spark, sf, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    out = upkeep.mapped_lists(lists, "c_custkey", "names", mapping)
    return out.select("c_custkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join("orphans", ",").alias("orphans"))


def vector_ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", upkeep.uuid5(F.col("url")).alias("id"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Per-item status of a delivery: vectors of a store that has every second, with other values for some,
    none for some."""
    v = load(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("name"), F.col("embedding").alias("vector"), "vec_id")
    store = v.filter("vec_id % 2 = 0").withColumn("id", upkeep.uuid5(F.col("name"))).select("id", "name", "vector")
    new = v.withColumn("vector", F.when(F.col("vec_id") % 5 == 0, F.transform("vector", lambda x: x + 1)).when(F.col("vec_id") % 7 == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    _, status = upkeep.upsert_vectors(store, new.select("name", "vector"), 64)
    return status.select("name", "status")


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation by their number, ranked again by how often they have a letter; short ones
    have no score."""
    t = load(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), (-F.col("turn")).cast("double").alias("score"), "text")
    seen = F.when(F.length("text") > 100, F.length("text") - F.length(F.replace("text", F.lit("e"))))
    return upkeep.rerank(t, seen).select("query_id", "id", "place")


def semantic_top5(spark: SparkSession, sf: str) -> DataFrame:
    """Texts nearest to each benchmark item by hashed vectors, no model at hand."""
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = upkeep.semantic_search(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), items, 5)
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def straggler_shard(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("done")), "doc_id", "left")
    return upkeep.stragglers(rows, "done", 1, 3, "doc_id").select("doc_id")


# --- caches, feedback, outcomes -------------------------------------------------------------------


def cache_after_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of the last event of each user, in which some keys are looked up."""
    e = _events(spark, sf)
    cache = e.groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("last_used"))
    _, after = upkeep.cache_lookup(cache, spark.range(0, 10).select((F.col("id") * 3).alias("key")), "2024-03-01 00:00:00", 40)
    return after.select("key", "value", F.unix_micros("last_used").alias("last_used"))


def feedback_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    ratings = e.filter("event_type in ('purchase', 'error')").select(F.col("user_id").alias("turn_id"), "ts", (F.col("event_type") == "purchase").alias("up"))
    openings = e.filter("event_type = 'click'").select(F.col("user_id").alias("turn_id"), "ts", F.concat(F.lit("q"), F.col("event_id") % 50).alias("query"), (F.col("ts") - F.expr("make_interval(0, 0, 0, 0, 0, 0, event_id % 400)")).alias("shown_ts"))
    rows = upkeep.feedback_rows(ratings, openings)
    return rows.select("turn_id", F.unix_micros("ts").alias("at"), "weight", "kind", F.coalesce("query", F.lit("")).alias("query"))


def outcome_analytics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(F.col("event_type").alias("strategy"), F.when(F.col("value") > 100, "REPLACE").otherwise("RESIDUAL").alias("verdict"), F.concat(F.lit("d"), F.col("user_id") % 4).alias("domain"))
    return upkeep.outcome_analytics(rows).withColumn("share", F.round("share", 6))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled pairs for a ranker: the 50 best texts of each query, with features of the pair; a pair is good
    if the text has nine tenths of the query's words."""
    corpus = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = load(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    hits = kept(retrieval.bm25_top_k(corpus, asked, 50))
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    of = lambda df, name: df.select(*[c for c in df.columns if c != "text"], F.array_distinct(text.tokens(F.col("text"))).alias(name))
    pairs = hits.join(F.broadcast(best), "query_id").join(of(asked, "q"), "query_id").join(of(corpus.join(hits.select("id").distinct(), "id", "left_semi"), "d"), "id")
    overlap = F.size(F.array_intersect("q", "d")) / F.size("q")
    return pairs.select("query_id", "id", F.round(F.col("score") / F.col("top"), 6).alias("bm25"), F.round(overlap, 6).alias("overlap"), (overlap >= 0.9).cast("double").alias("label"))


def bench_corpus(spark: SparkSession, sf: str) -> DataFrame:
    texts = load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return upkeep.corpus_for_bench(texts, texts.filter("id % 100 = 1").select("id"), 50).select("id")


# --- versions, repositories, checks ---------------------------------------------------------------


def changelog_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", upkeep.one_line(F.col("text")).alias("line"))


def recorded_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as versions, those of a segment known already, recorded twice."""
    rows = load(spark, sf, "customer").select(F.concat(F.lit("v"), F.col("c_custkey") % 200).alias("version"), F.col("c_name").alias("line"), "c_mktsegment")
    known = tables.latest(rows.filter("c_mktsegment = 'FURNITURE'"), ["version"], [F.asc("line")]).select("version", "line")
    return upkeep.record_versions(upkeep.record_versions(known, rows), rows)


def what_shipped(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").filter("o_orderstatus = 'O'")
    sections = orders.select(F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("ts"), F.concat("o_orderpriority", F.lit(". more text")).alias("text"))
    commits = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version"), F.concat(F.lit("c"), "l_linenumber").alias("sha"))
    return upkeep.what_shipped(sections, commits, 20).select("version", "line", "commits")


def release_digest(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "conversations").select(F.col("conv_id").alias("repo"), F.col("turn").cast("string").alias("name"), F.col("turn").alias("mtime"), "text")
    return upkeep.release_digest(files, 1200, ["repo"]).select("repo", "name")


def repo_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories of users, moved by their purchases, without those long unseen."""
    e = _events(spark, sf)
    path = F.concat(F.lit("/r/"), F.col("user_id"), F.lit("/"), F.col("event_id") % 5)
    repos = e.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("repo_id")).agg(F.min_by(path, "event_id").alias("path"), F.max("ts").alias("last_seen"))
    moves = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("repo_id"), path.alias("path"), "ts")
    present = e.filter("event_type = 'view'").select(path.alias("path"))
    return upkeep.prune(upkeep.rebind(repos, moves), present, AS_OF, 3).select("repo_id", "path", F.unix_micros("last_seen").alias("last_seen"))


def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    names = load(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return upkeep.schema_diff(names.filter("n_nationkey > 3"), names.filter("n_nationkey < 20"))


def lost_data(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.count("*").alias("n"))
    return upkeep.lost_data(counts, load(spark, sf, "supplier").select(F.col("s_nationkey").alias("name")), 60)


def browse_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").select(F.col("p_name").alias("name"), "p_partkey", F.col("p_type").alias("kind"))
    return upkeep.browse(rows, [F.asc("name"), F.asc("p_partkey")], 20, 10, "WIDGET", kind="ECONOMY")


def utility_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Words of parts' names as classes: with a size, as a colour, with a variant known or not, in brackets, alone."""
    size = F.col("p_size").cast("string")
    word = F.lower(F.element_at(F.split("p_name", " "), 1))
    forms = F.array(word, F.concat(F.lit("mt-"), size), F.concat(F.lit("md:hover:bg-"), word, F.lit("-500")), F.concat(word, F.lit(":flex")), F.concat(word, F.lit("-["), size, F.lit("px]")), F.concat(F.lit("table-"), word), F.concat(F.lit("-p-"), size))
    names = load(spark, sf, "part").select(F.explode(forms).alias("name")).distinct()
    return names.select("name", upkeep.is_utility_class(F.col("name")).alias("utility"))


def file_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return tables.fingerprint(load(spark, sf, "documents").select(F.col("doc_id").alias("mtime"), F.col("n_chars").alias("size")))


def file_corruption(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: some zeroed in part or whole, some cut."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("whole"))
    zeros = F.unhex(F.repeat(F.lit("00"), F.octet_length("whole")))
    content = F.when(F.col("doc_id") % 7 == 0, zeros).when(F.col("doc_id") % 7 == 1, F.concat("whole", zeros)).when(F.col("doc_id") % 7 == 2, F.substring("whole", 1, 20)).otherwise(F.col("whole"))
    return d.select("doc_id", tables.corruption(content, F.octet_length("whole"), F.col("doc_id") % 14 == 1).alias("state"))


def stub_files(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "conversations").filter("turn = 0")
    line = F.to_json(F.struct(F.when(F.col("conv_id") % 3 == 0, "ai-title").otherwise("user").alias("type"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).otherwise("x").alias("sessionId")))
    files = t.select(F.concat(F.lit("/t/"), "conv_id", F.lit(".jsonl")).alias("path"), F.length(line).alias("length"), line.alias("text"))
    return history.stub_transcripts(files)


def rule_digests(spark: SparkSession, sf: str) -> DataFrame:
    found = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Some words\nFixed: "), F.substring("text", 1, 30))).otherwise(F.col("text"))
    t = load(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "role", F.col("turn").alias("idx"), found.alias("content"))
    return history.rule_digest(t)


def summary_search(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.coalesce("text", F.lit("")).alias("request"), *[F.lit("").alias(c) for c in history.SUMMARY_FIELDS[1:]], (F.col("doc_id") % 100).alias("generated_at"))
    return history.summary_search(d, "worthless heron stable", 25).select("session_id")


def blacklist_probe(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return asked.join(load(spark, sf, "part").filter("p_size > 45").select(F.col("p_name").alias("name")).distinct(), "name", "left_semi")


# --- names and grounding --------------------------------------------------------------------------


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("url", _URL_PATH, 1).alias("path"), F.regexp_extract("url", "^([a-z]+)", 1).alias("scheme"))


_ROUTES = [("GET", "/en/:page"), ("POST", "/fr/:page"), ("*", "/de/*"), ("GET", "/es/1")]


def resolve_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' paths, their scheme as verb, against routes: exact, by pattern, or alike."""
    probes = _paths(spark, sf).select(F.col("path").alias("probe"), F.when(F.col("scheme") == "https", "GET").otherwise("POST").alias("method")).distinct()
    found = resolve.resolve_routes(probes, spark.createDataFrame(_ROUTES, "method string, name string"), 0.3, 3)
    return found.select("probe", "name", F.round("score", 6).alias("score"), "layer", "place")


def resolve_env(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names as variables, declared or used by their type; asked for as they are and with a letter lost."""
    name = F.upper(F.translate("p_name", " ", "_"))
    source = F.when(F.col("p_size") % 2 == 0, "env-example").when(F.col("p_size") % 3 == 0, "compose").otherwise("source-read")
    declared = load(spark, sf, "part").select(name.alias("name"), source.alias("source"))
    probes = _misspelt(declared.select("name"))
    return resolve.resolve_env(probes, declared, 0.5, 2, ["compose"]).select("probe", "name", "source", F.round("score", 6).alias("score"), "layer", "place")


def resolve_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by name, by a supplier of theirs as an alias, or by a name with a letter lost."""
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = s.groupBy(F.col("n_name").alias("name")).agg(F.collect_set("s_name").alias("aliases"))
    probes = s.select(F.col("s_name").alias("probe")).unionByName(_misspelt(s.select(F.col("n_name").alias("name")))).distinct()
    return resolve.resolve_names(probes, names, 0.5, 3).select("probe", "name", F.round("score", 6).alias("score"), "layer", "place")


def _misspelt(names: DataFrame) -> DataFrame:
    """(probe): names as they are and without their second letter."""
    lost = F.concat(F.substring("name", 1, 1), F.substring("name", 3, 100))
    return names.select(F.explode(F.array("name", lost)).alias("probe")).distinct()


def _fields_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts as models, names of the smaller ones as their fields."""
    return load(spark, sf, "part").filter("p_size <= 10").select(F.col("p_type").alias("model"), F.col("p_name").alias("name")).distinct()


def resolve_db_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every model is asked for every field, as it is and with a letter lost: all four layers answer."""
    part = load(spark, sf, "part")
    probes = part.select(F.col("p_type").alias("model")).distinct().crossJoin(F.broadcast(_misspelt(part.select(F.col("p_name").alias("name")))))
    found = resolve.resolve_fields(probes, _fields_of_parts(spark, sf), 0.5, 4)
    return found.select("probe", "model", "name", F.round("score", 6).alias("score"), "layer", "place")


def lint_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Edits that use a field of a model: one that it has or another has, a misspelt one, one of an unknown model."""
    lost = F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 100))
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, lost).otherwise(F.concat(F.lit("qq"), F.col("p_partkey") % 7))
    used = load(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.when(F.col("p_size") > 45, "NOWHERE").otherwise(F.col("p_type")).alias("model"), name.alias("name"))
    return grounding.models(used, _fields_of_parts(spark, sf)).withColumn("confidence", F.round("confidence", 6))


def resolve_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as packages that export the names of their smaller parts; each is asked for all names."""
    part = load(spark, sf, "part")
    exports = part.filter("p_size < 20").select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"))
    probes = part.select(F.col("p_brand").alias("package")).distinct().crossJoin(F.broadcast(_misspelt(part.select(F.col("p_name").alias("name")))))
    found = resolve.resolve_exports(probes.select("probe", "package"), exports.distinct(), 0.5)
    return found.select("probe", "package", "name", F.round("score", 6).alias("score"), "layer", "place")


def lint_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the pages' URLs, by scheme as verb."""
    calls = load(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.when(F.col("url").startswith("https"), "GET").otherwise("POST").alias("method"), F.col("url").alias("name"))
    known = spark.createDataFrame([*_ROUTES, ("GET", "/zzzzzzzz")], "method string, name string").filter("name <> '/es/1'")
    return grounding.routes(calls, known).select("doc", "severity", "candidate", F.round("confidence", 6).alias("confidence"))


def lint_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _paths(spark, sf)
    asked = pages.filter("page_id % 2 = 0 and path <> ''").select(F.col("page_id").alias("doc"), F.col("path").alias("name"))
    known = pages.filter("page_id % 2 = 1").select(F.col("path").alias("name")).unionByName(spark.createDataFrame([("/de/:page",)], "name string"))
    return grounding.new_pages(asked, known).select("doc", "severity", "candidate", F.round("confidence", 6).alias("confidence"))


def lint_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Parts import names, some with a letter lost, from brands that export those of their smaller parts."""
    part = load(spark, sf, "part")
    exports = part.filter("p_size < 20").select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"))
    lost = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 100))).otherwise(F.col("p_name"))
    asked = part.select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("package"), lost.alias("name"))
    return grounding.imports(asked, exports).select("doc", "name", "severity", "candidate", F.round("confidence", 6).alias("confidence"))


def lint_assets(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("name"), "p_size")
    return grounding.assets(part, part.filter("p_size < 10")).select("doc", "name", "severity", "confidence")


def prose_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return grounding.phrases(load(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))


def lint_prose(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of all texts, and these with their last two letters lost, against the phrases of even documents."""
    found = prose_phrases(spark, sf)
    used = found.unionByName(found.select("doc", F.expr("left(name, length(name) - 2)").alias("name")))
    return grounding.prose(used, found.filter("doc % 2 = 0")).select("doc", "name", "severity", "candidate", F.round("confidence", 6).alias("confidence"))


_STAR = [("Query", "customer", "Customer!"), ("Customer", "name", "String"), ("Customer", "acctbal", "Float"), ("Customer", "nation", "Nation!"), ("Customer", "orders", "[Order!]!"),
         ("Nation", "name", "String"), ("Nation", "region", "Region"), ("Region", "name", "String"), ("Order", "total", "Float"), ("Order", "customer", "Customer")]


def _star(spark: SparkSession) -> DataFrame:
    """The fields of the star's types."""
    return spark.createDataFrame(_STAR, "model string, name string, type string")


#: Rows of which a task makes and walks texts: reading the keys takes no time, walking the texts does.
_WALKED_ROWS = 20_000


def _dealt(rows: DataFrame) -> DataFrame:
    """Short rows in so many parts as walking the texts made of them asks for."""
    return rows.repartition(max(1, -(-rows.count() // _WALKED_ROWS)))


def lint_selections(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as edits with a query of nested selections, aliases and an inline fragment; some misspell a field."""
    key = F.col("c_custkey")
    balance, region = F.when(key % 3 == 0, "accbal").otherwise("acctbal"), F.when(key % 5 == 0, "zone { zzz }").otherwise("region { name }")
    body = F.concat(F.lit("const q = gql`query Q($id: ID = \"}\") { c: customer(id: $id, like: {zzz: 1}) { name # zzz\n b: "), balance, F.lit(" ... on Customer { nation @include(if: true) { name "), region, F.lit(" } } orders { "), F.concat(F.lit("t"), key % 4), F.lit(" customer { nation { name } } } } }`"))
    texts = _dealt(load(spark, sf, "customer").select("c_custkey")).select(key.alias("doc"), body.alias("text"))
    star = _star(spark)
    found = grounding.graphql(walks.typed(walks.query_fields(texts), star), star)
    return found.withColumn("confidence", F.round("confidence", 6))


def lint_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as edits that call a model with nested conditions and selections; some misspell or miss a model."""
    key = F.col("o_orderkey")
    model, name = F.when(key % 7 == 0, "ordr").otherwise("order"), F.when(key % 3 == 0, "nme").otherwise("name")
    body = F.concat(F.lit("// prisma.order.count({ where: { zzz: 1 } })\nawait prisma."), model, F.lit(".findMany({ take: 5, where: { AND: [{ total: { gt: '}' } }, { customer: { is: { nation: { "), name, F.lit(": 'x' } } } }] }, include: { customer: { select: { acctbal: true, \"orders\": { where: { totl: 1 } } } } } })"))
    texts = _dealt(load(spark, sf, "orders").select("o_orderkey")).select(key.alias("doc"), body.alias("text"))
    star = _star(spark)
    found = grounding.models(walks.typed(walks.call_fields(texts), star), star)
    return found.withColumn("confidence", F.round("confidence", 6))


_SOURCES = {
    "ts": "// class Hidden { no() {} }\nexport class T{k} {\n  m{s}(a: number) { return \"} class No {\" }\n}\nfunction f{k}() { /* } */ }\n",
    "go": "package p // func hidden() {\ntype T{k} struct { s string }\nfunc (t *T{k}) m{s}(a int) string { return `func no() {` }\n\nfunc f{k}() {}\n",
    "py": "# class Hidden:\nclass T{k}:\n    def m{s}(self, a): return 'def no(): {'\n\ndef f{k}(): pass\n",
}


def _source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as source files in three languages: a class, its method and a function, and what only looks like them."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "ts").when(F.col("p_partkey") % 3 == 1, "go").otherwise("py")
    text_ = F.coalesce(*[F.when(kind == e, F.lit(t)) for e, t in _SOURCES.items()])
    text_ = F.replace(F.replace(text_, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    return load(spark, sf, "part").select(F.concat(F.lit("/r/"), "p_partkey", F.lit("."), kind).alias("path"), text_.alias("text"))


def lexed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return lexer.symbols(_source_files(spark, sf)).select("path", "name", "kind", F.coalesce("parent", F.lit("")).alias("parent"), "line")


def lint_members(spark: SparkSession, sf: str) -> DataFrame:
    """Edits that call the methods of parts' classes: the right one, one of no class, and one of another library's class."""
    body = F.concat(F.lit("const t = new T"), "p_partkey", F.lit("(1)\nt.m"), "p_size", F.lit("(2); t.qqqq(); Math.max(1) // t.no()"))
    edits = load(spark, sf, "part").select(F.concat("p_partkey", F.lit(".ts")).alias("path"), body.alias("text"))
    found = grounding.members(lexer.member_calls(edits), lexer.members(lexer.symbols(_source_files(spark, sf))))
    return found.select("doc", "name", "severity", "confidence")


def file_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' paths as files of an application, and the routes that these serve."""
    path = F.concat(F.lit("pages"), F.regexp_replace("path", "[0-9]+", "[id]"), F.when(F.col("page_id") % 2 == 0, ".tsx").otherwise(".css"))
    return _paths(spark, sf).filter("path rlike '^/[a-z].*[^/]$'").select("page_id", code.page_route(path).alias("route"))


def dotenv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as environment files: a comment and an assignment a turn."""
    line = F.concat(F.lit("# about turn "), "turn", F.lit("\nexport API_"), F.when(F.col("turn") % 2 == 0, "TOKEN").otherwise("URL"), F.lit("_"), "turn", F.lit("=\""), F.substring(F.translate("text", "\"\n\r#", "    "), 1, 20), F.lit("\""))
    files = load(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "\n").alias("text"))
    return code.dotenv(files).select("path", "line", "name", "value", "comment", "secret")


def changelog_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as changelogs: a version each, turns as bullets under two headings."""
    rows = F.concat(F.when(F.col("turn") % 2 == 0, "### Added\n").otherwise("### Fixed\n"), F.lit("- "), F.translate("text", "\n", " "))
    text_ = F.concat(F.lit("## [1."), F.first("conv_id").cast("string"), F.lit("]\n"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", rows.alias("r"))))["r"], "\n"))
    docs = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(text_.alias("text"))
    return documents.changelog_sections(docs)


def user_prompt_view(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as turns of customers as sessions: the view of prompts with their session, newest first."""
    o = load(spark, sf, "orders").filter("o_orderstatus = 'O'")
    joined = o.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "c_name", "c_mktsegment", F.unix_micros("o_orderdate").alias("at"))


# --- transcripts ----------------------------------------------------------------------------------


def _transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as lines of transcripts: a turn each, texts as they are or in a block, and a broken line."""
    t = load(spark, sf, "conversations").filter("role in ('user', 'assistant')")
    content = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"), "role"))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role")))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","timestamp":"2024-01-01T00:00:00Z","message":'), content, F.lit("}"))
    path = F.concat(F.lit("/t/-home-al-projects-demo/"), "conv_id", F.lit(".jsonl"))
    rows = t.select(path.alias("path"), F.col("turn").cast("int").alias("line_no"), line.alias("value"))
    return rows.unionByName(rows.filter("line_no = 0").select("path", (F.col("line_no") - 1).alias("line_no"), F.lit("{broken").alias("value")))


def ingest_turns(spark: SparkSession, sf: str) -> DataFrame:
    made = transcripts.turns(transcripts.blocks(transcripts.parse_lines(_transcripts(spark, sf))))
    return made.select("session_id", "project", "line_no", "idx", "role", "content_type", F.md5("content").alias("content_md5"))


def ingest_damage(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.damaged(transcripts.parse_lines(_transcripts(spark, sf)))


def ingest_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Lines past each session's cursor, where every third session has one."""
    lines = _transcripts(spark, sf)
    cursors = load(spark, sf, "conversations").filter("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("session_id"), F.lit(1).alias("line_no")).distinct()
    return transcripts.after_cursor(lines, cursors).select("path", "line_no")


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tool calls: writes, edits and reads of files of users, with the answers of some."""
    e = load(spark, sf, "events")
    name = F.when(F.col("event_type") == "signup", "Write").when(F.col("event_type") == "view", "Edit").otherwise("Read")
    given = F.struct(F.concat(F.lit("/r/"), F.col("user_id") % 20, F.lit(".ts")).alias("file_path"), F.concat("event_type", F.lit(" text")).alias("content"), F.lit("text").alias("old_string"), F.lit("new text").alias("new_string"))
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), "event_id").alias("id"), name.alias("name"), given.alias("input"))).alias("content")).alias("message")))
    answer = F.to_json(F.struct(F.lit("user").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), "event_id").alias("tool_use_id"), F.lit("out").alias("content"), (F.col("event_type") == "error").alias("is_error"))).alias("content")).alias("message")))
    path = F.concat(F.lit("/t/-home-al-projects-demo/"), F.col("user_id") % 7, F.lit(".jsonl"))
    lines = e.select(path.alias("path"), (2 * F.col("event_id")).cast("int").alias("line_no"), use.alias("value")).unionByName(e.filter("event_id % 4 <> 0").select(path.alias("path"), (2 * F.col("event_id") + 1).cast("int").alias("line_no"), answer.alias("value")))
    return transcripts.tool_calls(transcripts.blocks(transcripts.parse_lines(lines)))


def ingest_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("session_id", "call_id", "tool_name", F.coalesce("tool_output", F.lit("")).alias("tool_output"), F.coalesce("is_error", F.lit(False)).alias("is_error"), F.get_json_object("tool_input", "$.file_path").alias("file"))


def file_touches(spark: SparkSession, sf: str) -> DataFrame:
    """How often each session writes or edits each file."""
    return transcripts.file_touches(_calls(spark, sf)).groupBy("session_id", "file_path", "op").agg(F.count("*").alias("n"))


def edit_operations(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.edit_operations(_calls(spark, sf)).select("path", "seq", "op", "new")


def gists_or_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(F.coalesce(text.gist(F.col("text")), F.left("text", F.lit(200)))).alias("shown_md5"))




def _near(probes: str, names: str) -> str:
    """SQL of (probe, name, sim) of all pairs: trigrams by words, Jaccard."""
    return f"SELECT probe, name, {_jac('tp', 'tn')} AS sim FROM (SELECT probe, {_grams('probe')} AS tp FROM ({probes})), (SELECT name, {_grams('name')} AS tn FROM ({names})) WHERE len(tp) > 0 AND len(tn) > 0"


def _lost(names: str) -> str:
    return f"SELECT name AS probe FROM ({names}) UNION SELECT left(name, 1) || substr(name, 3, 100) FROM ({names})"


#: Layers of fields ``f`` for probes ``p``: own, anywhere, like an own one, like one anywhere.
_FIELD_LAYERS = f"""s AS ({_near('SELECT DISTINCT probe FROM p', 'SELECT DISTINCT name FROM f')}),
c AS (SELECT * FROM (SELECT probe, p.model, f.model || '.' || f.name AS name, 1.0::DOUBLE AS score, CASE WHEN f.model = p.model THEN 0 ELSE 1 END AS layer FROM p JOIN f ON name = probe
UNION ALL SELECT probe, p.model, f.model || '.' || name, sim, CASE WHEN f.model = p.model THEN 2 ELSE 3 END FROM p JOIN s USING (probe) JOIN f USING (name) WHERE sim >= 0.5) QUALIFY layer = min(layer) OVER (PARTITION BY probe, model))"""
#: Issues of uses ``u`` (doc, model, probe) of the star's fields.
_STAR_SQL = "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{n}')" for m, n, _ in _STAR) + ") t(model, name))"


def _star_issues(domain: str, no_model: float) -> str:
    return f"""p AS (SELECT DISTINCT model, probe FROM u WHERE model IN (SELECT model FROM f)), {_FIELD_LAYERS},
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY probe, model ORDER BY score DESC, name) = 1)
SELECT doc, '{domain}' AS domain, u.model || '.' || u.probe AS name, CASE WHEN b.layer = 0 THEN 'ok' WHEN b.layer IS NOT NULL THEN 'low' ELSE 'unknown' END AS severity, b.name AS candidate,
round(CASE WHEN u.model NOT IN (SELECT model FROM f) THEN {no_model} WHEN b.layer = 0 THEN 1.0 WHEN b.layer = 1 THEN 0.85 WHEN b.layer IS NOT NULL THEN b.score ELSE 0.9 END::DOUBLE, 6) AS confidence
FROM u LEFT JOIN b ON u.model = b.model AND u.probe = b.probe"""


_P = "regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"
_LINE = r"regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '(?m)^\s*(?:[-*#>]+|\d+\.)\s*', '', 'g'), '[*_`]', '', 'g'), '^\s+|\s+$', '', 'g')"

SQL = {
    "replace_groups": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000",
    "delete_by_key": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "update_from_values": "SELECT c_custkey, c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    "id_prefixes": """WITH n AS (SELECT DISTINCT * FROM (SELECT s_name AS k FROM supplier UNION ALL SELECT c_name FROM customer)),
p AS (SELECT left(k, 17) AS prefix FROM n UNION SELECT left(k, 16) || 'x' FROM n)
SELECT prefix, count(k) AS matches, CASE WHEN count(k) = 1 THEN min(k) END AS found FROM p LEFT JOIN n ON starts_with(k, prefix) GROUP BY prefix""",
    "durations": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 90 * 86400 WHEN 1 THEN event_id % 90 * 3600 WHEN 2 THEN event_id % 90 * 60 WHEN 3 THEN event_id % 90 ELSE 86400 END::BIGINT AS seconds FROM events""",
    "mapped_lists": """SELECT c_custkey, coalesce(string_agg(CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey::VARCHAR END, ',' ORDER BY i), '') AS ids,
coalesce(string_agg(CASE WHEN n_nationkey IS NULL OR n_nationkey % 3 = 0 THEN 'NATION_' || (c_nationkey + i) END, ',' ORDER BY i), '') AS orphans
FROM (SELECT c_custkey, c_nationkey, unnest([0, 1, 2]) AS i FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey + i GROUP BY c_custkey""",
    "vector_ids": """SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id
FROM (SELECT page_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""",
    "vector_upsert": """SELECT 'v' || vec_id AS name, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 = 0 THEN 'failed' WHEN vec_id % 2 <> 0 THEN 'inserted' WHEN vec_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM embeddings""",
    "reranked": """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN scored >= greatest(2, n / 3.0) THEN r END DESC NULLS LAST, id) AS place FROM (
SELECT *, count(r) OVER (PARTITION BY query_id) AS scored, count(*) OVER (PARTITION BY query_id) AS n FROM (
SELECT conv_id AS query_id, turn AS id, CASE WHEN length(text) > 100 THEN length(text) - length(replace(text, 'e', '')) END AS r FROM conversations))""",
    "straggler_shard": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1 AND doc_id % 3 = 1",
    "cache_after_lookup": """SELECT key, value, epoch_us(last_used) AS last_used FROM (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value,
CASE WHEN user_id < 30 AND user_id % 3 = 0 THEN TIMESTAMP '2024-03-01' ELSE max(ts) END AS last_used FROM events GROUP BY user_id) ORDER BY last_used DESC, key LIMIT 40""",
    "feedback_rows": """SELECT user_id AS turn_id, epoch_us(ts) AS at, CASE event_type WHEN 'purchase' THEN 3 ELSE -3 END AS weight, 'explicit' AS kind, '' AS query FROM events WHERE event_type IN ('purchase', 'error')
UNION ALL SELECT user_id, epoch_us(ts), 1, 'implicit', 'q' || event_id % 50 FROM events WHERE event_type = 'click' AND event_id % 400 <= 300
QUALIFY row_number() OVER (PARTITION BY event_id % 50 ORDER BY ts DESC, user_id) <= 20""",
    "outcome_analytics": """SELECT strategy, verdict, n, domains, round(n / sum(n) OVER (PARTITION BY strategy), 6) AS share FROM (SELECT event_type AS strategy, CASE WHEN value > 100 THEN 'REPLACE' ELSE 'RESIDUAL' END AS verdict,
count(*) AS n, array_to_string(list_sort(list(DISTINCT 'd' || user_id % 4)), ',') AS domains FROM events GROUP BY 1, 2)""",
    "bench_corpus": """WITH t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)
SELECT id FROM (SELECT id FROM t WHERE length(text) >= 80 ORDER BY length(text) DESC, id LIMIT 50) UNION SELECT id FROM t WHERE id % 100 = 1""",
    "changelog_lines": f"""SELECT doc_id, CASE WHEN length(s) > 200 THEN rtrim(left(s, 199)) || '…' ELSE s END AS line FROM (
SELECT doc_id, regexp_replace(regexp_extract({_LINE.format('text')}, '(?s)^(.*?(?:[.!?](?:\\s|$)|\\n|$))', 1), '^\\s+|\\s+$', '', 'g') AS s FROM documents)""",
    "recorded_versions": """WITH r AS (SELECT 'v' || c_custkey % 200 AS version, c_name AS line, c_mktsegment = 'FURNITURE' AS known FROM customer)
SELECT version, coalesce(min(line) FILTER (known), min(line)) AS line FROM r GROUP BY version""",
    "what_shipped": """SELECT version, line, commits FROM (SELECT o_orderkey AS version, o_orderpriority || '.' AS line, coalesce(array_to_string(list_sort(list(DISTINCT 'c' || l_linenumber) FILTER (l_linenumber IS NOT NULL)), ','), '') AS commits
FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)""",
    "release_digest": """SELECT conv_id AS repo, turn::VARCHAR AS name FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
OR sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1200""",
    "repo_registry": """WITH e AS (SELECT *, '/r/' || user_id || '/' || event_id % 5 AS path FROM events), s AS (SELECT user_id, arg_min(path, event_id) AS path, max(ts) AS seen FROM e WHERE event_type = 'signup' GROUP BY 1),
m AS (SELECT user_id, path AS p, ts AS t FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, path) = 1),
r AS (SELECT user_id AS repo_id, coalesce(p, path) AS path, greatest(seen, t) AS last_seen FROM s LEFT JOIN m USING (user_id))
SELECT repo_id, path, epoch_us(last_seen) AS last_seen FROM r WHERE path IN (SELECT path FROM e WHERE event_type = 'view') OR last_seen >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAY""",
    "schema_diff": "SELECT n_name AS name, CASE WHEN n_nationkey >= 20 THEN 'missing' ELSE 'undeclared' END AS status FROM nation WHERE n_nationkey >= 20 OR n_nationkey <= 3",
    "lost_data": "SELECT c_nationkey AS name, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1 HAVING count(*) < 60",
    "browse_names": "SELECT p_name AS name, p_partkey, p_type AS kind FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'widget') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 10",
    "utility_classes": """WITH p AS (SELECT lower(split_part(p_name, ' ', 1)) AS w, p_size::VARCHAR AS s FROM part),
v AS (SELECT unnest(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', '14', '16', '20', '24', '28', '32', '36', '40', '44', '48']) AS s),
c AS (SELECT unnest(['slate', 'gray', 'zinc', 'neutral', 'stone', 'red', 'orange', 'amber', 'yellow', 'lime', 'green', 'emerald', 'teal', 'cyan', 'sky', 'blue', 'indigo', 'violet', 'purple', 'fuchsia', 'pink', 'rose']) AS w)
SELECT DISTINCT * FROM (SELECT w AS name, false AS utility FROM p UNION ALL SELECT 'mt-' || s, s IN (SELECT s FROM v) FROM p UNION ALL SELECT 'md:hover:bg-' || w || '-500', w IN (SELECT w FROM c) FROM p
UNION ALL SELECT w || ':flex', false FROM p UNION ALL SELECT w || '-[' || s || 'px]', true FROM p UNION ALL SELECT 'table-' || w, false FROM p UNION ALL SELECT '-p-' || s, s IN (SELECT s FROM v) FROM p)""",
    "file_fingerprint": "SELECT count(*) AS n, max(doc_id) AS newest, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents",
    "file_corruption": """SELECT doc_id, CASE WHEN n = 0 THEN 'OK' WHEN doc_id % 7 = 0 THEN 'ZEROED' WHEN doc_id % 7 = 1 AND doc_id % 14 <> 1 THEN 'PARTIAL_ZERO' WHEN doc_id % 7 = 2 AND least(n, 20) < n * 0.5 THEN 'SHRUNK' ELSE 'OK' END AS state
FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""",
    "stub_files": "SELECT '/t/' || conv_id || '.jsonl' AS path FROM conversations WHERE turn = 0 AND conv_id % 6 = 0",
    "rule_digests": """WITH t AS (SELECT conv_id, role, turn, CASE WHEN turn % 3 = 1 THEN 'Some words' || chr(10) || 'Fixed: ' || left(text, 30) ELSE text END AS c FROM conversations),
x AS (SELECT *, left(regexp_extract(trim(c), '^([^\\n]+)', 1), 200) AS line, nullif(regexp_extract(c, '(?im)^[^A-Za-z0-9_]*((?:learned|found|discovered|fixed|turns out|root cause)\\b[^\\n]*)', 1), '') AS f FROM t)
SELECT conv_id AS session_id, arg_min(line, turn) FILTER (role = 'user') AS request, arg_min(f, turn) FILTER (f IS NOT NULL) AS learned FROM x GROUP BY conv_id""",
    "summary_search": "SELECT doc_id AS session_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'heron') OR contains(lower(text), 'stable') ORDER BY doc_id % 100 DESC, doc_id LIMIT 25",
    "blacklist_probe": "SELECT DISTINCT p_name AS name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)",
    "resolve_routes": f"""WITH p AS (SELECT DISTINCT {_P} AS probe, CASE WHEN starts_with(url, 'https') THEN 'GET' ELSE 'POST' END AS method FROM pages),
r AS (SELECT * FROM (VALUES ('GET', '/en/:page', '^/+en/+[^/]+/*$'), ('POST', '/fr/:page', '^/+fr/+[^/]+/*$'), ('*', '/de/*', '^/+de(/.*)?/*$'), ('GET', '/es/1', '^/+es/+1/*$')) t(m, name, rx)),
c AS (SELECT probe, name, 1.0::DOUBLE AS score, 0 AS layer FROM p, r WHERE probe = name AND (method = m OR m = '*')
UNION SELECT probe, name, length(name), 1 FROM p, r WHERE regexp_matches(probe, rx) AND (method = m OR m = '*')
UNION SELECT probe, name, sim, 2 FROM ({_near('SELECT DISTINCT probe FROM p', 'SELECT name FROM r')}) WHERE sim >= 0.3)
SELECT probe, name, round(score, 6) AS score, layer, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS place FROM (SELECT * FROM c QUALIFY layer = min(layer) OVER (PARTITION BY probe)) QUALIFY place <= 3""",
    "resolve_env": f"""WITH d AS (SELECT DISTINCT upper(replace(p_name, ' ', '_')) AS name, CASE WHEN p_size % 2 = 0 THEN 'env-example' WHEN p_size % 3 = 0 THEN 'compose' ELSE 'source-read' END AS source FROM part),
k AS (SELECT * FROM d WHERE source <> 'compose'), p AS ({_lost('SELECT DISTINCT name FROM d')}),
c AS (SELECT probe, name, CASE WHEN probe = name THEN 1.0 ELSE sim END AS score, CASE WHEN probe = name THEN 0 ELSE 1 END AS layer FROM ({_near('SELECT probe FROM p', 'SELECT DISTINCT name FROM k')}) WHERE sim >= 0.5 OR probe = name
QUALIFY layer = min(layer) OVER (PARTITION BY probe))
SELECT probe, name, source, round(score, 6) AS score, layer, row_number() OVER (PARTITION BY probe ORDER BY score DESC, source = 'env-example' DESC, name, source) AS place FROM c JOIN k USING (name) QUALIFY place <= 2""",
    "resolve_aliases": f"""WITH s AS (SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), n AS (SELECT DISTINCT n_name AS name FROM s),
p AS (SELECT s_name AS probe FROM s UNION {_lost('SELECT name FROM n')}),
c AS (SELECT probe, name, 1.0::DOUBLE AS score, 0 AS layer FROM p JOIN n ON probe = name UNION ALL SELECT DISTINCT s_name, n_name, 1.0::DOUBLE, 1 FROM s
UNION ALL SELECT probe, name, sim, 2 FROM ({_near('SELECT probe FROM p', 'SELECT name FROM n')}) WHERE sim >= 0.5)
SELECT probe, name, round(score, 6) AS score, layer, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS place FROM (SELECT * FROM c QUALIFY layer = min(layer) OVER (PARTITION BY probe)) QUALIFY place <= 3""",
    "resolve_db_fields": f"""WITH f AS (SELECT DISTINCT p_type AS model, p_name AS name FROM part WHERE p_size <= 10),
p AS (SELECT DISTINCT p_type AS model, probe FROM part, ({_lost('SELECT DISTINCT p_name AS name FROM part')})), {_FIELD_LAYERS}
SELECT probe, model, name, round(score, 6) AS score, layer, row_number() OVER (PARTITION BY probe, model ORDER BY score DESC, name) AS place FROM c QUALIFY place <= 4""",
    "resolve_exports": f"""WITH f AS (SELECT DISTINCT p_brand AS package, p_name AS name FROM part WHERE p_size < 20), l AS ({_lost('SELECT DISTINCT p_name AS name FROM part')}),
c AS (SELECT p.probe, f.package, f.name, CASE WHEN p.probe = f.name THEN 1.0 ELSE sim END AS score, CASE WHEN p.probe = f.name THEN 0 ELSE 1 END AS layer
FROM l p JOIN ({_near('SELECT probe FROM l', 'SELECT DISTINCT name FROM f')}) s ON s.probe = p.probe JOIN f ON f.name = s.name WHERE sim >= 0.5 QUALIFY layer = min(layer) OVER (PARTITION BY p.probe, f.package))
SELECT probe, package, name, round(score, 6) AS score, layer, row_number() OVER (PARTITION BY probe, package ORDER BY score DESC, name) AS place FROM c QUALIFY place <= 5""",
    "lint_routes": f"""WITH k AS (SELECT page_id AS doc, starts_with(url, 'https') AS get, CASE WHEN length(q) > 1 THEN regexp_replace(q, '/$', '') ELSE q END AS probe FROM (SELECT *, regexp_replace({_P}, '//+', '/', 'g') AS q FROM pages) WHERE q <> ''),
r AS (SELECT * FROM (VALUES ('GET', '/en/:page', '^/+en/+[^/]+/*$'), ('POST', '/fr/:page', '^/+fr/+[^/]+/*$'), ('*', '/de/*', '^/+de(/.*)?/*$'), ('GET', '/zzzzzzzz', '^/+zzzzzzzz/*$')) t(m, name, rx)),
c AS (SELECT probe, m, name, length(name)::DOUBLE AS score, 1 AS layer FROM (SELECT DISTINCT probe FROM k), r WHERE regexp_matches(probe, rx)
UNION ALL SELECT probe, m, s.name, sim, 2 FROM ({_near('SELECT DISTINCT probe FROM k', 'SELECT name FROM r')}) s JOIN r ON r.name = s.name WHERE sim >= 0.3),
b AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS place FROM (SELECT * FROM c QUALIFY layer = min(layer) OVER (PARTITION BY probe))),
o AS (SELECT doc, coalesce(bool_or(layer = 1 AND (m = '*' OR m = CASE WHEN get THEN 'GET' ELSE 'POST' END)), false) AS ok, any_value(name) FILTER (place = 1) AS candidate, any_value(score) FILTER (place = 1) AS score, any_value(layer) FILTER (place = 1) AS layer FROM k LEFT JOIN b USING (probe) GROUP BY doc)
SELECT doc, CASE WHEN ok THEN 'ok' WHEN layer IS NOT NULL THEN 'low' ELSE 'unknown' END AS severity, candidate, round(CASE WHEN ok THEN 1.0 WHEN layer = 1 THEN 0.85 WHEN layer = 2 THEN score ELSE 0.9 END::DOUBLE, 6) AS confidence FROM o""",
    "lint_pages": f"""WITH p AS (SELECT page_id, {_P} AS path FROM pages), k AS (SELECT DISTINCT path AS name FROM p WHERE page_id % 2 = 1 UNION SELECT '/de/:page'),
a AS (SELECT DISTINCT path AS probe FROM p WHERE page_id % 2 = 0 AND path <> ''),
c AS (SELECT probe, name, 1.0::DOUBLE AS score, 0 AS layer FROM a JOIN k ON probe = name
UNION ALL SELECT probe, name, length(name), 1 FROM a JOIN k ON CASE WHEN name = '/de/:page' THEN regexp_matches(probe, '^/+de/+[^/]+/*$') ELSE rtrim(probe, '/') = rtrim(name, '/') AND name <> '' END
UNION ALL SELECT probe, name, sim, 2 FROM ({_near('SELECT probe FROM a', 'SELECT name FROM k')}) WHERE sim >= 0.4),
b AS (SELECT * FROM (SELECT * FROM c QUALIFY layer = min(layer) OVER (PARTITION BY probe)) QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) = 1)
SELECT page_id AS doc, CASE layer WHEN 0 THEN 'unknown' ELSE 'low' END AS severity, name AS candidate, round(CASE layer WHEN 0 THEN 0.98 WHEN 1 THEN 0.85 ELSE score END::DOUBLE, 6) AS confidence FROM p JOIN b ON path = probe WHERE page_id % 2 = 0""",
    "lint_imports": f"""WITH f AS (SELECT DISTINCT p_brand AS package, p_name AS name FROM part WHERE p_size < 20),
u AS (SELECT p_partkey AS doc, p_brand AS package, CASE WHEN p_partkey % 2 = 0 THEN left(p_name, 1) || substr(p_name, 3, 100) ELSE p_name END AS probe FROM part WHERE p_brand IN (SELECT package FROM f)),
b AS (SELECT s.probe, f.package, max(struct_pack(sim := sim, name := f.name)) AS b FROM ({_near('SELECT DISTINCT probe FROM u', 'SELECT DISTINCT name FROM f')}) s JOIN f ON f.name = s.name WHERE sim >= 0.5 GROUP BY ALL)
SELECT doc, u.package || '.' || u.probe AS name, CASE WHEN f.name IS NOT NULL THEN 'ok' WHEN b.b IS NOT NULL THEN 'low' ELSE 'unknown' END AS severity, coalesce(f.name, b.b.name) AS candidate,
round(CASE WHEN f.name IS NOT NULL THEN 1.0 WHEN b.b IS NOT NULL THEN b.b.sim ELSE 0.85 END::DOUBLE, 6) AS confidence
FROM u LEFT JOIN f ON f.package = u.package AND f.name = u.probe LEFT JOIN b ON b.package = u.package AND b.probe = u.probe""",
    "lint_assets": """SELECT p_partkey AS doc, p_name AS name, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size < 10) THEN 'ok' ELSE 'unknown' END AS severity,
CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size < 10) THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM part""",
    "prose_phrases": f"SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(text, '{grounding.PHRASES}', 1)) AS name FROM documents",
    "file_routes": f"""SELECT page_id, CASE WHEN page_id % 2 = 0 AND NOT starts_with(p, '/api/') THEN regexp_replace(regexp_replace(regexp_replace(p, '[0-9]+', ':id', 'g'), '//+', '/', 'g'), '(/|^)index$', '') END AS route
FROM (SELECT page_id, {_P} AS p FROM pages) WHERE regexp_matches(p, '^/[a-z].*[^/]$')""",
    "dotenv_rows": """SELECT path, 2 * (row_number() OVER (PARTITION BY path ORDER BY turn)) AS line, 'API_' || CASE WHEN turn % 2 = 0 THEN 'TOKEN' ELSE 'URL' END || '_' || turn AS name, v AS value, 'about turn ' || turn AS comment, turn % 2 = 0 AS secret
FROM (SELECT conv_id::VARCHAR AS path, turn, left(translate(text, '"' || chr(10) || chr(13) || '#', '    '), 20) AS v FROM conversations)""",
    "changelog_tally": """SELECT conv_id AS doc_id, '1.' || conv_id AS version, CASE WHEN turn % 2 = 0 THEN 'Added' ELSE 'Fixed' END AS section, count(*) AS bullets FROM conversations GROUP BY 1, 2, 3""",
    "ingest_turns": """SELECT conv_id::VARCHAR AS session_id, 'demo' AS project, turn::INTEGER AS line_no, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS idx, role, 'text' AS content_type, md5(text) AS content_md5
FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL""",
    "ingest_damage": """SELECT '/t/-home-al-projects-demo/' || conv_id || '.jsonl' AS path, count(*) + 1 AS lines, 1::BIGINT AS bad FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING min(turn) = 0""",
    "ingest_missing": """SELECT '/t/-home-al-projects-demo/' || conv_id || '.jsonl' AS path, t::INTEGER AS line_no FROM (SELECT conv_id, turn AS t FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL SELECT conv_id, -1 FROM conversations WHERE role IN ('user', 'assistant') AND turn = 0) WHERE conv_id % 3 <> 0 OR t > 1""",
    "ingest_calls": """SELECT (user_id % 7)::VARCHAR AS session_id, 'c' || event_id AS call_id, CASE event_type WHEN 'signup' THEN 'Write' WHEN 'view' THEN 'Edit' ELSE 'Read' END AS tool_name,
CASE WHEN event_id % 4 <> 0 THEN 'out' ELSE '' END AS tool_output, event_id % 4 <> 0 AND event_type = 'error' AS is_error, '/r/' || user_id % 20 || '.ts' AS file FROM events""",
    "file_touches": """SELECT (user_id % 7)::VARCHAR AS session_id, '/r/' || user_id % 20 || '.ts' AS file_path, CASE event_type WHEN 'signup' THEN 'write' ELSE 'edit' END AS op, count(*) AS n FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1, 2, 3""",
    "edit_operations": """SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ts, session_id, event_id) - 1)::INTEGER AS seq, op, new FROM (SELECT '/r/' || user_id % 20 || '.ts' AS path, (user_id % 7)::VARCHAR AS session_id, ts, event_id,
CASE event_type WHEN 'signup' THEN 'write' ELSE 'edit' END AS op, CASE event_type WHEN 'signup' THEN 'signup text' ELSE 'new text' END AS new FROM events WHERE event_type IN ('signup', 'view'))""",
    "lint_fields": f"""WITH f AS (SELECT DISTINCT p_type AS model, p_name AS name FROM part WHERE p_size <= 10),
u AS (SELECT p_partkey AS doc, CASE WHEN p_size > 45 THEN 'NOWHERE' ELSE p_type END AS model, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, 1) || substr(p_name, 3, 100) ELSE 'qq' || p_partkey % 7 END AS probe FROM part),
p AS (SELECT DISTINCT model, probe FROM u WHERE model IN (SELECT model FROM f)), {_FIELD_LAYERS},
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY probe, model ORDER BY score DESC, name) = 1)
SELECT doc, 'db' AS domain, u.model || '.' || u.probe AS name, CASE WHEN b.layer = 0 THEN 'ok' WHEN b.layer IS NOT NULL THEN 'low' ELSE 'unknown' END AS severity, b.name AS candidate,
round(CASE WHEN u.model NOT IN (SELECT model FROM f) THEN 0.92 WHEN b.layer = 0 THEN 1.0 WHEN b.layer = 1 THEN 0.85 WHEN b.layer IS NOT NULL THEN b.score ELSE 0.9 END::DOUBLE, 6) AS confidence
FROM u LEFT JOIN b ON u.model = b.model AND u.probe = b.probe""",
    "lint_prose": f"""WITH x AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(text, '{grounding.PHRASES}', 1)) AS name FROM documents),
u AS (SELECT doc, name AS probe FROM x UNION SELECT doc, left(name, length(name) - 2) FROM x),
s AS ({_near('SELECT DISTINCT probe FROM u', 'SELECT DISTINCT name FROM x WHERE doc % 2 = 0')}),
b AS (SELECT probe, bool_or(probe = name) AS same, max(struct_pack(sim := sim, name := name)) AS b FROM s WHERE sim >= 0.7 GROUP BY probe)
SELECT doc, probe AS name, 'low' AS severity, b.b.name AS candidate, round(b.b.sim, 6) AS confidence FROM u JOIN b USING (probe) WHERE NOT same""",
    "lint_selections": f"""WITH {_STAR_SQL}, k AS (SELECT c_custkey::VARCHAR AS doc, c_custkey AS k FROM customer),
u AS (SELECT doc, unnest(['Query', 'Customer', 'Nation', 'Customer', 'Customer', 'Order']) AS model, unnest(['customer', 'name', 'name', 'nation', 'orders', 'customer']) AS probe FROM k
UNION SELECT doc, 'Customer', CASE WHEN k % 3 = 0 THEN 'accbal' ELSE 'acctbal' END FROM k UNION SELECT doc, 'Nation', CASE WHEN k % 5 = 0 THEN 'zone' ELSE 'region' END FROM k
UNION SELECT doc, 'Region', 'name' FROM k WHERE k % 5 <> 0 UNION SELECT doc, 'Order', 't' || k % 4 FROM k), {_star_issues('graphql', 0.9)}""",
    "lint_chains": f"""WITH {_STAR_SQL}, k AS (SELECT o_orderkey::VARCHAR AS doc, o_orderkey AS k FROM orders),
u AS (SELECT doc, CASE WHEN k % 7 = 0 THEN 'Ordr' ELSE 'Order' END AS model, unnest(['total', 'customer']) AS probe FROM k
UNION SELECT doc, unnest(['Customer', 'Customer', 'Customer', 'Nation', 'Order']), unnest(['nation', 'acctbal', 'orders', CASE WHEN k % 3 = 0 THEN 'nme' ELSE 'name' END, 'totl']) FROM k WHERE k % 7 <> 0), {_star_issues('db', 0.92)}""",
    "lexed_symbols": """WITH p AS (SELECT p_partkey AS k, p_size AS s, CASE p_partkey % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'go' ELSE 'py' END AS e FROM part)
SELECT '/r/' || k || '.' || e AS path, unnest(['T' || k, 'm' || s, 'f' || k]) AS name, unnest([CASE e WHEN 'go' THEN 'struct' ELSE 'class' END, 'method', 'function']) AS kind, unnest(['', 'T' || k, '']) AS parent, unnest([2, 3, 5])::INT AS line FROM p""",
    "lint_members": """SELECT p_partkey || '.ts' AS doc, unnest(['T' || p_partkey || '.m' || p_size, 'T' || p_partkey || '.qqqq']) AS name, unnest(['ok', 'unknown']) AS severity, unnest([1.0, 0.9])::DOUBLE AS confidence FROM part""",
    "training_rows": f"""WITH h AS ({_SCORED_LEX}), q AS (SELECT item_id AS query_id, list_distinct({_TOK.format('text')}) AS q FROM benchmark), d AS (SELECT doc_id AS id, list_distinct({_TOK.format('text')}) AS d FROM documents WHERE doc_id IN (SELECT id FROM h))
SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS bm25, round(len(list_intersect(q, d)) / len(q)::DOUBLE, 6) AS overlap, (len(list_intersect(q, d)) / len(q)::DOUBLE >= 0.9)::DOUBLE AS label FROM h JOIN q USING (query_id) JOIN d USING (id)""",
    "user_prompt_view": "SELECT o_orderkey, c_name, c_mktsegment, epoch_us(o_orderdate) AS at FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
}
ROWS_ONLY = ("semantic_top5", "gists_or_text")
QUERIES = {n: globals()[n] for n in (*SQL, *ROWS_ONLY)}
