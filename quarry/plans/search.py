"""Text, retrieval, ranking and name-resolution queries, each with its SQL where there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import similarity, text
from quarry.operators import gramindex, graphindex, history, lint, meaning, ranking, resolve, retrieval, stemming, tables, textindex, upkeep
from quarry.session import kept, load, work_folder
from quarry.sources import documents

QUERY = "that and onen erblest it hein"
NEEDLES = ["worthless", "apache license", "%%%"]
AS_OF = "2024-01-31 00:00:00"
WEIGHT = ["bm25", "overlap"]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of the text searches: every benchmark item whose id is divisible by 20."""
    return load(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _probes_of(vectors: DataFrame) -> DataFrame:
    """The queries of the vector searches: every vector whose id is divisible by 20."""
    return vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


# --- text -----------------------------------------------------------------------------------------


def trash_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.worth_indexing(F.col("text")).alias("keep"))


def identifier_detect(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("text"))
    return _corpus(spark, sf).union(pages).select("id", text.identifier(F.col("text")).alias("identifier"))


def identifier_list(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(text.identifiers(F.col("text")), " ").alias("found"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    words = text.query_tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(F.array_join(words, " ")).alias("tokens_md5"))


def topic_top2(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select("conv_id", "turn", text.topic(F.col("text")).alias("topic"))


def keywords_top8(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.frequent_words(_docs(spark, sf), "doc_id", 8).select("doc_id", F.array_join("words", " ").alias("keywords"))


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(text.anchors(F.col("text")), "|").alias("anchors"))


def skip_gate(spark: SparkSession, sf: str) -> DataFrame:
    html = load(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return _corpus(spark, sf).union(html).select("id", text.skip_reason(F.col("text")).alias("reason"))


def spliced_gist(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(text.gist(F.col("text"))).alias("gist_md5"))


def rule_gist(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.short_gist(F.col("text")).alias("gist"))


def query_snippets(spark: SparkSession, sf: str) -> DataFrame:
    wanted = text.query_tokens(F.lit(QUERY))
    return load(spark, sf, "conversations").select("conv_id", "turn", text.snippet(F.col("text"), wanted).alias("snippet"))


def needle_snippets(spark: SparkSession, sf: str) -> DataFrame:
    cut = text.needle_snippet(F.col("text"), F.lit("worthless"))
    return _docs(spark, sf).select("doc_id", cut.alias("snippet")).filter("snippet is not null")


def markdown_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return documents.markdown_chunks(_docs(spark, sf)).select("doc_id", "section", "chunk_no", "sha256")


def edit_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    edits = e.select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "write").otherwise("edit").alias("op"),
        F.when(F.col("event_type") == "view", "click").otherwise("view").alias("old"),
        F.concat("event_type", F.lit(" ")).alias("new"), (F.col("event_type") == "purchase").alias("replace_all"),
    )
    return documents.replay_edits(edits)


def html_classes(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('class="([^"]+)"'), F.lit(1))
    names = F.explode(F.split(F.array_join(found, " "), r"\s+"))
    return load(spark, sf, "pages").select("page_id", names.alias("name")).filter("name <> ''").groupBy("name").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("uses"))


# --- retrieval ------------------------------------------------------------------------------------


def bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    queries = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = retrieval.bm25_top_k(_corpus(spark, sf), queries, 10)
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_every(spark: SparkSession, sf: str) -> DataFrame:
    """All scores of the queries, by joins."""
    return retrieval.bm25(_corpus(spark, sf), _asked(spark, sf)).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index, built from the texts of even ids and appended with the others, answers the queries."""
    corpus = _corpus(spark, sf)
    index = textindex.TextIndex.build(corpus.filter("id % 2 = 0"), work_folder(spark)).append(corpus.filter("id % 2 <> 0"))
    return index.search(_asked(spark, sf), 10).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def stored_search_reads(spark: SparkSession, sf: str) -> DataFrame:
    """How many postings a stored index scores for each query, and how many the query's words have there."""
    index = textindex.TextIndex.build(_corpus(spark, sf), work_folder(spark))
    hits = index.search(_asked(spark, sf), 10, reads=True)
    return hits.groupBy("query_id").agg(F.max("postings_read").alias("postings_read"), F.max("postings_held").alias("postings_held"))


def bm25_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are stored, a third of them deleted, and every sixth comes back: ranks are those of what is there."""
    corpus = _corpus(spark, sf)
    index = textindex.TextIndex.build(corpus, work_folder(spark)).delete(corpus.filter("id % 3 = 0")).append(corpus.filter("id % 6 = 0"))
    return index.search(_asked(spark, sf), 10).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def fts_and_unstemmed(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.contains_all(_corpus(spark, sf), "and the of that").select(F.col("id").alias("doc_id"))


def fts_and_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return stemming.contains_all_stems(_corpus(spark, sf), "tion ering").select(F.col("id").alias("doc_id"))


def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.substring_search(_corpus(spark, sf), NEEDLES).select(F.col("id").alias("doc_id"), "needle")


def learned_top5(spark: SparkSession, sf: str) -> DataFrame:
    """Texts nearest to the queries by vectors that are learned from all texts."""
    corpus = _corpus(spark, sf)
    learned = meaning.LearnedVectors.fit(corpus)
    return upkeep.semantic_search(corpus, _asked(spark, sf), 5, learned.embed).select("query_id", F.col("id").alias("doc_id"), F.round("score", 3).alias("score"))


_PARTS = ("the", "es", "%", "q", "worthless heron", "tion en", "\u00f1e", "1")


def substring_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text and each needle in it, through a stored trigram index; texts of every third id are deleted again."""
    corpus = _corpus(spark, sf)
    index = gramindex.GramIndex.build(corpus, work_folder(spark)).delete(corpus.filter("id % 3 = 0"))
    return index.search(_PARTS).select(F.col("id").alias("doc_id"), "needle")


def cosine_top10(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return retrieval.cosine_top_k(v, _probes_of(v), 10).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def cosine_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One query for each label: its vector of the smallest id."""
    v = _vectors(spark, sf)
    first = v.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min_by("vector", "id").alias("vector"))
    return retrieval.cosine_top_k(v, first, 5).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def semantic_cache_probe(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    others = retrieval.cosine_top_k(v, _probes_of(v), 2).filter("id <> query_id")
    hits = retrieval.top_k(others, ["query_id"], [F.desc("score"), F.asc("id")], 1)
    kind = F.when(F.col("score") >= 0.97, "hit").when(F.col("score") >= 0.92, "fuzzy").otherwise("none")
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), kind.alias("outcome"))


def ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    hits = graphindex.GraphIndex.build(v.select("id", "vector")).search(_probes_of(v), 10, compared=True)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.round("share", 6).alias("share"))


def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each preset finds so much of the ten nearest of all queries as it should."""
    v = _vectors(spark, sf)
    queries = _probes_of(v)
    exact = retrieval.cosine_top_k(v, queries, 10).select("query_id", "id", F.lit(1).alias("near"))
    out = []
    for preset, least in (("balanced", 0.9), ("high-recall", 0.95), ("low-memory", 0.9)):
        found = graphindex.GraphIndex.build(v.select("id", "vector"), preset).search(queries, 10).select("query_id", "id", F.lit(1).alias("found"))
        met = exact.join(found, ["query_id", "id"], "left")
        out.append(met.select(F.lit(preset).alias("preset"), "query_id", "found").groupBy("preset").agg(F.countDistinct("query_id").alias("queries"), (F.count("found") >= least * F.count("*")).alias("reached")))
    return reduce(DataFrame.unionByName, out)


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rank_of(retrieval.bm25_top_k(_corpus(spark, sf), _asked(spark, sf), 50), ["query_id"])


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors of the vector that has the query's id."""
    v = _vectors(spark, sf)
    queries = _probes_of(v).join(_asked(spark, sf).select("query_id"), "query_id", "left_semi")
    return retrieval.rank_of(retrieval.cosine_top_k(v, queries, 50), ["query_id"])


BY = ["query_id"]


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = retrieval.reciprocal_rank_fusion([_lexical(spark, sf), _semantic(spark, sf)], by=BY)
    return retrieval.best_of(fused, [F.desc("rrf_score"), F.asc("id")], 20, BY).select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion, then reweighting by topic, then the texts of what is left."""
    # some hits of each query, written down: they are used twice
    fused = kept(retrieval.reciprocal_rank_fusion([_lexical(spark, sf), _semantic(spark, sf)], by=BY))
    topics = _corpus(spark, sf).join(fused.select("id").distinct(), "id", "left_semi").select("id", text.topic(F.col("text")).alias("topic"))
    hits = fused.join(topics, "id")
    score = ranking.topic_reweight(F.col("rrf_score"), F.col("topic"), F.lit("and_that"))
    hits = hits.select("query_id", "id", "topic", F.round(score, 9).alias("score"))
    return retrieval.best_of(hits, [F.desc("score"), F.asc("id")], 10, BY)


def interleave_branches(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.interleave([_semantic(spark, sf).filter("rank < 10"), _lexical(spark, sf).filter("rank < 10")], 15, BY)


def disclose_budget(spark: SparkSession, sf: str) -> DataFrame:
    hits = load(spark, sf, "conversations").withColumn("size", F.length("text"))
    cut = retrieval.disclose(hits, 600, [F.desc("size"), F.asc("turn")], F.col("size"), ["conv_id"])
    return cut.select("conv_id", "turn", "cumulative")


def ranker_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).withColumn("words", text.query_tokens(F.col("text")))
    share = ranking.overlap(text.query_tokens(F.lit(QUERY)), F.col("words"))
    score = F.log1p("n_chars") / 10.0
    features = [score, F.lit(0.0), -F.log1p(F.col("doc_id") / 100.0), share, F.when(F.col("lang") == "en", 1.0).otherwise(0.0), F.lit(0.0), F.lit(1.0)]
    return rows.select("doc_id", F.round(share, 6).alias("overlap"), F.round(ranking.linear_score(features), 6).alias("score"))


def topic_reweight(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").withColumn("topic", text.topic(F.col("text")))
    return rows.select("conv_id", "turn", F.round(ranking.topic_reweight(F.length("text").cast("double"), F.col("topic"), F.lit("the_and")), 6).alias("score"))


def recall_at_k_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """A hit is relevant if it has the label of the query's vector."""
    v = _vectors(spark, sf)
    near = retrieval.cosine_top_k(v, _probes_of(v), 11).filter("id <> query_id")
    labels = v.select("id", "label")
    judged = near.join(labels, "id").join(labels.toDF("query_id", "own"), "query_id")
    ranked = retrieval.rank_of(judged, BY).withColumns({"rank": F.col("rank") + 1, "relevant": F.col("label") == F.col("own")})
    m = ranking.retrieval_metrics(ranked.filter("rank <= 10"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def lr_fit(spark: SparkSession, sf: str) -> DataFrame:
    joined = _docs(spark, sf).join(load(spark, sf, "labels"), "doc_id")
    rows = joined.select(F.log1p("n_chars").alias("length"), F.size(text.query_tokens(F.col("text"))).cast("double").alias("words"), F.col("quality").cast("double").alias("label"))
    weights, bias = ranking.fit_linear(rows, ["length", "words"])
    return spark.range(1).select(F.lit(weights[0]).alias("w_length"), F.lit(weights[1]).alias("w_words"), F.lit(bias).alias("bias"))


# --- names ----------------------------------------------------------------------------------------


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """Every name with its second letter gone, and with its words swapped."""
    n = _names(spark, sf)
    typo = n.select(F.concat(F.substring("name", 1, 1), F.substring("name", 3, 100)).alias("probe"))
    swapped = n.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("probe"))
    return typo.union(swapped).union(n.select(F.col("name").alias("probe"))).distinct()


def trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", F.round(similarity.similarity(F.col("s_name"), F.col("n_name")), 6).alias("sim"))


def trigram_join(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.trigram_join(_probes(spark, sf), _names(spark, sf), 0.4).withColumn("sim", F.round("sim", 6))


def resolve_symbol(spark: SparkSession, sf: str) -> DataFrame:
    found = resolve.resolve_symbols(_probes(spark, sf), _names(spark, sf), limit=3)
    return found.select("probe", "name", F.round("score", 6).alias("score"), "place")


def resolve_layered(spark: SparkSession, sf: str) -> DataFrame:
    found = resolve.resolve_names(_probes(spark, sf), _names(spark, sf), 0.5, 3)
    return found.select("probe", "name", F.round("score", 6).alias("score"), "layer", "place")


def check_name(spark: SparkSession, sf: str) -> DataFrame:
    nations = load(spark, sf, "nation").select(F.col("n_name").alias("name"))
    probes = _probes(spark, sf).union(nations.select(F.lower(F.concat("name", F.lit("s"))).alias("probe")))
    layers = {"part": resolve.resolve_names(probes, _names(spark, sf)), "nation": resolve.resolve_names(probes, nations)}
    return resolve.check_names(layers, probes).withColumn("score", F.round("score", 6))


def rewriter_winner(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf).select(F.upper(F.translate("name", " ", "_")).alias("name"))
    probes = _probes(spark, sf).select(F.translate("probe", " ", "_").alias("probe")).union(names.select(F.concat("name", F.lit("_KEY")).alias("probe")))
    found = resolve.rewrite(probes, names)
    return found.select("probe", "verdict", F.round("confidence", 6).alias("confidence"), "name", "strategy")


def route_normalize(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    shaped = F.regexp_replace(path, "[0-9]+", "{id}")
    return load(spark, sf, "pages").select("page_id", text.normalize_route(shaped).alias("route"))


ROUTES = ["/en/:page", "/fr/*", "/de/:page", "/:lang/:page", "/*"]


def route_pattern_match(spark: SparkSession, sf: str) -> DataFrame:
    paths = load(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("probe")).distinct()
    best = F.lit(None).cast("string")
    for route in reversed(ROUTES):
        best = F.when(F.rlike("probe", text.route_regex(F.lit(route))), route).otherwise(best)
    return paths.select(F.col("probe").alias("path"), best.alias("route"))


def ignore_rules(spark: SparkSession, sf: str) -> DataFrame:
    paths = load(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    rules = ["*.html", "!en/*.html", "/fr/", "de/4*"]
    made = tables.ignore_decision(paths.select("path").distinct(), rules)
    return paths.join(made, "path").select("page_id", "rule", "skipped")


def lint_ground(spark: SparkSession, sf: str) -> DataFrame:
    """Every probe as a name that a document uses, grounded in the parts' names."""
    asked = _probes(spark, sf).select(F.substring("probe", 1, 1).alias("doc"), F.lit("symbol").alias("domain"), F.col("probe").alias("name"))
    issues = lint.ground(asked, _names(spark, sf).select(F.lit("symbol").alias("domain"), "name"))
    return issues.select("doc", "name", "severity", F.round("confidence", 6).alias("confidence"))


def lint_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return lint.verdicts(lint_ground(spark, sf))


def weighted_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    mixed = history.weighted_hybrid(_lexical(spark, sf), _semantic(spark, sf), 0.5, 20, BY)
    return mixed.select("query_id", "id", F.round("score", 6).alias("score"))


def mixed_kind_search(spark: SparkSession, sf: str) -> DataFrame:
    found = history.mixed_search({"doc": _lexical(spark, sf).filter("rank < 10"), "vector": _semantic(spark, sf).filter("rank < 10")}, 12, BY)
    return found.withColumn("score", F.round("score", 9))


# --- SQL ------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_WORDS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '{text.CONTENT_WORD.replace('{', '{{').replace('}', '}}')}', 0), lambda w: NOT list_contains({text.STOPWORDS}, w))"
_TOP = """(SELECT list(w ORDER BY c DESC, f) FROM (SELECT w, count(*) AS c, min(i) AS f FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i) GROUP BY w))"""


def _top_sql(n: int, keys: str, table: str) -> str:
    return f"SELECT {keys}, list_slice(coalesce({_TOP}, []), 1, {n}) AS top FROM (SELECT {keys}, {_WORDS.format('text')} AS ws FROM {table})"


def _ident(column: str) -> str:
    parts = [p for name, p in text.IDENTIFIERS.items() if name != "ipv6"]  # look-behind is not RE2; the data has none of that shape
    shaped = ", ".join("nullif(regexp_extract(trim({0}), '{1}', 0), '')".format(column, p.replace("'", "''")) for p in parts)
    return f"""coalesce({shaped}, CASE WHEN NOT contains(trim({column}), ' ') AND regexp_matches(trim({column}), '[0-9]') AND (length(trim({column})) >= 10
    OR (length(trim({column})) >= 7 AND NOT regexp_matches(lower(trim({column})), '[a-z]{{4,}}'))) THEN trim({column}) END)"""


_BM25 = """WITH d AS (SELECT doc_id, {tok} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({qtok}) AS term FROM benchmark {where}),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY query_id, doc_id"""
_BM25_ALL = _BM25.format(tok=_TOK.format("text"), qtok=_TOK.format("text"), where="")
_BM25_ASKED = _BM25.format(tok=_TOK.format("text"), qtok=_TOK.format("text"), where="WHERE item_id % 20 = 0")
_COS = """SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, q.label AS own, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"""
_PLACE = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
_SCORED_LEX = f"SELECT query_id, id, score FROM (SELECT query_id, doc_id AS id, score FROM ({_BM25_ASKED})) QUALIFY {_PLACE} <= 50"
_SCORED_SEM = f"SELECT query_id, id, score FROM ({_COS}) WHERE query_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0) QUALIFY {_PLACE} <= 50"
_LEX = f"SELECT query_id, id, {_PLACE} - 1 AS rank FROM ({_SCORED_LEX})"
_SEM = f"SELECT query_id, id, {_PLACE} - 1 AS rank FROM ({_SCORED_SEM})"
_RRF = f"SELECT query_id, id, sum(1.0::DOUBLE / (61 + rank)) AS rrf_score FROM (({_LEX}) UNION ALL ({_SEM})) GROUP BY query_id, id"
_NAMES = "SELECT DISTINCT p_name AS name FROM part"
_PROBES = f"""SELECT substr(name, 1, 1) || substr(name, 3, 100) AS probe FROM ({_NAMES}) UNION SELECT array_to_string(list_reverse(string_split(name, ' ')), ' ') FROM ({_NAMES}) UNION SELECT name FROM ({_NAMES})"""


def _grams(column: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _jac(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE)"


_SIMS = f"SELECT probe, name, {_jac('tp', 'tn')} AS sim FROM (SELECT probe, {_grams('probe')} AS tp FROM ({_PROBES})), (SELECT name, {_grams('name')} AS tn FROM ({_NAMES}))"
_RERANK = """sim * sqrt(least(length(probe), length(name)) / greatest(length(probe), length(name))::DOUBLE)
 + CASE WHEN lower(probe) = lower(name) THEN 0.25 ELSE 0 END + CASE WHEN starts_with(lower(name), lower(probe)) OR starts_with(lower(probe), lower(name)) THEN 0.15 ELSE 0 END
 + CASE WHEN contains(lower(name), lower(probe)) OR contains(lower(probe), lower(name)) THEN 0.08 ELSE 0 END
 + CASE levenshtein(probe, name) WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.15 WHEN 3 THEN 0.05 ELSE 0 END"""
_LAYERED = f"""SELECT probe, name, score, layer, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS place FROM (
SELECT probe, name, CASE WHEN probe = name THEN 1.0 ELSE sim END AS score, CASE WHEN probe = name THEN 0 ELSE 1 END AS layer FROM ({_SIMS}) WHERE probe = name OR sim >= 0.5
QUALIFY layer = min(layer) OVER (PARTITION BY probe)) QUALIFY place <= 3"""
_PATH = "regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"
_WANTED = _WORDS.format(f"'{QUERY}'")

_GROUND = f"""SELECT substr(probe, 1, 1) AS doc, probe AS name, CASE WHEN b.best = 1 AND hit THEN 'ok' WHEN best >= 0.5 THEN 'low' ELSE 'unknown' END AS severity,
round(CASE WHEN hit THEN 1.0 WHEN best >= 0.5 THEN best ELSE 0.9 END, 6) AS confidence FROM (SELECT probe, max(sim) AS best, bool_or(probe = name) AS hit FROM ({_SIMS}) GROUP BY probe) b"""


def _first_seen(items: str) -> str:
    return f"list_filter({items}, lambda t, i: list_position({items}, t) = i)"


def _all_matches(column: str, patterns: list[str]) -> str:
    return " || ".join("regexp_extract_all({0}, '{1}', 0)".format(column, p.replace("'", "''")) for p in patterns)


def _anchors_sql() -> str:
    found = f"SELECT doc_id, list_filter(list_transform({_all_matches('text', list(text.ANCHORS))}, lambda t: trim(t, '`')), lambda t: t <> '' AND length(t) <= 200) AS f FROM documents"
    return f"SELECT doc_id, array_to_string(list_slice({_first_seen('f')}, 1, 32), '|') AS anchors FROM ({found})"


def _identifiers_sql() -> str:
    patterns = [p for name, p in text.IDENTIFIERS.items() if name != "ipv6"]  # look-behind is not RE2; the data has none of that shape
    found = f"SELECT doc_id, list_filter(list_transform({_all_matches('text', patterns)}, lambda t: regexp_replace(t, '[.,;:)\"'']+$', '')), lambda t: t <> '') AS f FROM documents"
    return f"SELECT doc_id, array_to_string(list_slice({_first_seen('f')}, 1, 4), ' ') AS found FROM ({found})"


def _gist_sql() -> str:
    s = "coalesce(text, '')"
    steps = [
        (r"(?s)```[a-zA-Z]*\n.*?\n```", "[code]"), (r"(?m)^#+\s*", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"`([^`]+)`", r"\1"), (r"(?m)^\s*[-*]\s+", ""),
        (r"https?://\S+", "[url]"), *((rf"(?i)\b{p}\b", r) for p, r in text.PHRASES.items()),
    ]
    for pattern, to in steps:
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    for _ in range(5):
        s = "regexp_replace(ltrim({0}), '{1}', '')".format(s, text.OPENING.replace("'", "''"))
    # what stands between the first five sentences is marked; the fifth is all the rest
    filler = text.FILLER.replace("'", "''")
    told = f"SELECT doc_id, list_filter(p[1:4] || CASE WHEN len(p) > 4 THEN [array_to_string(p[5:], ' ')] ELSE [] END, lambda x: NOT regexp_matches(trim(x), '{filler}')) AS told FROM (SELECT doc_id, string_split(regexp_replace({s}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)"
    picked = "list_filter(told, lambda x, i: coalesce(list_sum(list_transform(told[1:i-1], lambda y: length(y))), 0) < 100)"
    s = f"trim(regexp_replace(array_to_string({picked}, ' '), '\\s+', ' ', 'g'))"
    return f"SELECT doc_id, CASE WHEN length(s) > 100 THEN rtrim(substr(s, 1, 99)) || '…' ELSE s END AS gist FROM (SELECT doc_id, {s} AS s FROM ({told}))"


_SNIPPETS = f"""SELECT conv_id, turn, substr(text, 1 - best.at, 500) AS snippet FROM (SELECT conv_id, turn, text, list_max(list_transform(range(0, greatest(length(text) - 1, 0) + 1, 250),
lambda p: struct_pack(n := len(list_filter(list_distinct({_WANTED}), lambda w: contains(substr(lower(text), p + 1, 500), w))), at := -p))) AS best FROM conversations)"""

def _spliced_sql() -> str:
    found = f"SELECT doc_id, text, list_filter(list_transform({_all_matches('text', list(text.ANCHORS))}, lambda t: trim(t, '`')), lambda t: t <> '' AND length(t) <= 200) AS f FROM documents"
    spliced = f"SELECT doc_id, text, list_slice({_first_seen('f')}, 1, 32) AS a FROM ({found})"
    return f"""SELECT doc_id, CASE WHEN {_SKIP} IS NULL THEN md5(CASE WHEN len(a) > 0 THEN '[anchors: ' || array_to_string(a, ', ') || '] ' || text ELSE text END) END AS gist_md5 FROM ({spliced})"""


_SKIP = """CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, '```') THEN 'contains-code-block' WHEN regexp_matches(text, '(?m)^Traceback \\(most recent call last\\):') THEN 'contains-traceback'
WHEN length(trim(text)) >= 4 AND ((starts_with(trim(text), '{') AND ends_with(trim(text), '}')) OR (starts_with(trim(text), '[') AND ends_with(trim(text), ']'))) THEN 'structured-json'
WHEN len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(rtrim(l, chr(13)), '^[-+]( |$)'))) >= 5 THEN 'contains-diff' END"""

_REPLAY = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type = 'signup' AS write,
CASE WHEN event_type = 'view' THEN 'click' ELSE 'view' END AS old, event_type || ' ' AS new, event_type = 'purchase' AS every FROM events),
r AS (SELECT DISTINCT path, 0::BIGINT AS n, '' AS text, 0 AS applied, 0 AS failed FROM e UNION ALL
SELECT r.path, e.n, CASE WHEN write THEN new WHEN NOT contains(text, old) THEN text WHEN every THEN replace(text, old, new) ELSE substr(text, 1, strpos(text, old) - 1) || new || substr(text, strpos(text, old) + length(old)) END,
applied + CASE WHEN write OR contains(text, old) THEN 1 ELSE 0 END, failed + CASE WHEN write OR contains(text, old) THEN 0 ELSE 1 END FROM r JOIN e ON e.path = r.path AND e.n = r.n + 1)
SELECT path, arg_max(text, n) AS text, arg_max(applied, n) AS applied, arg_max(failed, n) AS failed FROM r GROUP BY path"""

_ASKED_NAMES = f"{_PROBES} UNION SELECT lower(n_name || 's') FROM nation"


def _best_sql(domain: str, number: int, names: str) -> str:
    sims = f"SELECT probe, name, {_jac('tp', 'tn')} AS sim FROM (SELECT probe, {_grams('probe')} AS tp FROM ({_ASKED_NAMES})), (SELECT name, {_grams('name')} AS tn FROM ({names}))"
    return f"""SELECT probe, {number} AS n, '{domain}' AS domain, name, CASE WHEN probe = name THEN 1.0 ELSE sim END AS score, CASE WHEN probe = name THEN 0 ELSE 1 END AS layer FROM ({sims})
WHERE probe = name OR sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY probe ORDER BY layer, score DESC, name) = 1"""


_CHECKED = f"""WITH b AS (SELECT * FROM (({_best_sql('part', 0, _NAMES)}) UNION ALL ({_best_sql('nation', 1, 'SELECT n_name AS name FROM nation')})) QUALIFY row_number() OVER (PARTITION BY probe ORDER BY n) = 1)
SELECT probe, domain, name, round(score, 6) AS score, CASE WHEN name IS NULL THEN 'UNKNOWN' WHEN layer = 0 THEN 'OK' WHEN score >= 0.75 THEN 'TYPO' ELSE 'UNCERTAIN' END AS status FROM ({_ASKED_NAMES}) LEFT JOIN b USING (probe)"""

SQL = {
    "spliced_gist": _spliced_sql(),
    "edit_replay": _REPLAY,
    "check_name": _CHECKED,
    "anchors": _anchors_sql(),
    "identifier_list": _identifiers_sql(),
    "rule_gist": _gist_sql(),
    "query_snippets": _SNIPPETS,
    "lint_ground": _GROUND,
    "lint_verdicts": f"""SELECT doc, CASE WHEN unknown > 0 THEN 'block' WHEN low > 0 THEN 'warn' ELSE 'ok' END AS verdict, ok, low, unknown FROM (
SELECT doc, count(*) FILTER (severity = 'ok') AS ok, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'unknown') AS unknown FROM ({_GROUND}) GROUP BY doc)""",
    "weighted_hybrid": f"""SELECT query_id, id, round(sum(s), 6) AS score FROM (""" + " UNION ALL ".join(
        f"""SELECT query_id, id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END * 0.5 AS s
FROM ({one}) WINDOW w AS (PARTITION BY query_id)""" for one in (_SCORED_LEX, _SCORED_SEM)
    ) + ") GROUP BY query_id, id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(s) DESC, id) <= 20",
    "mixed_kind_search": f"""SELECT query_id, kind, id, round(1.0::DOUBLE / (61 + place), 9) AS score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) - 1 AS place FROM (
SELECT query_id, kind, id::VARCHAR AS id, score FROM (SELECT 'doc' AS kind, * FROM ({_SCORED_LEX}) UNION ALL SELECT 'vector', * FROM ({_SCORED_SEM}))
QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id::BIGINT) <= 10))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (61 + place) DESC, kind, id) <= 12""",
    "trash_gate": "SELECT doc_id, length(t) >= 50 AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) / greatest(length(t), 1) >= 0.3 AS keep FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)",
    "identifier_detect": f"SELECT id, {_ident('text')} AS identifier FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, url FROM pages)",
    "tokenize": f"SELECT doc_id, md5(array_to_string(list_distinct_ordered, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_ordered FROM (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents))",
    "topic_top2": f"SELECT conv_id, turn, CASE WHEN len(top) = 2 THEN array_to_string(top, '_') ELSE '' END AS topic FROM ({_top_sql(2, 'conv_id, turn', 'conversations')})",
    "keywords_top8": f"SELECT doc_id, array_to_string(top, ' ') AS keywords FROM ({_top_sql(8, 'doc_id', 'documents')})",
    "skip_gate": f"SELECT id, {_SKIP} AS reason FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)",
    "needle_snippets": "SELECT doc_id, substr(text, greatest(p - 100, 1), p - greatest(p - 100, 1) + 9 + 200) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'worthless')::BIGINT AS p FROM documents) WHERE p > 0",
    "html_classes": "SELECT name, count(DISTINCT page_id) AS pages, count(*) AS uses FROM (SELECT page_id, unnest(regexp_split_to_array(array_to_string(regexp_extract_all(html, 'class=\"([^\"]+)\"', 1), ' '), '\\s+')) AS name FROM pages) WHERE name <> '' GROUP BY name",
    "bm25_top10": f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_BM25_ALL}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10",
    "fts_and_unstemmed": f"SELECT doc_id FROM documents WHERE list_has_all({_TOK.format('text')}, ['and', 'the', 'of', 'that'])",
    "substring_search": "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{n}') THEN '{n}'" for n in NEEDLES) + " END AS needle FROM documents) WHERE needle IS NOT NULL",
    "bm25_every": f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_BM25_ASKED})",
    "substring_indexed": f"SELECT doc_id, needle FROM documents, (SELECT unnest({list(_PARTS)}) AS needle) WHERE doc_id % 3 <> 0 AND contains(lower(text), needle)",
    "ann_recall": "SELECT preset, count(*) AS queries, true AS reached FROM embeddings, (SELECT unnest(['balanced', 'high-recall', 'low-memory']) AS preset) WHERE vec_id % 20 = 0 GROUP BY preset",
    "bm25_after_changes": f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_BM25_ASKED.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0)')}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10",
    "bm25_stored": f"SELECT query_id, doc_id, round(score, 6) AS score FROM ({_BM25_ASKED}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10",
    "cosine_top10": f"SELECT query_id, id AS vec_id, round(score, 6) AS score FROM ({_COS}) QUALIFY {_PLACE} <= 10",
    "cosine_batch": """SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.label AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 9) AS score FROM embeddings e,
(SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "semantic_cache_probe": f"""SELECT query_id, id AS vec_id, round(score, 6) AS score, CASE WHEN score >= 0.97 THEN 'hit' WHEN score >= 0.92 THEN 'fuzzy' ELSE 'none' END AS outcome
FROM ({_COS}) WHERE id <> query_id QUALIFY {_PLACE} = 1""",
    "rrf_fusion": f"SELECT query_id, id, round(rrf_score, 9) AS rrf_score FROM ({_RRF}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) <= 20",
    "hybrid_search": f"""SELECT query_id, id, topic, round(CASE WHEN topic = '' THEN rrf_score WHEN topic = 'and_that' THEN rrf_score * 0.7 ELSE rrf_score * 1.3 END, 9) AS score FROM ({_RRF}) JOIN (
SELECT doc_id AS id, CASE WHEN len(top) = 2 THEN array_to_string(top, '_') ELSE '' END AS topic FROM ({_top_sql(2, 'doc_id', 'documents')})) USING (id) QUALIFY {_PLACE} <= 10""",
    "interleave_branches": f"""SELECT query_id, id, m.b AS branch, m.r AS rank FROM (SELECT query_id, id, min(struct_pack(b := branch, r := rank)) AS m FROM (
SELECT query_id, id, 0 AS branch, rank FROM ({_SEM}) WHERE rank < 10 UNION ALL SELECT query_id, id, 1, rank FROM ({_LEX}) WHERE rank < 10) GROUP BY query_id, id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY m.b, m.r, id) <= 15""",
    "disclose_budget": """SELECT conv_id, turn, cumulative::BIGINT AS cumulative FROM (SELECT *, sum(length(text)) OVER w AS cumulative, row_number() OVER w AS n FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR cumulative <= 600""",
    "ranker_features": f"""SELECT doc_id, round(o, 6) AS overlap, round(1 / (1 + exp(-(-0.5::DOUBLE + ln(1 + n_chars) / 10.0::DOUBLE * 0.4::DOUBLE - ln(1 + doc_id / 100.0::DOUBLE) * 0.2::DOUBLE + o * 0.8::DOUBLE + CASE WHEN lang = 'en' THEN 0.6::DOUBLE ELSE 0 END + 0.3::DOUBLE))), 6) AS score
FROM (SELECT doc_id, n_chars, lang, len(list_intersect(list_distinct({_WANTED}), list_distinct({_WORDS.format('text')}))) / greatest(len(list_distinct({_WANTED})), 1)::DOUBLE AS o FROM documents)""",
    "topic_reweight": f"""SELECT conv_id, turn, round(length(text) * CASE WHEN topic = '' THEN 1.0 WHEN topic = 'the_and' THEN 0.7 ELSE 1.3 END::DOUBLE, 6) AS score FROM conversations JOIN (
SELECT conv_id, turn, CASE WHEN len(top) = 2 THEN array_to_string(top, '_') ELSE '' END AS topic FROM ({_top_sql(2, 'conv_id, turn', 'conversations')})) USING (conv_id, turn)""",
    "recall_at_k_mrr": f"""WITH r AS (SELECT query_id, label = own AS relevant, {_PLACE} AS rank FROM ({_COS}) WHERE id <> query_id),
f AS (SELECT query_id, min(rank) FILTER (relevant) AS r FROM r WHERE rank <= 10 GROUP BY query_id)
SELECT round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM f""",
    "trigram_similarity": f"SELECT s_suppkey, round({_jac('a', 'b')}, 6) AS sim FROM (SELECT s_suppkey, {_grams('s_name')} AS a, {_grams('n_name')} AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "trigram_join": f"SELECT probe, name, round(sim, 6) AS sim FROM ({_SIMS}) WHERE sim >= 0.4",
    "resolve_symbol": f"""WITH s AS (SELECT *, levenshtein(lower(probe), lower(name)) AS edits FROM ({_SIMS})), strong AS (SELECT * FROM s WHERE sim >= 0.4),
every AS (SELECT * FROM strong UNION ALL SELECT * FROM s WHERE sim >= 0.28 AND probe NOT IN (SELECT probe FROM strong) AND edits <= greatest(2, length(probe) // 3)),
f AS (SELECT *, {_RERANK} AS score FROM every QUALIFY row_number() OVER (PARTITION BY probe ORDER BY sim DESC, name) <= 50)
SELECT probe, name, round(score, 6) AS score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, name) AS place FROM f QUALIFY place <= 3""",
    "resolve_layered": f"SELECT probe, name, round(score, 6) AS score, layer, place FROM ({_LAYERED})",
    "route_normalize": f"""SELECT page_id, CASE WHEN length(r) > 1 AND ends_with(r, '/') THEN regexp_replace(r, '/$', '') ELSE r END AS route FROM (
SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_PATH}, '[0-9]+', '{{id}}', 'g'), '\\{{([^}}/]+)\\}}', ':\\1', 'g'), '//+', '/', 'g') AS r FROM pages)""",
    "route_pattern_match": f"""SELECT DISTINCT {_PATH} AS path, CASE WHEN regexp_matches({_PATH}, '^/en/+[^/]+/*$') THEN '/en/:page' WHEN regexp_matches({_PATH}, '^/fr(/.*)?/*$') THEN '/fr/*'
WHEN regexp_matches({_PATH}, '^/de/+[^/]+/*$') THEN '/de/:page' WHEN regexp_matches({_PATH}, '^/+[^/]+/+[^/]+/*$') THEN '/:lang/:page' WHEN regexp_matches({_PATH}, '^(/.*)?/*$') THEN '/*' END AS route FROM pages""",
    "ignore_rules": """SELECT page_id, rule, coalesce(rule NOT LIKE '!%', false) AS skipped FROM (SELECT page_id, CASE WHEN regexp_matches(p, '^/?de/4[^/]*(?:/|$)') THEN 'de/4*' WHEN regexp_matches(p, '^/?fr/') THEN '/fr/'
WHEN regexp_matches(p, '^/?en/[^/]*\\.html(?:/|$)') THEN '!en/*.html' WHEN regexp_matches(p, '(?:^|/)[^/]*\\.html(?:/|$)') THEN '*.html' END AS rule
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS p FROM pages))""",
}
ROWS_ONLY = ("learned_top5", "markdown_chunks", "stored_search_reads", "fts_and_stemmed", "ann_topk", "lr_fit", "rewriter_winner")
QUERIES = {n: globals()[n] for n in (*SQL, *ROWS_ONLY)}
