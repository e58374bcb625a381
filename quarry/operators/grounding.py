"""Lint strategies by domain: each compares what edits refer to with an index and gives issues.

A strategy is a function of references and an index to (doc, domain, name, severity, candidate,
confidence). Severities are ``ok``, ``low`` (doubtful) and ``unknown``; ``lint.verdicts`` rolls them up. An
empty index gives no issues. Strategies are registered by domain, and others can be added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import trigram_join
from quarry.functions.text import normalize_route
from quarry.operators.resolve import CANONICAL, resolve_fields, resolve_routes
from quarry.session import kept

# Confidences of findings.
SAME, WRONG_VERB, NO_ROUTE, TAKEN, LIKE_TAKEN = 1.0, 0.85, 0.9, 0.98, 0.85
NO_VARIABLE, UNDECLARED, REPLICATED = 0.92, 0.55, 0.6
NO_MODEL, NO_FIELD, OTHER_MODEL, NO_EXPORT, PHRASE = 0.92, 0.9, 0.85, 0.85, 0.7

STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(domain: str) -> Callable:
    """Register a strategy under a domain; a later one replaces an earlier one."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STRATEGIES[domain] = f
        return f

    return register


def lint(given: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Issues of all domains in ``given`` (domain -> references and index) that have a strategy."""
    out = None
    for domain, pair in given.items():
        if domain in STRATEGIES:
            made = STRATEGIES[domain](*pair)
            out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no domain with a strategy")
    return out


def _issues(rows: DataFrame, domain: str, severity: Column, candidate: Column, confidence: Column) -> DataFrame:
    return rows.select("doc", F.lit(domain).alias("domain"), "name", severity.alias("severity"), candidate.alias("candidate"), confidence.cast("double").alias("confidence"))


def _if_any(rows: DataFrame, index: DataFrame) -> DataFrame:
    """No rows where the index is empty: a semi-join with its first row."""
    return rows.join(F.broadcast(index.limit(1).select(F.lit(1).alias("_one"))), F.lit(1) == F.col("_one"), "left_semi")


def url_path(url: Column) -> Column:
    """The path of a URL, without host and query."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


@strategy("route")
def routes(references: DataFrame, index: DataFrame) -> DataFrame:
    """Calls (doc, method, name) of URLs against routes (method, name): a known path with another verb is
    doubtful, one like a known path too; others are unknown. Templated URLs are left out."""
    calls = references.filter(~F.col("name").rlike(r"\$\{|\{\{|%[sd]|\+")).withColumn("probe", normalize_route(url_path(F.col("name")))).filter("probe <> ''").distinct()
    served = index.select(F.col("method").alias("_m"), F.col("name").alias("route")).distinct()
    paths = calls.select("probe", F.lit("*").alias("method")).distinct()
    hits = resolve_routes(paths, index.select(F.lit("*").alias("method"), "name").distinct(), 0.3, 50).select("probe", F.col("name").alias("route"), "score", "layer", "place")
    verb = F.max((F.col("layer") < 2) & ((F.col("method") == F.col("_m")) | (F.col("_m") == "*")))
    met = calls.join(hits, "probe", "left").join(served, "route", "left")
    best = met.groupBy("doc", "method", "name").agg(verb.alias("ok"), F.min_by(F.struct("route", "score", "layer"), F.struct("place", "route")).alias("b"))
    near, known = F.col("b.route").isNotNull(), F.col("b.layer") < 2
    severity = F.when(F.col("ok"), "ok").when(near, "low").otherwise("unknown")
    confidence = F.when(F.col("ok"), SAME).when(near & known, WRONG_VERB).when(near, F.col("b.score")).otherwise(NO_ROUTE)
    return _if_any(_issues(best, "route", severity, F.col("b.route"), confidence), index)


@strategy("page")
def new_pages(references: DataFrame, index: DataFrame) -> DataFrame:
    """New pages (doc, name) against pages (name): a route that is taken is unknown (the edit may not add it),
    one that a pattern covers or that is like a taken one is doubtful, a free one is no issue."""
    asked = references.select("doc", "name").distinct()
    probes = asked.select(F.col("name").alias("probe"), F.lit("*").alias("method")).distinct()
    hits = resolve_routes(probes, index.select(F.lit("*").alias("method"), "name").distinct(), 0.4, 1)
    met = asked.join(hits.select("probe", F.col("name").alias("page"), "score", "layer"), F.col("name") == F.col("probe"))
    severity = F.when(F.col("layer") == 0, "unknown").otherwise("low")
    confidence = F.when(F.col("layer") == 0, TAKEN).when(F.col("layer") == 1, LIKE_TAKEN).otherwise(F.col("score"))
    return _issues(met, "page", severity, F.col("page"), confidence)


def _declared(domain: str, replicated_at: float) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def ground(references: DataFrame, index: DataFrame) -> DataFrame:
        """Names (doc, name) against names by source (name, source). A declared name is fine. One that is used
        elsewhere only is doubtful: as a copied typo where a declared name is like it, as undeclared
        otherwise. An unused one is doubtful where a known name is like it, or else unknown."""
        asked = references.select("doc", "name").distinct()
        known = index.groupBy("name").agg(F.max(F.col("source").isin(*CANONICAL)).alias("declared"))
        met = asked.join(known, "name", "left")
        open_ = met.filter(~F.coalesce("declared", F.lit(False))).select(F.col("name").alias("probe")).distinct()
        near = trigram_join(open_, known.select("name"), 0.5).filter("probe <> name").withColumnRenamed("name", "candidate")
        near = near.join(known.select(F.col("name").alias("candidate"), F.col("declared").alias("_d")), "candidate")
        best = lambda only: F.max_by(F.when(only, F.struct("candidate", "sim")), F.when(only, F.struct("sim", F.col("candidate"))))
        near = near.groupBy("probe").agg(best(F.col("_d")).alias("d"), best(F.lit(True)).alias("a"))
        rows = met.join(near, F.col("name") == F.col("probe"), "left")
        used, typo = F.col("declared").isNotNull(), F.col("d.sim") >= replicated_at
        severity = F.when(F.col("declared"), "ok").when(used | F.col("a").isNotNull(), "low").otherwise("unknown")
        candidate = F.when(F.col("declared"), F.col("name")).when(used & typo, F.col("d.candidate")).when(~used, F.col("a.candidate"))
        confidence = F.when(F.col("declared"), SAME).when(used & typo, F.col("d.sim")).when(used, UNDECLARED).when(F.col("a").isNotNull(), F.col("a.sim")).otherwise(NO_VARIABLE)
        return _if_any(_issues(rows, domain, severity, candidate, confidence), index)

    return ground


env = strategy("env")(_declared("env", REPLICATED))
flags = strategy("flag")(_declared("flag", REPLICATED))


def _fields(domain: str, no_model: float) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def ground(references: DataFrame, index: DataFrame) -> DataFrame:
        """Fields (doc, model, name) against fields of models (model, name): unknown models, then fields of
        the model, of another model, like one of either, or of none."""
        # written down, as the layers ask for the probes again and again
        asked = kept(references.select("doc", "model", "name").distinct())
        # of known size, so that few models are sent to the uses, which would else meet by model
        models = kept(index.select(F.col("model").alias("_m")).distinct())
        met = asked.join(models, F.col("model") == F.col("_m"), "left")
        probes = kept(met.filter("_m is not null").select(F.col("name").alias("probe"), "model").distinct())
        # one row a probe: a table of known size, so that few answers are sent to the uses and these stay where they are
        found = kept(resolve_fields(probes, index.select("model", "name").distinct(), 0.5, 1))
        found = found.select(F.col("probe").alias("_p"), F.col("model").alias("_pm"), F.struct(F.col("name").alias("full"), "score", "layer").alias("b"))
        best = met.join(found, (F.col("name") == F.col("_p")) & (F.col("model") == F.col("_pm")), "left")
        best = best.select("doc", "model", "name", F.col("_m").isNotNull().alias("known"), (F.col("b.layer") == 0).alias("ok"), "b")
        near = F.col("b.full").isNotNull()
        severity = F.when(~F.col("known"), "unknown").when(F.col("ok"), "ok").when(near, "low").otherwise("unknown")
        confidence = F.when(~F.col("known"), no_model).when(F.col("ok"), SAME).when(near & (F.col("b.layer") < 2), OTHER_MODEL).when(near, F.col("b.score")).otherwise(NO_FIELD)
        named = best.withColumn("name", F.concat_ws(".", "model", "name"))
        return _if_any(_issues(named, domain, severity, F.when(F.col("known"), F.col("b.full")), confidence), index)

    return ground


@strategy("member")
def members(references: DataFrame, index: DataFrame) -> DataFrame:
    """Calls (doc, model, name) on receivers of known types against members of types (model, name): as fields
    are, but a type that is not indexed is another library's and no issue."""
    own = references.join(index.select("model").distinct(), "model", "left_semi")
    return _fields("member", NO_MODEL)(own, index)


models = strategy("db")(_fields("db", NO_MODEL))
graphql = strategy("graphql")(_fields("graphql", NO_FIELD))


@strategy("import")
def imports(references: DataFrame, index: DataFrame) -> DataFrame:
    """Imported names (doc, package, name) against exports (package, name) of the same package; packages that
    are not indexed give no issues."""
    asked = references.select("doc", "package", "name").distinct().join(index.select("package").distinct(), "package", "left_semi")
    known = index.select("package", F.col("name").alias("export")).distinct()
    hit = asked.join(known, (asked["package"] == known["package"]) & (F.col("name") == F.col("export")), "left").select("doc", asked["package"], "name", "export")
    open_ = hit.filter("export is null").select(F.col("name").alias("probe")).distinct()
    near = trigram_join(open_, known.select(F.col("export").alias("name")).distinct(), 0.5).withColumnRenamed("name", "export")
    near = near.join(known, "export").groupBy("probe", "package").agg(F.max_by(F.struct("export", "sim"), F.struct("sim", "export")).alias("b"))
    rows = hit.join(near.withColumnRenamed("package", "_pk"), (F.col("name") == F.col("probe")) & (hit["package"] == F.col("_pk")), "left")
    ok, some = F.col("export").isNotNull(), F.col("b").isNotNull()
    confidence = F.when(ok, SAME).when(some, F.col("b.sim")).otherwise(NO_EXPORT)
    named = rows.withColumn("name", F.concat_ws(".", hit["package"], "name"))
    return _issues(named, "import", F.when(ok, "ok").when(some, "low").otherwise("unknown"), F.coalesce("export", "b.export"), confidence)


PHRASES = r"(?:^|[^\p{L}\p{N}_])([A-Z][\p{L}\p{N}]*(?: [A-Z][\p{L}\p{N}]*){1,4})"


def phrases(texts: DataFrame) -> DataFrame:
    """(doc, name) of the capitalised phrases of texts (doc, text): two to five words in one sentence."""
    found = F.regexp_extract_all("text", F.lit(PHRASES), F.lit(1))
    return texts.select("doc", F.explode(F.array_distinct(found)).alias("name"))


@strategy("prose")
def prose(references: DataFrame, index: DataFrame) -> DataFrame:
    """Phrases (doc, name) against registered names (name): those like a name, but not it, are doubtful;
    those like none are silent."""
    asked = references.select("doc", "name").distinct()
    near = trigram_join(asked.select(F.col("name").alias("probe")).distinct(), index.select("name").distinct(), PHRASE).withColumnRenamed("name", "candidate")
    best = near.groupBy("probe").agg(F.max(F.col("probe") == F.col("candidate")).alias("same"), F.max_by(F.struct("candidate", "sim"), F.struct("sim", "candidate")).alias("b"))
    rows = asked.join(best.filter("not same"), F.col("name") == F.col("probe"))
    return _issues(rows, "prose", F.lit("low"), F.col("b.candidate"), F.col("b.sim"))


@strategy("asset")
def assets(references: DataFrame, index: DataFrame) -> DataFrame:
    """Paths (doc, name) that must be among files (name), as of assets or scripts; others are unknown."""
    asked = references.select("doc", "name").distinct()
    met = asked.join(index.select(F.col("name").alias("_n")).distinct(), F.col("name") == F.col("_n"), "left")
    ok = F.col("_n").isNotNull()
    return _if_any(_issues(met, "asset", F.when(ok, "ok").otherwise("unknown"), F.col("_n"), F.when(ok, SAME).otherwise(NO_ROUTE)), index)


# --- rewriting beyond names -----------------------------------------------------------------------

# Confidences of the strategies that look beyond the candidates.
IN_OTHER_DOMAIN, NEAR_TODO, IN_COMMENT, FORMERLY = 0.60, 0.85, 0.70, 0.50


def beyond_candidates(probes: DataFrame, elsewhere: DataFrame, lines: DataFrame, history: DataFrame) -> DataFrame:
    """(probe, verdict, confidence, name, strategy): what speaks for a name that no candidate explains.

    ``elsewhere`` (domain, name) has the names of other domains, ``lines`` (doc, n, text) the edited texts by
    line, ``history`` (name) names that were declared once. A name next to a note on open work, or within
    a comment, is accepted; the highest verdict wins, then confidence.
    """
    p = probes.select("probe").distinct()
    other = p.join(elsewhere.select("name").distinct(), F.col("probe") == F.col("name")).select("probe", F.lit("RESIDUAL").alias("verdict"), F.lit(IN_OTHER_DOMAIN).alias("confidence"), "name", F.lit("cross_domain").alias("strategy"))
    once_ = p.join(history.select("name").distinct(), F.col("probe") == F.col("name")).select("probe", F.lit("RESIDUAL").alias("verdict"), F.lit(FORMERLY).alias("confidence"), "name", F.lit("project_history").alias("strategy"))
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][\w-]*"), F.lit(0))))
    used = lines.select("doc", "n", words.alias("probe"), F.col("text").rlike(r"^\s*(?://|#|\*|/\*|--)").alias("comment")).join(p, "probe", "left_semi")
    todo = lines.filter(F.col("text").rlike(r"\b(?:TODO|FIXME)\b")).select("doc", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n")).distinct().withColumn("todo", F.lit(True))
    told = used.join(todo, ["doc", "n"], "left").filter("todo or comment").groupBy("probe").agg(F.max(F.when(F.col("todo"), NEAR_TODO).otherwise(IN_COMMENT)).alias("confidence"))
    noted = told.select("probe", F.lit("ACCEPT_SDK").alias("verdict"), "confidence", F.col("probe").alias("name"), F.lit("comment_context").alias("strategy"))
    every = other.unionByName(once_).unionByName(noted)
    w = Window.partitionBy("probe").orderBy(F.desc(F.col("verdict") == "ACCEPT_SDK"), F.desc("confidence"), "strategy")
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def apply_rewrites(texts: DataFrame, winners: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, log): texts (doc, text) with the names of REPLACE winners (probe, verdict, confidence, name,
    strategy) replaced where they stand as words, and one log row for each name that a text has.

    Names of ``blacklist`` (name) are never replaced and logged as ``blocked``.
    """
    blocked = blacklist.select(F.col("name").alias("probe"), F.lit(True).alias("_b")).distinct()
    w = winners.join(blocked, "probe", "left").withColumn("verdict", F.when(F.col("_b"), "blocked").otherwise(F.col("verdict"))).drop("_b")
    words = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("probe"))
    log = words.join(w, "probe").select("doc", "probe", "verdict", "strategy", "name")
    changes = log.filter("verdict = 'REPLACE'").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("probe", "name"))).alias("c"))
    replaced = F.aggregate("c", F.col("text"), lambda t, c: F.regexp_replace(t, F.concat(F.lit(r"\b\Q"), c["probe"], F.lit(r"\E\b")), F.regexp_replace(c["name"], r"([\\$])", r"\\$1")))
    made = texts.join(changes, "doc", "left").select("doc", F.when(F.col("c").isNull(), F.col("text")).otherwise(replaced).alias("text"))
    return made, log

