"""Name resolution: layered cascades, fuzzy symbols, rewriting of names.

The batch form answers all probes at once. Each layer is a DataFrame of matches; a probe keeps the
matches of its first layer that has any, which is what early exit does for one probe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import fold_separators, rerank_score, trigram_best, trigram_join, whole_trigrams
from quarry.operators.retrieval import cosine_top_k, top_k
from quarry.session import kept

THRESHOLD, SALVAGE, FETCH = 0.40, 0.28, 50


def cascade(layers: Sequence[DataFrame], limit: int, by: str = "probe") -> DataFrame:
    """(probe, name, score, layer, place) of layers (probe, name, score), by score and then name."""
    every = None
    for number, one in enumerate(layers):
        part = one.select(by, "name", F.col("score").cast("double").alias("score"), F.lit(number).alias("layer"))
        every = part if every is None else every.union(part)
    if every is None:
        raise ValueError("no layers")
    first = every.withColumn("_first", F.min("layer").over(Window.partitionBy(by))).filter("layer = _first").drop("_first")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "name"))
    return first.withColumn("place", place).filter(F.col("place") <= limit)


def exact(probes: DataFrame, names: DataFrame) -> DataFrame:
    return probes.select("probe").join(names.select("name").distinct(), F.col("probe") == F.col("name")).select("probe", "name", F.lit(1.0).alias("score"))


def by_alias(probes: DataFrame, names: DataFrame) -> DataFrame:
    """Matches of names that list the probe among their ``aliases``."""
    listed = names.select("name", F.explode("aliases").alias("alias")).distinct()
    return probes.select("probe").join(listed, F.col("probe") == F.col("alias")).select("probe", "name", F.lit(1.0).alias("score"))


def fuzzy(probes: DataFrame, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    return trigram_join(probes, names, threshold).select("probe", "name", F.col("sim").alias("score"))


def fuzzy_first(probes: DataFrame, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of each probe the first row of ``fuzzy`` by score, then name: enough where one is asked for."""
    return trigram_best(probes, names, threshold).select("probe", "name", F.col("sim").alias("score"))


def unmatched(probes: DataFrame, *layers: DataFrame) -> DataFrame:
    """The probes that none of the layers answers; later layers need no others."""
    done = reduce(DataFrame.union, [x.select("probe") for x in layers]).distinct()
    return probes.join(done, "probe", "left_anti")


def resolve_names(probes: DataFrame, names: DataFrame, threshold: float = 0.5, limit: int = 5) -> DataFrame:
    """Exact, then by alias where names have ``aliases``, then fuzzy: flags, variables, models, classes,
    keys, registered names."""
    layers = [exact(probes, names)]
    if "aliases" in names.columns:
        layers.append(by_alias(probes, names))
    return cascade([*layers, fuzzy(unmatched(probes, *layers), names, threshold)], limit)


def resolve_exports(probes: DataFrame, exports: DataFrame, threshold: float = 0.5, limit: int = 5) -> DataFrame:
    """(probe, package, name, score, layer, place): exact, then fuzzy, among the exports of the package.

    ``probes`` (probe, package), ``exports`` (package, name).
    """
    same = probes.join(exports.withColumnRenamed("package", "_p"), (F.col("package") == F.col("_p")) & (F.col("probe") == F.col("name")))
    hit = same.select("probe", "package", "name", F.lit(1.0).alias("score"))
    open_ = probes.join(hit.select("probe", "package"), ["probe", "package"], "left_anti")
    near = trigram_join(open_, exports, threshold).join(open_, "probe").join(exports.distinct(), ["package", "name"])
    both = [df.select(F.struct("probe", "package").alias("key"), "name", "score") for df in (hit, near.withColumnRenamed("sim", "score"))]
    return cascade(both, limit, "key").select("key.probe", "key.package", "name", "score", "layer", "place")


# Places that declare a variable, rather than use it.
CANONICAL = ("env-example", "zod-schema", "envalid", "docker-compose", "github-actions")


def resolve_env(probes: DataFrame, declared: DataFrame, threshold: float = 0.5, limit: int = 5, exclude: Sequence[str] = ()) -> DataFrame:
    """(probe, name, source, score, layer, place): exact, then fuzzy; between equals, declarations first.

    ``declared`` (name, source); sources in ``exclude`` do not count.
    """
    known = declared.filter(~F.col("source").isin(*exclude)) if exclude else declared
    known = known.select("name", "source").distinct()
    same = exact(probes, known).join(known, "name").withColumn("layer", F.lit(0))
    near = fuzzy(unmatched(probes, same), known, threshold).join(known, "name").withColumn("layer", F.lit(1))
    order = [F.desc("score"), F.desc(F.col("source").isin(*CANONICAL)), F.asc("name"), F.asc("source")]
    every = same.unionByName(near).withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*order)))
    return every.filter(F.col("place") <= limit).select("probe", "name", "source", "score", "layer", "place")


def check_new_pages(probes: DataFrame, pages: DataFrame, threshold: float = THRESHOLD, limit: int = 5) -> DataFrame:
    """(probe, name, kind, score, layer, place): whether a page's route is taken: exact (pages before other
    kinds), then by pattern, then fuzzy. ``pages`` (name, kind)."""
    kinds = pages.select("name", "kind").distinct()
    found = resolve_routes(probes.select("probe", F.lit("*").alias("method")).distinct(), pages.select(F.lit("*").alias("method"), "name").distinct(), threshold, FETCH)
    order = [F.desc("score"), F.desc(F.col("kind") == "page"), F.asc("name"), F.asc("kind")]
    joined = found.drop("place").join(kinds, "name").withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*order)))
    return joined.filter(F.col("place") <= limit).select("probe", "name", "kind", "score", "layer", "place")


def resolve_fields(probes: DataFrame, fields: DataFrame, threshold: float = 0.5, limit: int = 5) -> DataFrame:
    """(probe, model, name, score, layer, place): fields of models: on the model asked for, on any model, like
    one on the model, like one anywhere. Each (probe, model) is answered for itself.

    ``probes`` (probe, model), ``fields`` (model, name); the result's names are ``model.field``. A name that
    many models have is worth its first ``limit`` models, as no more could be given out; the own model's row
    comes by a join of its own.
    """
    f = fields.select(F.col("model").alias("owner"), "name").distinct().withColumn("full", F.concat_ws(".", "owner", "name"))
    few = top_k(f, ["name"], [F.asc("full")], limit).withColumnRenamed("name", "field")
    asked = probes.select("probe", "model").distinct()
    rows = lambda df, score: df.select(F.struct("probe", "model").alias("key"), F.col("full").alias("name"), score.alias("score"))
    own = asked.join(f, (F.col("probe") == F.col("name")) & (F.col("model") == F.col("owner")))
    any_ = asked.join(few, F.col("probe") == F.col("field"))
    near = trigram_join(unmatched(asked, any_).select("probe"), f, threshold)
    close = asked.join(near, "probe")
    here = close.withColumnRenamed("name", "field").join(f, (F.col("field") == F.col("name")) & (F.col("model") == F.col("owner")))
    there = close.join(few, F.col("name") == F.col("field")).drop("name")
    one, sim = F.lit(1.0), F.col("sim")
    layers = [rows(own, one), rows(any_, one), rows(here, sim), rows(there, sim)]
    return cascade(layers, limit, "key").select("key.probe", "key.model", "name", "score", "layer", "place")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


#: Rows of a table of patterns' edges that may be sent to all executors.
EDGES = 200_000


def match_routes(probes: DataFrame, routes: DataFrame) -> DataFrame:
    """(probe, method, name) of every route whose pattern a path matches: ``probes`` (probe, method), ``routes``
    (method, name); a method ``*`` fits all. Parameters (``:x``) match a segment, a last ``*`` any rest.

    Patterns are a trie by segments, kept as a table: a node is the pattern up to it, an edge a literal or
    a parameter. Paths descend level by level, each by one equi-join on (node, label) with its own segment and
    with the parameter; there are as many levels as the longest pattern has, and no pattern meets all paths.
    """
    parts = routes.select(F.col("method").alias("rmethod"), "name", _segments(F.col("name")).alias("p")).distinct()
    rest = F.coalesce(F.try_element_at("p", F.lit(-1)) == "*", F.lit(False))
    label = lambda s: F.when(s.startswith(":"), ":").otherwise(F.concat(F.lit("="), s))
    fixed = parts.withColumn("rest", rest).withColumn("l", F.transform(F.when(F.col("rest"), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p")), label))
    node = lambda upto: F.array_join(F.slice("l", F.lit(1), upto), "/")
    ends = kept(fixed.select(node(F.size("l")).alias("node"), "rmethod", "name", "rest", F.size("l").alias("depth")))
    steps = F.transform(F.col("l"), lambda x, i: F.struct(node(i).alias("node"), x.alias("label"), node(i + 1).alias("child")))
    edges = kept(fixed.select(F.explode(steps).alias("e")).select("e.*").distinct())
    if edges.count() <= EDGES:
        edges, ends = F.broadcast(edges), F.broadcast(ends)  # no more ends than edges and roots
    depth = ends.agg(F.max("depth")).first()[0]
    asked = probes.select("probe", "method").distinct().withColumn("s", _segments(F.col("probe")))
    # the root, but no constant that the optimizer would take out of the join's keys
    level = asked.filter(F.col("probe").startswith("/") | (F.size("s") == 0)).withColumn("node", F.substring("probe", 1, 0))
    found = None
    for at in range((depth or 0) + 1):
        fits = (F.col("method") == F.col("rmethod")) | (F.col("rmethod") == "*")
        here = level.join(ends, "node").filter(fits & (F.col("rest") | (F.size("s") == at))).select("probe", "method", "name")
        found = here if found is None else found.union(here)
        labels = F.array(F.concat(F.lit("="), F.get("s", F.lit(at))), F.lit(":"))
        level = level.filter(F.size("s") > at).withColumn("label", F.explode(labels)).join(edges, ["node", "label"]).select("probe", "method", "s", F.col("child").alias("node"))
    return found.distinct()


def resolve_routes(probes: DataFrame, routes: DataFrame, threshold: float = 0.3, limit: int = 5) -> DataFrame:
    """Exact, then by pattern (longest first), then fuzzy. ``probes`` (probe, method), ``routes`` (method,
    name); a method ``*`` fits all."""
    fits = (F.col("method") == F.col("rmethod")) | (F.col("rmethod") == "*")
    r = routes.select(F.col("method").alias("rmethod"), "name")
    same = probes.join(r, (F.col("probe") == F.col("name")) & fits).select("probe", "name", F.lit(1.0).alias("score"))
    pattern = match_routes(probes, routes).select("probe", "name", F.length("name").cast("double").alias("score")).distinct()
    near = fuzzy_first if limit == 1 else fuzzy
    return cascade([same, pattern, near(unmatched(probes, same, pattern), routes, threshold)], limit)


def resolve_symbols(probes: DataFrame, names: DataFrame, threshold: float = THRESHOLD, salvage: float = SALVAGE, limit: int = 5) -> DataFrame:
    """(probe, name, sim, edits, score, place): the 50 most similar, ranked again by length, prefixes and
    edits. Probes without a match get another try at ``salvage`` with few edits."""
    edits = F.levenshtein(F.lower("probe"), F.lower("name"))
    strong = trigram_join(probes, names, threshold).withColumn("edits", edits)
    # the weak join, whose common trigrams are many, is for the probes that found nothing
    weak = trigram_join(unmatched(probes, strong), names, min(threshold, salvage)).withColumn("edits", edits)
    weak = weak.filter(F.col("edits") <= F.greatest(F.lit(2), F.floor(F.length("probe") / 3).cast("int")))
    rows = strong.unionByName(weak)
    fetched = rows.withColumn("_n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("sim"), "name"))).filter(F.col("_n") <= FETCH)
    again = fetched.withColumn("score", rerank_score(F.col("probe"), F.col("name"), F.col("sim"), F.levenshtein("probe", "name")))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "name"))
    return again.withColumn("place", place).filter(F.col("place") <= limit).select("probe", "name", "sim", "edits", "score", "place")


def check_names(layers: dict[str, DataFrame], probes: DataFrame, sure: float = 0.75) -> DataFrame:
    """(probe, domain, name, score, status): domains in order, the first with a hit decides: OK, TYPO,
    UNCERTAIN, or UNKNOWN without a hit. ``layers`` are results of cascades by domain."""
    every = None
    for number, (domain, hits) in enumerate(layers.items()):
        part = hits.filter("place = 1").select("probe", F.lit(number).alias("n"), F.lit(domain).alias("domain"), "name", "score", "layer")
        every = part if every is None else every.union(part)
    if every is None:
        raise ValueError("no domains")
    best = every.groupBy("probe").agg(F.min_by(F.struct("domain", "name", "score", "layer"), F.col("n")).alias("b"))
    status = F.when(F.col("b").isNull(), "UNKNOWN").when(F.col("b.layer") == 0, "OK").when(F.col("b.score") >= sure, "TYPO").otherwise("UNCERTAIN")
    return probes.select("probe").distinct().join(best, "probe", "left").select("probe", "b.domain", "b.name", "b.score", status.alias("status"))


# --- rewriting ------------------------------------------------------------------------------------

PRIORITY = {"OK": 4, "ACCEPT_SDK": 3, "REPLACE": 2, "RESIDUAL": 1}
SUFFIXES = ("_KEY", "_SECRET", "_TOKEN", "_URL", "_HOST")


def by_meaning(probes: DataFrame, names: DataFrame, embed: Callable[[DataFrame], DataFrame], threshold: float = 0.85, k: int = 3) -> DataFrame:
    """(probe, name, sim): of each probe's ``k`` nearest names by the vectors of their words, those near enough.

    ``embed`` maps (id, text) to (id, vector), as ``meaning.LearnedVectors.embed`` of texts with such names does.
    """
    keyed = lambda df, c: df.select(F.xxhash64(c).alias("id"), c, fold_separators(F.col(c)).alias("text"))
    p, n = keyed(probes.select("probe").distinct(), "probe"), keyed(names.select("name").distinct(), "name")
    near = cosine_top_k(embed(n.select("id", "text")), embed(p.select("id", "text")).withColumnRenamed("id", "query_id"), k).filter(F.col("score") >= threshold)
    met = near.join(p.select(F.col("id").alias("query_id"), "probe"), "query_id").join(n.select("id", "name"), "id")
    return met.filter(F.col("probe") != F.col("name")).select("probe", "name", F.col("score").alias("sim"))


def one_token_off(probes: DataFrame, names: DataFrame) -> DataFrame:
    """(probe, name): the first names, by name, that differ from a probe in one ``_``-separated token: another
    one, one more or one less; the first of all such names is among them.

    Both sides are keyed by what one change leaves: a token masked on both, or a token left out on one.
    All names of one token share a key, so of each key only the first two names are kept (one may be the
    probe itself), and what a probe meets follows its tokens, not the names.
    """
    split = lambda c: F.split(c, "_")
    masked = lambda t: F.transform(t, lambda w, i: F.concat(F.lit("="), F.array_join(F.transform(t, lambda x, j: F.when(i == j, "*").otherwise(x)), "_")))
    less = lambda t, tag: F.transform(t, lambda w, i: F.concat(F.lit(tag), F.array_join(F.filter(t, lambda x, j: i != j), "_")))
    whole = lambda t, tag: F.array(F.concat(F.lit(tag), F.array_join(t, "_")))
    of_probe = F.array_distinct(F.concat(masked(split("probe")), less(split("probe"), "-"), whole(split("probe"), "+")))
    of_name = F.array_distinct(F.concat(masked(split("name")), whole(split("name"), "-"), less(split("name"), "+")))
    first = top_k(names.select("name").distinct().select("name", F.explode(of_name).alias("k")), ["k"], [F.asc("name")], 2)
    met = probes.select("probe").distinct().select("probe", F.explode(of_probe).alias("k")).join(first, "k")
    return met.filter(F.col("probe") != F.col("name")).select("probe", "name").distinct()


def rewrite(
    probes: DataFrame, names: DataFrame, threshold: float = 0.7, accepted: Sequence[str] = (), abbreviations: dict[str, str] | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(probe, verdict, confidence, name, strategy): every strategy proposes; the highest verdict wins,
    then confidence, then the order of strategies and of candidates by name.

    Candidates of a probe come from joins on what a strategy compares: the name itself, its folded
    form, its sorted tokens, its prefix, its trigrams or its tokens; ``embed`` adds names of like meaning.
    """
    p, n = probes.select("probe").distinct(), names.select("name").distinct()
    pick = lambda df, verdict, conf, order, label: df.select(
        "probe", F.lit(verdict).alias("verdict"), conf.cast("double").alias("confidence"), F.col("name"), F.lit(order).alias("o"), F.lit(label).alias("strategy")
    )
    differ = F.col("probe") != F.col("name")
    bag = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(fold_separators(c), " "))), " ")
    folded = p.withColumn("k", fold_separators(F.col("probe"))).join(n.withColumn("k", fold_separators(F.col("name"))), "k").filter(differ)
    bagged = p.withColumn("k", bag(F.col("probe"))).join(n.withColumn("k", bag(F.col("name"))), "k").filter(differ & (F.col("k") != ""))
    expanded = p.select("probe", F.split("probe", "_").alias("t"))
    table = F.create_map(*[F.lit(x) for kv in (abbreviations or {"": ""}).items() for x in kv])
    variants = F.transform(F.filter(F.transform("t", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.element_at(table, x["w"]).isNotNull()),
                           lambda x: F.array_join(F.transform("t", lambda w, i: F.when(i == x["i"], F.element_at(table, w)).otherwise(w)), "_"))
    every = F.array_join(F.transform("t", lambda w: F.coalesce(F.element_at(table, w), w)), "_")
    acronyms = expanded.select("probe", F.explode(F.array_distinct(F.concat(variants, F.array(every)))).alias("v")).join(n, F.col("v") == F.col("name")).filter(differ)
    edited = one_token_off(p, n)
    stem = lambda df, c: df.withColumn("s", F.explode(F.array(*[F.lit(s) for s in SUFFIXES]))).filter(F.col(c).endswith(F.col("s"))).select(c, F.substring(F.col(c), F.lit(1), F.length(c) - F.length("s")).alias("k"))
    paired = stem(p, "probe").join(stem(n, "name"), "k")
    close = trigram_join(p, n, threshold, grams=whole_trigrams)
    proposals = [
        pick(p.join(n, F.col("probe") == F.col("name")), "OK", F.lit(1.0), 0, "exact"),
        pick(p.filter(F.col("probe").isin(*accepted)).withColumn("name", F.col("probe")), "ACCEPT_SDK", F.lit(1.0), 1, "catalog"),
        pick(acronyms, "REPLACE", F.lit(0.95), 2, "acronym"),
        pick(folded, "REPLACE", F.lit(0.95), 3, "case_normalize"),
        pick(edited, "REPLACE", F.lit(0.85), 4, "token_edit"),
        pick(close, "REPLACE", F.col("sim"), 5, "trigram"),
        pick(bagged, "REPLACE", F.lit(0.9), 6, "token_set"),
        pick(paired, "RESIDUAL", F.lit(0.4), 7, "suffix"),
        pick(p.withColumn("name", F.lit(None).cast("string")), "RESIDUAL", F.lit(0.0), 8, "none"),
    ]
    if embed:
        near = by_meaning(p, n, embed)
        proposals.append(pick(near, "REPLACE", F.col("sim"), 9, "embedding"))
    union = proposals[0]
    for more in proposals[1:]:
        union = union.union(more)
    strength = F.lit(0)
    for verdict, value in PRIORITY.items():
        strength = F.when(F.col("verdict") == verdict, value).otherwise(strength)
    w = Window.partitionBy("probe").orderBy(strength.desc(), F.desc("confidence"), "o", "name")
    return union.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("probe", "verdict", "confidence", "name", "strategy")


def replace_whole_word(text: Column, name: Column, replacement: Column) -> Column:
    """``text`` with the name replaced where it stands as a word of its own."""
    return F.regexp_replace(text, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")), replacement)

