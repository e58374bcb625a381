"""String similarity as Catalyst expressions, and the similarity join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import once
from quarry.session import kept


def _grams(padded: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams of each word of letters and digits, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" "))))))


def whole_trigrams(text: Column) -> Column:
    """Distinct trigrams of the whole string as one padded word."""
    return F.array_distinct(_grams(F.concat(F.lit("  "), F.lower(text), F.lit(" "))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    return jaccard(word_trigrams(a), word_trigrams(b))


def rerank_score(query: Column, name: Column, sim: Column, edits: Column, qualified: Column | None = None) -> Column:
    """Similarity damped by the ratio of lengths, with bonuses for prefixes, parts and few edits."""
    q, n = F.lower(query), F.lower(name)
    score = F.when(q == n, 0.25).otherwise(0.0) + F.when(n.startswith(q) | q.startswith(n), 0.15).otherwise(0.0)
    score = score + F.when(F.contains(n, q) | F.contains(q, n), 0.08).otherwise(0.0)
    if qualified is not None:
        score = score + F.when(F.coalesce(F.contains(F.lower(qualified), q), F.lit(False)), 0.04).otherwise(0.0)
    score = score + F.when(edits == 0, 0.5).when(edits == 1, 0.3).when(edits == 2, 0.15).when(edits == 3, 0.05).otherwise(0.0)
    a, b = F.greatest(F.length(name), F.lit(1)), F.greatest(F.length(query), F.lit(1))
    return sim * F.pow(F.least(a, b) / F.greatest(a, b), F.lit(0.5)) + score


def trigram_join(
    probes: DataFrame, names: DataFrame, threshold: float, probe: str = "probe", name: str = "name", grams: Callable[[Column], Column] = word_trigrams
) -> DataFrame:
    """(probe, name, sim) of every pair of distinct strings with trigram similarity of at least
    ``threshold``, by words or, with ``whole_trigrams``, by whole strings.

    Two sets whose Jaccard is t share at least t of the larger, so some shared trigram is among the
    first ``n - ceil(t n) + 1`` of each in a common order. Rarest first, these prefixes are joined; a pair
    that meets is verified. Frequent trigrams hardly ever enter a prefix, so no posting list is hot.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    left = probes.select(probe).distinct().select(probe, grams(F.col(probe)).alias("tp")).filter(F.size("tp") > 0)
    right = names.select(name).distinct().select(name, grams(F.col(name)).alias("tn")).filter(F.size("tn") > 0)
    freq = right.select(F.explode("tn").alias("g")).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame, key: str, own: str) -> DataFrame:
        rows = side.select(key, own, F.explode(own).alias("g")).join(freq, "g", "left")
        rarest = rows.groupBy(key, own).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("r"))
        keep = F.size(own) - F.ceil(F.size(own) * F.lit(threshold) - 1e-9).cast("int") + 1
        return rarest.select(key, own, F.explode(F.slice("r", 1, keep)["g"]).alias("g"))

    met = prefix(left, probe, "tp").join(prefix(right, name, "tn"), "g").select(probe, name, "tp", "tn").distinct()
    sizes = F.least(F.size("tp"), F.size("tn")) >= F.lit(threshold) * F.greatest(F.size("tp"), F.size("tn")) - 1e-9
    scored = met.filter(sizes).select(probe, name, jaccard(F.col("tp"), F.col("tn")).alias("sim"))
    return scored.filter(F.col("sim") >= threshold)


def _packed(grams: Column) -> Column:
    """Trigrams as numbers of three code points: the same sets, shorter and quicker to compare."""
    point = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(grams, lambda g: F.shiftleft(point(g, 1), 42).bitwiseOR(F.shiftleft(point(g, 2), 21)).bitwiseOR(point(g, 3)))


def trigram_best(probes: DataFrame, names: DataFrame, threshold: float, probe: str = "probe", name: str = "name") -> DataFrame:
    """(probe, name, sim): the first row by similarity, then name, that ``trigram_join`` has for each probe.

    Names of one set of trigrams are worth the first of them. Sets of m and n whose Jaccard is t share at least
    o = t / (1 + t) (m + n), so in a common order, rarest first, the first shared trigram has a place of at
    most m - o in one and n - o in the other. Rows meet by trigram and size of the name's set, a probe's only
    for sizes that its place allows: a frequent trigram, late in the order, asks hardly any size. The
    probes are asked at a higher threshold first, where prefixes are short; only those without a match go on.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    grams = lambda c: F.array_sort(_packed(word_trigrams(F.col(c))))
    left = probes.select(F.col(probe).alias("_p")).distinct().select("_p", grams("_p").alias("t")).filter(F.size("t") > 0)
    right = names.select(F.col(name).alias("_n")).distinct().select("_n", grams("_n").alias("t")).filter(F.size("t") > 0)
    right = kept(right.groupBy("t").agg(F.min("_n").alias("_n")))
    freq = kept(right.select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("df")))
    longest = right.agg(F.max(F.size("t"))).first()[0] or 0

    def ordered(side: DataFrame, key: str) -> DataFrame:
        """Sets with the rarest first."""
        rows = side.select(key, F.explode("t").alias("g")).join(freq, "g", "left")
        return kept(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")))["g"].alias("t")))

    open_, index = ordered(left, "_p"), ordered(right, "_n").withColumnRenamed("t", "tn")
    out = None
    for least in [t for t in (1.5 * threshold, threshold) if t < 1 or t == threshold]:
        share = least / (1 + least)
        m, n, at = F.size("t"), F.size("tn"), F.col("i")
        # the greatest size that shares enough of what is left of the probe's set from this place on
        low, high = F.ceil(least * m - 1e-9).cast("int"), F.least(F.floor(m / least + 1e-9), F.floor((m - at) / share - m + 1e-9), F.lit(longest)).cast("int")
        asked = open_.select("_p", "t", F.posexplode("t").alias("i", "g")).filter(low <= high).select("_p", "t", "i", "g", F.explode(F.sequence(low, high)).alias("size"))
        given = index.select("_n", "tn", F.posexplode("tn").alias("j", "g")).filter(F.col("j") <= n - F.ceil(least * n - 1e-9)).withColumn("size", n)
        enough = F.ceil(share * (m + n) - 1e-9)
        met = asked.join(given, ["g", "size"]).filter(F.col("j") <= n - enough)
        near = met.select("_p", "_n", jaccard(F.col("t"), F.col("tn")).alias("sim")).filter(F.col("sim") >= least)
        best = kept(near.groupBy("_p").agg(F.min(F.struct((-F.col("sim")).alias("s"), "_n")).alias("b")))
        open_ = open_.join(best.select("_p"), "_p", "left_anti")
        rows = best.select(F.col("_p").alias(probe), F.col("b._n").alias(name), (-F.col("b.s")).alias("sim"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fold_separators(name: Column) -> Column:
    """Camel case, dashes and underscores as single blanks, in lower case."""
    s = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.trim(F.translate(s, "-_", "  ")), r"\s+", " ")


def token_edits(a: Column, b: Column) -> Column:
    """Edit distance over ``_``-separated tokens: each distinct token becomes one character."""
    x, y = F.split(a, "_"), F.split(b, "_")

    def of(known: Column) -> Column:
        coded = lambda t: F.array_join(F.transform(t, lambda w: F.char(F.array_position(known, w) + 64)), "")
        return F.levenshtein(coded(x), coded(y))

    return once(F.array_distinct(F.concat(x, y)), of)
