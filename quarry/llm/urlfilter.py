"""URL filters by Bloom filter cascades.

A cascade answers membership in a list exactly, for every key of a known universe, from a few bit
arrays. Level 0 encodes the listed keys; level 1 the unlisted keys that level 0 lets through; level 2 the
listed keys that level 1 lets through, and so on until a level lets nothing through. The first level
that rejects a key decides. The universe is the corpus's own keys, all of them, so nothing is left to
chance, and filtering needs no join with the list.

Level 0 takes as many bits a key as let about as many unlisted keys through as are listed; so a
cascade's size follows the list, and only the logarithm of the universe.

Rules are (host, path) prefixes. A URL's keys are all pairs of one of its host's suffixes and one of
its path's prefixes at the lengths that rules have; the longest listed key is its rule. URLs without a
rule are judged by a list of site sections.

Sizes: the arrays of up to ``CONSTANT_KEYS`` listed keys are constants of the plan. Those of a longer
list are cut by a hash of the key into shards of ``SHARD_KEYS``, and a row meets its key's shard; hot
shards are salted. Rules are a list in the driver's memory, so their cascades are always constants.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and is allowed;
repeated rows are judged alike; an empty list allows all; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, ascii_lower, at_shards, hot_of, let, long_array

CONSTANT_KEYS = 1_000_000
SHARD_KEYS = 50_000
#: Bits a key and probes of all levels but the first, which has at least as many.
BITS_A_KEY = 10
PROBES = 5
MOST_BITS = 64
MAX_LEVELS = 60


class Level(NamedTuple):
    """Sizes of one level's bit arrays."""

    number: int
    bits: int
    probes: int

    def passes(self, words: Column, key: Column) -> Column:
        spots = self.positions(key)
        found = [F.call_function("getbit", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in spots]
        return functools.reduce(Column.__and__, found)

    def positions(self, key: Column) -> list[Column]:
        """Bits of a key; the hashes of one level tell nothing about those of another."""
        a = F.xxhash64(F.lit(2 * self.number), key).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
        b = F.xxhash64(F.lit(2 * self.number + 1), key).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
        return [F.pmod(a + b * j, F.lit(self.bits)) for j in range(self.probes)]


class Cascade:
    """Exact membership of universe keys in a list.

    ``words`` is (shard, words), with an array of the bits of each level.
    """

    def __init__(self, levels: list[Level], words: DataFrame, shards: int) -> None:
        self.levels, self.words, self.shards = levels, words, shards
        self.constant = None if shards > 1 else [long_array(x) for r in words.collect() for x in r["words"]]

    @staticmethod
    def _shard(key: Column, shards: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)).cast("int")

    @classmethod
    def build(cls, flagged: DataFrame, scratch: Scratch) -> Cascade:
        """From ``flagged`` (key, listed), the whole universe, each key once."""
        sizes = flagged.agg(F.count("*"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
        n, listed = int(sizes[0]), int(sizes[1])
        shards = 1 if listed <= CONSTANT_KEYS else -(-listed // SHARD_KEYS)
        left = scratch.keep(flagged.select("key", "listed", cls._shard(F.col("key"), shards).alias("shard")))
        # bits a key at which as many unlisted keys pass as are listed, were hashes perfect
        first = min(MOST_BITS, max(BITS_A_KEY, math.ceil(math.log2(max(1, n - listed) / max(1, listed)) / math.log(2))))
        levels: list[Level] = []
        kept: list[DataFrame] = []
        for number in range(MAX_LEVELS):
            own = F.col("listed") == (number % 2 == 0)
            most = left.filter(own).groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if most is None:
                break
            each = first if number == 0 else BITS_A_KEY
            level = Level(number, max(64, -(-most * each // 64) * 64), PROBES if number else max(PROBES, round(each * math.log(2))))
            made = scratch.keep(cls._arrays(left.filter(own), level, shards))
            levels.append(level)
            kept.append(made.select("shard", F.lit(number).alias("level"), "words"))
            # keys of this level's class all pass; of the other class only false positives go on
            met = left.filter(~own).join(F.broadcast(made) if shards == 1 else made, "shard").filter(level.passes(F.col("words"), F.col("key")))
            left = scratch.keep(left.filter(own).unionByName(met.drop("words")))
        else:
            raise RuntimeError(f"no exact cascade in {MAX_LEVELS} levels")
        if not kept:
            return cls([], flagged.sparkSession.createDataFrame([], "shard int, words array<array<bigint>>"), 1)
        every = functools.reduce(DataFrame.unionByName, kept)
        words = every.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("level", "words")))["words"].alias("words"))
        return cls(levels, scratch.keep(words), shards)

    @staticmethod
    def _arrays(keys: DataFrame, level: Level, shards: int) -> DataFrame:
        """(shard, words): the level's bit array of each shard."""
        spots = keys.select("shard", F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
        spots = spots.select("shard", F.shiftright("p", 6).cast("int").alias("w"), bit.alias("b"))
        blank = keys.sparkSession.range(shards).select(
            F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(level.bits // 64 - 1))).alias("w"), F.lit(0).cast("long").alias("b")
        )
        words = spots.unionByName(blank).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
        return words.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("w", "b")))["b"].alias("words"))

    def _decide(self, words: list[Column], key: Column) -> Column:
        """The first level that rejects a key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.passes(words[level.number], key), level.number % 2 == 1).otherwise(answer)
        return answer

    def listed(self, key: Column) -> Column:
        """Whether a universe key is listed, as an expression; for cascades of one shard."""
        if self.constant is None:
            raise ValueError("a cascade of several shards goes by mark()")
        return self._decide(self.constant, key)

    def mark(self, rows: DataFrame, key: str, out: str, salt: Column) -> DataFrame:
        """``rows`` with ``out``: whether their universe key is listed; null for a null key."""
        if self.constant is not None:
            return rows.withColumn(out, F.when(F.col(key).isNotNull(), self.listed(F.col(key))))
        shard = self._shard(F.col(key), self.shards)
        counts = rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))
        hot = hot_of(counts, "shard", counts.agg(F.sum("n")).first()[0] or 0)
        use = lambda words: self._decide([F.get(words, F.lit(x.number)) for x in self.levels], F.col(key))
        marked = at_shards(rows, shard, self.words, use, hot, salt, out)
        return marked.withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce(out, F.lit(False))))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Shape(NamedTuple):
    """What rules look like: how many labels their hosts have and how long their paths are."""

    labels: list[int]
    lengths: list[int]

    @classmethod
    def of(cls, rules: list[tuple[str, str, str]]) -> Shape:
        return cls(sorted({h.count(".") + 1 for h, _, _ in rules}), sorted({len(p) for _, p, _ in rules}))


def site_keys(host: Column, path: Column, shape: Shape) -> Column:
    """All (suffix of the host + prefix of the path) of a shape that rules have, longest first."""

    def of(labels: Column) -> Column:
        n = F.size(labels)
        suffixes = F.array(*[F.when(n >= c, F.array_join(F.slice(labels, -c, c), ".")) for c in shape.labels])
        prefixes = F.array(*[F.when(F.length(path) >= k, F.left(path, F.lit(k))) for k in shape.lengths])
        given = lambda x: F.filter(x, lambda v: v.isNotNull())
        pairs = F.flatten(F.transform(given(suffixes), lambda s: F.transform(given(prefixes), lambda p: F.concat(s, p))))
        ranked = F.array_sort(F.transform(F.array_distinct(pairs), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
        return ranked["k"]

    none = F.array().cast("array<string>")
    return F.when(host != "", let(F.split(host, r"\."), of)).otherwise(none) if shape.labels else none


def section_key(host: Column, path: Column) -> Column:
    """Host and first path segment; null without a host."""
    return F.when(host != "", F.concat(host, F.lit("/"), F.regexp_extract(path, r"^/([^/]*)", 1), F.lit("/")))


def junk_sections(pages: DataFrame) -> DataFrame:
    """(key, listed) of every section: listed if most of its pages have decoration for a title."""
    host, path = split_url(F.col("url"))
    junk = F.coalesce(F.col("html").rlike(r"<title>[^<]*[*#%$]{3}"), F.lit(False))
    rows = pages.select(section_key(host, path).alias("key"), junk.cast("int").alias("junk")).filter("key is not null")
    return rows.groupBy("key").agg((2 * F.sum("junk") > F.count("*")).alias("listed"))


def rule_keys(pages: DataFrame, rules: list[tuple[str, str, str]]) -> tuple[DataFrame, Shape]:
    """(key, kind) of the universe of rule keys in ``pages``, with the kind of rule each is listed as, and
    the rules' shape. Of two rules alike the last counts."""
    shape = Shape.of(rules)
    host, path = split_url(F.col("url"))
    sites = pages.select(host.alias("host"), F.left(path, F.lit(max(shape.lengths, default=0))).alias("path")).distinct()
    keys = sites.select(F.explode(site_keys(F.col("host"), F.col("path"), shape)).alias("key")).distinct()
    kinds = {h + p: verdict for h, p, verdict in rules}
    known = pages.sparkSession.createDataFrame(list(kinds.items()), "key string, kind string")
    return keys.join(known, "key", "left"), shape


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], sections: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` are (host, path, allow | block); ``sections`` is the universe (key, listed) of sections.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    keys, shape = rule_keys(pages, rules)
    universe = scratch.keep(keys)
    allow = Cascade.build(universe.select("key", F.coalesce(F.col("kind") == "allow", F.lit(False)).alias("listed")), scratch)
    block = Cascade.build(universe.select("key", F.coalesce(F.col("kind") == "block", F.lit(False)).alias("listed")), scratch)
    bad = Cascade.build(scratch.keep(sections.select("key", "listed")), scratch)
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = F.filter(site_keys(F.col("host"), F.col("path"), shape), lambda k: allow.listed(k) | block.listed(k))
    # only pages without a rule are looked up by section
    rows = rows.withColumn("rule", F.get(found, F.lit(0)))
    rows = rows.withColumn("section", F.when(F.col("rule").isNull(), section_key(F.col("host"), F.col("path"))))
    rows = bad.mark(rows, "section", "bad", F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20)) + 1)
    blocked = F.when(F.col("rule").isNotNull(), block.listed(F.col("rule"))).otherwise(F.coalesce("bad", F.lit(False)))
    return rows.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))
