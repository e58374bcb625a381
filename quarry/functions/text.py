"""Text functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that content tokens leave out.
STOPWORDS = (
    "the a an is are was were be been being and or but if then else of to in on for with from by at as it this that "
    "these those i we you they he she them us our your their my me him her his hers its do does did doing have has had "
    "having will would could should can may might must shall ought into out up down over under again further more most "
    "less least very much many few no not yes ok okay now any some all each every both either neither what which who "
    "whom whose where when why how than so just also too only even still yet about while because though although however"
).split()
CONTENT_WORD = "[A-Za-z][A-Za-z0-9_]{2,}"
SEPARATORS = r"[^\p{L}\p{N}]+"

# Identifier shapes, most specific first.
IDENTIFIERS = {
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "ipv6": r"(?:\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|(?<![0-9a-zA-Z])[0-9a-fA-F:]*::[0-9a-fA-F:]*[0-9a-fA-F](?![0-9a-zA-Z]))",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "url": r"https?://[\w.~:/?#\[\]@!$&'()*+,;=%-]+",
    "path": r"(?:[~/]|\./)[\w./_-]{3,}",
    "email": r"\b[\w.+-]+@[\w.-]+\.\w{2,}\b",
    "hex": r"\b[0-9a-fA-F]{7,40}\b",
}

# Tokens that a summary must not lose, in order of preference.
ANCHORS = (
    r"https?://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+",
    r"(?:\.{1,2}/|/)[A-Za-z0-9_./\\-]+[A-Za-z0-9_]",
    r"\b[A-Za-z][A-Za-z0-9_-]*\.(?:py|pyi|ts|tsx|js|jsx|mjs|cjs|rs|go|rb|java|kt|sh|bash|md|json|yaml|yml|toml|sql|html|css|scss|vue|svelte)\b",
    r"\bv?\d+\.\d+(?:\.\d+)?(?:-[A-Za-z0-9]+)?\b",
    r"\b\d+(?:\.\d+)?\s*(?:MB|GB|KB|TB|B|ms|s|m|h|dim|chars?|tokens?|rows?|workers?|hits?)\b",
    r"--[a-z][a-z0-9-]+(?:=[^\s]+)?",
    r"\b[A-Z][a-z][A-Za-z0-9]*(?:Error|Exception|Failure|Column|Constraint|Violation|Conflict|NotFound|Denied|Refused|Timeout)\b",
    r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    r"`[^`\n]{2,80}`",
    r"\b(?:[1-9]\d{3,4})\b",
)
MAX_ANCHORS, MAX_ANCHOR = 32, 200


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that lambdas inside it see as one evaluated variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def content_words(text: Column) -> Column:
    """Content words in order, repeats included: ASCII letter first, three characters, no filler."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CONTENT_WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def query_tokens(text: Column) -> Column:
    """Distinct content words, first seen first."""
    return F.array_distinct(content_words(text))


def top_words(text: Column, n: int) -> Column:
    """The ``n`` most frequent content words; ties go to the first seen.

    Counting sorts (word, place) once instead of scanning the words for each distinct word.
    """

    def heads_of(pairs: Column) -> Column:
        numbered = F.transform(pairs, lambda p, i: F.struct(p["w"].alias("w"), p["i"].alias("first"), i.alias("at")))
        return F.filter(numbered, lambda x, i: (i == 0) | (F.get(pairs, i - 1)["w"] != x["w"]))

    def counted(pairs: Column) -> Column:
        def rows(heads: Column) -> Column:
            count = lambda h, j: F.coalesce(F.get(heads, j + 1)["at"], F.size(pairs)) - h["at"]
            return F.transform(heads, lambda h, j: F.struct((-count(h, j)).alias("n"), h["first"].alias("first"), h["w"].alias("w")))

        return F.slice(F.array_sort(once(heads_of(pairs), rows)), 1, n)["w"]

    placed = F.transform(content_words(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return once(F.array_sort(placed), counted)


def topic(text: Column) -> Column:
    """The two most frequent content words joined by ``_``; empty with fewer than two."""
    return once(top_words(text, 2), lambda t: F.when(F.size(t) == 2, F.array_join(t, "_")).otherwise(""))


def identifier(text: Column) -> Column:
    """The first identifier-shaped part of a query, by order of shape, or null.

    A single word with a digit counts from ten characters, or from seven without a run of four letters.
    """
    q = F.trim(text)
    shaped = [F.nullif(F.regexp_extract(q, p, 0), F.lit("")) for p in IDENTIFIERS.values()]
    word = ~F.contains(q, F.lit(" ")) & q.rlike("[0-9]")
    opaque = (F.length(q) >= 10) | ((F.length(q) >= 7) & ~F.lower(q).rlike("[a-z]{4,}"))
    return F.coalesce(*shaped, F.when(word & opaque, q))


def identifiers(text: Column, most: int = 4) -> Column:
    """Up to ``most`` distinct identifiers, in order of shape and place, freed of trailing punctuation."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in IDENTIFIERS.values()]
    bare = F.transform(F.concat(*found), lambda t: F.regexp_replace(t, "[.,;:)'\"]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: t != "")), 1, most)


def worth_indexing(text: Column) -> Column:
    """At least 50 characters after trimming, and at least 30 % letters or digits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return (F.length(t) >= 50) & (alnum / F.greatest(F.length(t), F.lit(1)) >= 0.3)


def anchors(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ANCHORS])
    bare = F.transform(found, lambda t: F.btrim(t, F.lit("`")))
    return F.slice(F.array_distinct(F.filter(bare, lambda t: (t != "") & (F.length(t) <= MAX_ANCHOR))), 1, MAX_ANCHORS)


def skip_reason(text: Column, content_type: Column | None = None) -> Column:
    """Why a text should not be condensed, or null."""
    t = F.trim(text)
    structured = (F.length(t) >= 4) & ((t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]")))
    diff = F.size(F.filter(F.split(text, "\r?\n"), lambda line: line.rlike("^[-+]( |$)"))) >= 5
    why = F.when(F.coalesce(text, F.lit("")) == "", "empty")
    if content_type is not None:
        why = why.when(content_type.isNotNull() & (content_type != "text"), F.concat(F.lit("content_type="), content_type))
    return (
        why.when(F.contains(text, F.lit("```")), "contains-code-block")
        .when(text.rlike(r"(?m)^Traceback \(most recent call last\):"), "contains-traceback")
        .when(structured, "structured-json")
        .when(diff, "contains-diff")
    )


def gist(text: Column, content_type: Column | None = None) -> Column:
    """``[anchors: ...]`` before the text, or null where condensing is unsafe."""
    spliced = once(
        anchors(text), lambda a: F.when(F.size(a) > 0, F.concat(F.lit("[anchors: "), F.array_join(a, ", "), F.lit("] "), text)).otherwise(text)
    )
    return F.when(skip_reason(text, content_type).isNull(), spliced)


# Wordy phrases and what replaces them.
PHRASES = {
    "due to the fact that": "because",
    "in order to": "to",
    "at this point in time": "now",
    "a large number of": "many",
    "in the event that": "if",
    "with respect to": "re",
    "as a result of": "from",
}
# Fixed value: openings that carry nothing.
OPENING = (
    r"(?i)^(Based on (the )?(memory|context|conversation|prior|recent commits)[^,.]*,?\s*|Let me\s+|Let's\s+|I(?:'ll|'d| will| would)\s+|"
    r"First,?\s*|Now,?\s*|So,?\s*|Right[.,]?\s*|Actually[.,]?\s*|Okay[.,]?\s*|OK[.,]?\s*|Alright[.,]?\s*|Great[.!]?\s*|Perfect[.!]?\s*|"
    r"Sure[.,]?\s*|Of course[.,]?\s*|Here(?:'s| is) (?:what|the|how|where|why)[^,.]*[,.]?\s*|Looking at[^,.]*[,.]?\s*|"
    r"That('s| is) (a )?(great|good|interesting) (point|question|catch)[.,!]?\s*|You(?:'re| are)? (right|correct)[.,]?\s*|Confirmed[.,]?\s*)"
)
# Fixed value: sentences that carry nothing.
FILLER = (
    r"(?i)^(let me think (about (this|that))?[.,]?|that('s| is) (a )?(great|good|fair|valid) (point|question|catch)[.,!]?|"
    r"you('re| are)? (right|correct)[.,]?|interesting[.,]?|hmm[.,]?|got it[.,]?)\s*$"
)


def short_gist(text: Column, most: int = 100) -> Column:
    """A rule-made line: markdown, URLs, openings and empty sentences gone, phrases shortened, cut with an
    ellipsis."""
    s = F.coalesce(text, F.lit(""))
    for pattern, to in (
        (r"(?s)```[a-zA-Z]*\n.*?\n```", "[code]"), (r"(?m)^#+\s*", ""), (r"\*\*(.+?)\*\*", "$1"), (r"`([^`]+)`", "$1"),
        (r"(?m)^\s*[-*]\s+", ""), (r"https?://\S+", "[url]"), *((rf"(?i)\b{p}\b", r) for p, r in PHRASES.items()),
    ):
        s = F.regexp_replace(s, pattern, to)
    for _ in range(5):
        s = F.regexp_replace(F.ltrim(s), OPENING, "")
    # sentences until the line is full, without those that carry nothing; the fifth is all the rest
    told = F.filter(F.split(s, r"(?<=[.!?])\s+", 5), lambda x: ~F.trim(x).rlike(FILLER))
    none = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    more = lambda acc, x: F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["n"] + F.length(x)).alias("n"))
    picked = F.aggregate(told, none, lambda acc, x: F.when(acc["n"] >= most, acc).otherwise(more(acc, x)), lambda acc: F.array_join(acc["kept"], " "))
    s = F.trim(F.regexp_replace(picked, r"\s+", " "))
    return once(s, lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t))


def snippet(text: Column, wanted: Column, width: int = 500, step: int = 250) -> Column:
    """The first window of ``width`` characters that holds most of the wanted tokens."""
    def pick(low: Column) -> Column:
        last = F.greatest(F.length(low) - 1, F.lit(0))
        windows = F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda p: F.struct(F.size(F.filter(wanted, lambda w: F.contains(F.substring(low, p + 1, F.lit(width)), w))).alias("n"), (-p).alias("at")),
        )
        return once(F.array_max(windows), lambda best: F.substring(text, 1 - best["at"], F.lit(width)))

    return once(F.lower(text), pick)


def needle_snippet(text: Column, needle: Column, before: int = 100, after: int = 200) -> Column:
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(needle) + after))


def normalize_route(path: Column) -> Column:
    """One spelling for parameters: ``{id}`` and ``[id]`` are ``:id``, ``[...x]`` is ``*``."""
    s = F.regexp_replace(path, r"\{([^}/]+)\}", ":$1")
    s = F.regexp_replace(s, r"\[\.\.\.[^\]/]+\]", "*")
    s = F.regexp_replace(s, r"\[([^\]/]+)\]", ":$1")
    s = F.regexp_replace(s, r"(?<!:)//+", "/")
    return F.when((F.length(s) > 1) & s.endswith("/"), F.regexp_replace(s, "/$", "")).otherwise(s)


def route_regex(pattern: Column) -> Column:
    """An anchored expression for a route: parameters match a segment, a last ``*`` matches any rest."""
    parts = F.filter(F.split(pattern, "/"), lambda p: p != "")

    def of(p: Column) -> Column:
        quoted = F.transform(p, lambda s: F.when(s.startswith(":"), "/+[^/]+").otherwise(F.concat(F.lit("/+\\Q"), s, F.lit("\\E"))))
        head = F.when(F.get(p, F.size(p) - 1) == "*", F.concat(F.array_join(F.slice(quoted, 1, F.greatest(F.size(p) - 1, F.lit(0))), ""), F.lit("(/.*)?")))
        return F.concat(F.lit("^"), F.coalesce(head, F.array_join(quoted, "")), F.lit("/*$"))

    return once(parts, of)
