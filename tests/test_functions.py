"""Functions on hand-made cases."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import similarity, text
from quarry.operators import stemming


def one(spark, values, build):
    """``build`` of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_identifier_shapes_in_order(spark):
    cases = {
        "where is 10.0.0.1 now": "10.0.0.1",
        "fe80::1 up": "fe80::1",
        "at 12:34:56 it broke": None,
        "id 123e4567-e89b-12d3-a456-426614174000": "123e4567-e89b-12d3-a456-426614174000",
        "see https://a.b/c?d=1": "https://a.b/c?d=1",
        "open ./src/main.py": "./src/main.py",
        "mail me@x.org": "me@x.org",
        "commit deadbeef": "deadbeef",
        "plain words here": None,
        "": None,
        "cmp1qxy": "cmp1qxy",
        "cmpq1xy": None,
        "word1": None,
        "abcdefghi1": "abcdefghi1",
    }
    assert one(spark, cases, text.identifier) == list(cases.values())


def test_identifiers_are_distinct_and_bare(spark):
    got = one(spark, ["10.0.0.1, 10.0.0.1; 10.0.0.2.", ""], text.identifiers)
    assert got[0][:2] == ["10.0.0.1", "10.0.0.2"] and got[1] == []


def test_topic_and_words(spark):
    assert one(spark, ["The rsync rsync backup mirror", "only", None, "b1b b1b a1a a1a c"], text.topic) == ["rsync_backup", "", "", "b1b_a1a"]
    assert one(spark, ["off-tree Backup backup of it"], text.query_tokens) == [["off", "tree", "backup"]]
    words = [" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=30)) for i in range(20)]
    got = one(spark, words, lambda c: text.top_words(c, 3))
    for w, g in zip(words, got, strict=True):
        seen = w.split()
        assert g == sorted(set(seen), key=lambda x: (-seen.count(x), seen.index(x)))[:3]


def test_gate_and_skip_reasons(spark):
    assert one(spark, ["x" * 50, "x" * 49, "!" * 60, None], text.worth_indexing) == [True, False, False, False]
    cases = ["", "a ```b```", "x\nTraceback (most recent call last):\n", '{"a": 1}', "- a\n+\r\n-\n+ d\n- e", "fine", "-a\n+b\n-c\n+d\n-e", "---\n+++\n--\n++\n-1", " {} ", "[] ", "[1]", "[12]"]
    assert one(spark, cases, text.skip_reason) == ["empty", "contains-code-block", "contains-traceback", "structured-json", "contains-diff", None, None, None, None, None, None, "structured-json"]
    typed = one(spark, ["hello"], lambda c: text.skip_reason(c, F.lit("tool_use")))
    assert typed == ["content_type=tool_use"]


def test_anchors_and_gists(spark):
    s = "Set WV_URL in `config.yaml` to https://h:8080/x, see v1.2.3 and ImportError --foo=1"
    got = one(spark, [s], text.anchors)[0]
    assert got[0] == "https://h:8080/x," and {"WV_URL", "config.yaml", "v1.2.3", "ImportError", "--foo=1"} <= set(got)
    assert one(spark, ["no anchors here"], text.gist) == ["no anchors here"]
    assert one(spark, ["run a.py"], text.gist) == ["[anchors: a.py] run a.py"]
    assert one(spark, ["OK. So, we did **this** in order to win", "x" * 120, None], text.short_gist) == ["we did this to win", "x" * 99 + "…", ""]


def test_snippets(spark):
    body = "a" * 600 + " needle here " + "b" * 600
    assert "needle" in one(spark, [body], lambda c: text.snippet(c, F.array(F.lit("needle"))))[0]
    assert one(spark, ["xxneedleyy", "none"], lambda c: text.needle_snippet(c, F.lit("NEEDLE"), 1, 1)) == ["xneedley", None]


def test_routes(spark):
    cases = {"/users/{id}": "/users/:id", "/users/[id]": "/users/:id", "/blog/[...slug]": "/blog/*", "/api//v1/": "/api/v1", "/": "/"}
    assert one(spark, cases, text.normalize_route) == list(cases.values())
    pairs = [
        ("/api/users/123", "/api/users/:id", True), ("/api/users", "/api/users/:id", False), ("/api/users/1", "/api/users", False),
        ("/blog/foo/bar", "/blog/*", True), ("/blog", "/blog/*", True), ("/bloggers", "/blog/*", False), ("/a.c", "/a.c", True), ("/abc", "/a.c", False),
    ]
    df = spark.createDataFrame(pairs, "p string, r string, w boolean")
    assert all(x.w == x.g for x in df.select("w", F.rlike("p", text.route_regex(F.col("r"))).alias("g")).collect())


def grams(s):
    out = set()
    for w in "".join(c if c.isalnum() else " " for c in s.lower()).split():
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_trigram_join_finds_all_pairs(spark, threshold):
    r = random.Random(5)
    make = lambda: " ".join("".join(r.choices("abcd", k=r.randint(1, 6))) for _ in range(r.randint(1, 3)))
    a, b = {make() for _ in range(60)}, {make() for _ in range(60)}
    got = {
        (x.probe, x.name): x.sim
        for x in similarity.trigram_join(
            spark.createDataFrame([(v,) for v in a], "probe string"), spark.createDataFrame([(v,) for v in b], "name string"), threshold
        ).collect()
    }
    want = {(p, n): len(grams(p) & grams(n)) / len(grams(p) | grams(n)) for p, n in itertools.product(a, b)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold})


def test_rerank_prefers_close_typos(spark):
    df = spark.createDataFrame([("WorkflowGrpah", "WorkflowGraph"), ("WorkflowGrpah", "Workflow")], "q string, n string")
    score = similarity.rerank_score(F.col("q"), F.col("n"), similarity.similarity(F.col("q"), F.col("n")), F.levenshtein("q", "n"))
    a, b = (r.s for r in df.select(score.alias("s")).collect())
    assert a > b


def test_token_edits_and_folding(spark):
    pairs = [("STRIPE_KEY", "STRIPE_SECRET_KEY", 1), ("A_B_C", "A_B_C", 0), ("A_B", "B_A", 2), ("X", "Y_Z", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, w int")
    assert all(r.w == r.d for r in df.select("w", similarity.token_edits(F.col("a"), F.col("b")).alias("d")).collect())
    assert one(spark, ["databaseUrl", "DATABASE_URL", "database-url"], similarity.fold_separators) == ["database url"] * 3


# Published pairs of the English stemmer.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistent consist consistently consist
consisting consist consolation consol consolatory consolatori consoling consol consolingly consol consonant conson constable constabl constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knavish knavish kneaded knead kneading knead kneel kneel kneeled kneel knees knee knell knell knelt knelt knew knew
knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knock knock knocked knock
caresses caress ponies poni ties tie cries cri dies die gas gas this this gaps gap kiwis kiwi luxuriating luxuri hopping hop hoped hope hoping hope bed bed bead bead embedded embed
generally general generously generous communism communism arsenal arsenal relational relat conditional condit rational ration happy happi by by say say cry cri sky sky skies sky
dying die news news inning inning proceed proceed exceeds exceed agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
falling fall hissing hiss fizzed fizz failing fail filing file national nation sensational sensat triplicate triplic electrical electr hopeful hope goodness good formative format
revival reviv allowance allow inference infer adjustable adjust adoption adopt activate activ bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll geology geolog
hopelessly hopeless vitally vital apology apolog youth youth boy boy""".split()


def test_stems():
    assert {w: stemming.stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))


def test_stemmed_search(spark):
    corpus = spark.createDataFrame([(1, "He connects the wires"), (2, "connected wire"), (3, "nothing")], "id long, text string")
    assert sorted(r.id for r in stemming.contains_all_stems(corpus, "the connecting wire").collect()) == [1, 2]
    assert stemming.contains_all_stems(corpus, "the of").count() == 0


def test_gist_leaves_out_sentences_that_say_nothing(spark):
    cases = ["got it. X works.", "Hmm. Interesting. The build fails. You're right.", "So, let me think about this. Done.", "a. b. c. d. e. got it. f.", "x" * 99 + ". y.", "x" * 98 + ". y."]
    want = ["X works.", "The build fails.", "think about this. Done.", "a. b. c. d. e. got it. f.", "x" * 99 + ".", "x" * 98 + "…"]
    assert one(spark, cases, text.short_gist)[0:2] == want[0:2]
    got = one(spark, cases, text.short_gist)
    assert got[3:5] == want[3:5] and got[5].endswith("…") and len(got[5]) == 100


def test_frequent_words_of_batches_are_those_of_the_expression(spark):
    import random

    from quarry.operators.retrieval import frequent_words

    r = random.Random(51)
    parts = ["the", "alpha", "Beta", "9gamma", "_delta_", "a1", "é", "ab", "x_y", "ALPHA", "İstanbul", "naïve", "12", "\n", "gamma", "-", "__"]
    texts = [None, "", " ", "the and"] + [r.choice([" ", ",", ""]).join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x.doc_id: x.w for x in df.select("doc_id", text.top_words(F.col("text"), 4).alias("w")).collect()}
    assert {x.doc_id: x.words for x in frequent_words(df, "doc_id", 4).collect()} == want
    assert frequent_words(df.limit(0), "doc_id", 4).count() == 0


@pytest.mark.parametrize("threshold", [0.28, 0.4, 0.7])
def test_trigram_best_is_the_first_of_the_join(spark, threshold):
    from pyspark.sql import Window

    r = random.Random(3)
    some = lambda n: [f"/{r.choice(['en', 'de', 'È x'])}/{r.randrange(3000)}{r.choice(['', '/', '.html', ' en', ' abc de 77'])}" for _ in range(n)] + ["", "/", "a", "aaaaaaa", "\U0001d538b c"]
    probes, names = (spark.createDataFrame([(x,) for x in some(400)], f"{c} string") for c in ("probe", "name"))
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("sim"), "name"))
    first = similarity.trigram_join(probes, names, threshold).withColumn("_r", place).filter("_r = 1").drop("_r")
    key = lambda df: {(x.probe, x.name, round(x.sim, 9)) for x in df.collect()}
    assert key(similarity.trigram_best(probes, names, threshold)) == key(first) != set()
