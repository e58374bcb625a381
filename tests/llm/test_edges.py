"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, linededup, media, packing, pii, sharding, simhash, toxicity, urlfilter

from .helpers import SCHEMA, edge_docs, edge_rows, empty_docs

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LABELS = [(1, 0), (3, 1), (4, 0), (5, 1), (5, 0), (None, 1), (6, None)]


def _labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, toxic int")


def _items(spark):
    rows = [(1, None), (2, ""), (3, "three words only"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "w1 w2 w3 w4 w5")]
    return spark.createDataFrame(rows, "item_id long, text string")


ONE_EACH = {
    "pii": lambda s, d: pii.find(d),
    "line dedup": lambda s, d: linededup.LineIndex.of(d).apply(d),
    "line dedup stage": lambda s, d: linededup.dedup(d),
    "media": lambda s, d: media.digests(d),
    "sharding": lambda s, d: sharding.assign(d),
    "langid": lambda s, d: langid.identify(d, langid.train(d)),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, _labels(s))),
    "simhash": lambda s, d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_one_row_for_each(spark, name):
    assert ONE_EACH[name](spark, edge_docs(spark)).count() == len(edge_rows())


@pytest.mark.parametrize("name", ONE_EACH)
def test_empty_table(spark, name):
    assert ONE_EACH[name](spark, empty_docs(spark)).count() == 0


def test_packing_edges(spark):
    rows = packing.pack(edge_docs(spark), TOKENIZER).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.piece == 0 for r in rows) == len(edge_rows())
    assert packing.pack(empty_docs(spark), TOKENIZER).count() == 0


def test_decontam_edges(spark):
    got = decontam.contaminated(edge_docs(spark), _items(spark)).select("doc_id", "item_id", "n_shared", "n_item").collect()
    assert (11, 4, 3, 3) in [tuple(r) for r in got]
    assert all(r.item_id in (4, None) for r in got) and len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert decontam.contaminated(empty_docs(spark), _items(spark)).count() == 0
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(edge_docs(spark), no_items).count() == 0
    assert decontam.remove(edge_docs(spark), no_items).count() == len(edge_rows())


def test_filters_keep_columns_and_rows(spark):
    docs = edge_docs(spark)
    for out in (toxicity.keep_clean(docs, _labels(spark)), linededup.dedup(docs), simhash.keep_one(docs), decontam.remove(docs, _items(spark))):
        assert out.columns == docs.columns
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.collect()


def test_url_filter_edges(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://", "x"), (4, "HTTP://A.ORG", None), (4, "HTTP://A.ORG", None), (None, "http://a.com/fr/1?x#y", "<title>***</title>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "key", "listed", "p", "w")})
    rules = [("org", "/", "allow"), ("com", "/fr/", "block")]
    got = [tuple(r) for r in urlfilter.judge(pages, rules, urlfilter.junk_sections(pages)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "", None, "allow"),
        (4, "a.org", "", None, "allow"), (None, "a.com", "/fr/1", "com/fr/", "block"),
    ]))
    assert urlfilter.judge(pages.limit(0), rules, urlfilter.junk_sections(pages.limit(0))).count() == 0
    assert urlfilter.judge(pages, [], urlfilter.junk_sections(pages)).count() == len(rows)


def test_training_with_one_class_or_none(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for labels in (_labels(spark).limit(0), _labels(spark).filter("toxic = 1")):
        scores = [r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
        assert all(0 <= s <= 1 for s in scores)
    assert max(r.score for r in toxicity.score(docs, toxicity.train(docs, _labels(spark).limit(0))).collect()) < 0.5
    assert toxicity.keep_clean(docs, _labels(spark).filter("toxic = 0")).count() == docs.count()
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
