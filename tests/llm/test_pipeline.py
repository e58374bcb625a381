"""The pipeline, stage by stage, against brute force over a small table."""

from __future__ import annotations

import itertools

import corpus_pipeline
import public_tokenizers
import pytest

from quarry.llm import packing, toxicity
from quarry.llm.common import Scratch

from .test_operators import Sets, plain_dedup, plain_fingerprint, shingles


@pytest.fixture(scope="module")
def stages(spark, sf):
    scratch = Scratch(spark)
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(scratch.keep(stage(spark, out[-1], sf)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_toxic_documents_go(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(stages[0], toxicity.train(stages[0], labels)).collect()}
    assert texts(stages[1]).keys() == {i for i, s in scores.items() if s < 0.5}


def test_repeated_lines_go(stages):
    before = texts(stages[1])
    after = {r.doc_id: r for r in stages[2].collect()}
    assert {i: r.text for i, r in after.items()} == plain_dedup(list(before.items()))
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_of_each_near_duplicate_group_stays(stages):
    prints = {i: plain_fingerprint(t) for i, t in texts(stages[2]).items()}
    groups = Sets(prints)
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            groups.join(a, b)
    assert texts(stages[3]).keys() == {groups.find(i) for i in prints}


def test_contaminated_documents_go(spark, sf, stages):
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, t in texts(stages[3]).items() if not any(s and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert texts(stages[4]).keys() == clean and len(clean) < stages[3].count()


def test_everything_left_is_packed(stages):
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    left = texts(stages[4])
    got: dict[int, bytes] = {}
    for r in sorted(stages[5].collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert got == {i: next(iter(words.encode([t]))) + b"\0\0\0\0" for i, t in left.items()}


def test_run_gives_the_last_stage(spark, sf, stages):
    same = ["doc_id", "piece", "start", "length"]
    assert sorted(corpus_pipeline.run(spark, sf).select(*same).collect()) == sorted(stages[5].select(*same).collect())
