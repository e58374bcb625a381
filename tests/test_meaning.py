"""Learned vectors: the factorisation, and paraphrases without a common word."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import meaning, resolve, upkeep
from quarry.operators.textindex import word_counts

SAME = {"car": "automobile", "doctor": "physician", "begin": "commence", "film": "movie"}
WITH = {
    "car": ["engine", "wheel", "road", "fuel", "brake"], "doctor": ["hospital", "patient", "nurse", "ward", "cure"],
    "begin": ["start", "opening", "first", "launch", "initial"], "film": ["actor", "scene", "cinema", "screen", "director"],
}


def corpus(spark):
    r, rows = random.Random(1), []
    for i in range(400):
        topic = r.choice(list(WITH))
        rows.append((i, " ".join([r.choice([topic, SAME[topic]]), *r.sample(WITH[topic], 3), r.choice(["the", "a", "of"])])))
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3)


def test_directions_are_those_of_the_matrix(spark):
    rows, texts = corpus(spark)
    learned = meaning.LearnedVectors.fit(texts, dims=3, passes=6)
    place = {w: i for i, w in enumerate(learned.words)}
    matrix = np.zeros((len(rows), len(place)))
    for i, text in rows:
        for w in text.split():
            matrix[i, place[w]] += 1
    matrix = np.sqrt(matrix) * learned.idf
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    _, strength, want = np.linalg.svd(matrix)
    assert np.allclose(np.abs(want[:3] @ learned.directions), np.diag((strength[:3] / strength[0]) ** 2), atol=1e-3)
    got = {r.id: np.array(r.vector) for r in learned.embed(texts).collect()}
    plain = matrix @ learned.directions
    assert all(np.allclose(got[i], plain[i] / np.linalg.norm(plain[i]), atol=1e-9) for i in range(len(rows)))


def test_paraphrases_are_found_where_hashed_words_find_none(spark):
    _, texts = corpus(spark)
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(SAME.values())], "query_id long, text string")
    short = spark.createDataFrame([(1000 + i, w) for i, w in enumerate(SAME)], "id long, text string")
    learned = meaning.LearnedVectors.fit(texts, dims=8)
    found = upkeep.semantic_search(short, asked, 1, learned.embed).collect()
    assert {(r.query_id, r.id) for r in found} == {(i, 1000 + i) for i in range(4)} and min(r.score for r in found) > 0.5
    hashed = upkeep.semantic_search(short, asked, 1).collect()
    assert all(abs(r.score) < 0.2 for r in hashed)


def test_the_rewriter_proposes_names_of_like_meaning(spark):
    _, texts = corpus(spark)
    learned = meaning.LearnedVectors.fit(texts, dims=4)
    names = spark.createDataFrame([("carEngine",), ("doctor_ward",), ("filmScene",)], "name string")
    probes = spark.createDataFrame([("automobile_wheel",), ("physicianWard",), ("unknown_thing_x",)], "probe string")
    won = {r.probe: (r.verdict, r.name, r.strategy) for r in resolve.rewrite(probes, names, embed=learned.embed).collect()}
    assert won["automobile_wheel"] == ("REPLACE", "carEngine", "embedding") and won["physicianWard"][1] == "doctor_ward" and won["unknown_thing_x"][0] == "RESIDUAL"


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], "id long, text string")
    learned = meaning.LearnedVectors.fit(none, dims=4)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zzz")], "id long, text string")
    assert all(r.vector == [0.0] * 4 for r in learned.embed(odd).collect())
    _, texts = corpus(spark)
    assert all(r.vector == [0.0] * 4 for r in meaning.LearnedVectors.fit(texts, dims=4).embed(odd).collect()) and word_counts(none).count() == 0
