"""Substring search through the index equals a scan, for needles of any length, after appends and deletions."""

from __future__ import annotations

import random

from quarry.operators.gramindex import GramIndex

SCHEMA = "id long, text string"


def scan(rows, needles):
    return sorted((i, n) for i, t in rows if t is not None for n in needles if n.lower() in t.lower())


def found(index, needles):
    return sorted((r.id, r.needle) for r in index.search(needles).collect())


def test_search_equals_scan(spark, tmp_path):
    r = random.Random(2)
    part = ["ab", "Ab", "ba", "%", "_", " ", "é", "日本", "x" * 70, "needle", "\n", "😀", "abc"]
    rows = [(i, "".join(r.choice(part) for _ in range(r.randrange(0, 40)))) for i in range(250)] + [(900, None), (901, ""), (902, "b"), (903, "Ä%")]
    needles = ["a", "%", "ab", "ABA", "needle", "needleneedle", "x" * 71, "é日本", "", "zzz", "b_%", "abababab", "😀", "Ä%", "x" * 130, "ba\nab"]
    index = GramIndex.build(spark.createDataFrame(rows[:150], SCHEMA), str(tmp_path / "i")).append(spark.createDataFrame(rows[150:], SCHEMA))
    assert found(index, needles) == scan(rows, needles)
    index.delete(spark.createDataFrame([(i,) for i in range(0, 200, 3)], "id int"))
    left = [x for x in rows if not (x[0] < 200 and x[0] % 3 == 0)]
    assert found(index, needles) == scan(left, needles)
    back = [(0, "needle again"), (3, "")]
    assert found(index.append(spark.createDataFrame(back, SCHEMA)), needles) == scan(left + back, needles)


def test_few_texts_are_read(spark, tmp_path):
    r = random.Random(3)
    words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('klmnop')}{i % 10}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + (" the secret needle" if i % 50 == 7 else "")) for i in range(500)]
    index = GramIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    got = index.search(["secret needle"], reads=True).collect()
    assert sorted(x.id for x in got) == list(range(7, 500, 50)) and got[0].texts_read == 10
    swapped = f"{rows[0][1][:12]}"
    assert found(index, [swapped]) == scan(rows, [swapped])
    assert GramIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).search(["a", "abc", ""]).count() == 0
