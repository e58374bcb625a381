"""Filter audit, ranked search and token counts against plain versions, and their edges."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import interaction, queries, ranked, tokencount

from .helpers import SCHEMA, edge_docs, edge_rows, empty_docs

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LABELS = [(1, 1, 0), (3, None, 1), (4, 1, 1), (5, 0, 1), (5, 1, None), (None, 1, 1), (6, 1, 0)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


# --- filter audit


def plain_mask(rows, i):
    doc_id, text = rows[i][0], rows[i][1] or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = int(len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
    out += 4 * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + 8 * any(c in "#$%&*|" for c in text)
    return out + 16 * (doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows))


def plain_audit(rows):
    good = {d for d, q, _ in LABELS if q == 1 and d is not None}
    toxic = {d for d, _, t in LABELS if t == 1 and d is not None}
    masks, out = [plain_mask(rows, i) for i in range(len(rows))], {}
    for part in {r[3] or "" for r in rows}:
        mine = [(m, r[0]) for m, r in zip(masks, rows) if (r[3] or "") == part]
        shapley = Counter()
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                gone = [(m, d) for m, d in left if m >> f & 1]
                left = [(m, d) for m, d in left if not m >> f & 1]
                shapley[f] += len(gone)
                redundant = sum(m >> f & 1 for m, _ in mine) - len(gone)
                alone = sum(m == 1 << f for m, _ in mine)
                key = (part, "".join("ABCDE"[x] for x in order), step + 1)
                out[key] = [len(left), len(gone), redundant, alone, sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return out


def some_docs():
    r = random.Random(4)
    texts = [" ".join(r.choice(["one", "Two", "THREE", "four", "five#", "six"]) for _ in range(n)) for n in (3, 250, 250, 40)]
    texts += [" ".join(f"w{r.randrange(10**6)}" for _ in range(250)), " ".join(f"W{r.randrange(10**6)}" for _ in range(250))]
    return [(i, r.choice(texts + [None, ""]), "en", r.choice(["a", "b", "", None]), 1) for i in r.sample(range(300), 120)]


@pytest.mark.parametrize("rows", [some_docs(), edge_rows()], ids=["mixed", "edges"])
def test_audit_equals_plain(spark, rows):
    got = interaction.audit(spark.createDataFrame(rows, SCHEMA).withColumn("good", F.lit(1)).withColumn("first", F.lit(2)), labels(spark)).collect()
    want = plain_audit(rows)
    assert len(got) == len(want) and {tuple(r[:3]): list(r[3:]) for r in got} == want


def test_audit_of_nothing(spark):
    assert interaction.audit(empty_docs(spark), labels(spark)).count() == 0
    assert interaction.audit(edge_docs(spark), labels(spark).limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in interaction.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_walk_changes_two_steps_and_sums_to_all_removed():
    table = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    before = None
    for order, steps, total in interaction.walk(table):
        if before is not None:
            changed = [i for i in range(5) if order[i] != before[0][i]]
            assert len(changed) == 2 and changed[1] == changed[0] + 1
            same = [i for i in range(5) if i not in changed]
            assert (steps[:, same] == before[1][:, same]).all()
        before = order, steps.copy()
    assert (total.sum(axis=1) == 120 * (table[:, :, 0].sum(axis=1) - table[:, 0, 0])).all()


# --- ranked search


def plain_search(docs, items, k=20):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, found = Counter(cut(text)), []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            score = sum(times * weight[t] * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, times in asked.items() if t in b)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def zipf_docs(seed, n, alphabet=60):
    r = random.Random(seed)
    word = lambda: f"{r.choice(['a', 'É', 'x'])}{min(r.randrange(1, alphabet), r.randrange(1, alphabet), r.randrange(1, alphabet))}"
    texts = [r.choice([" ", "-", ". ", "\n"]).join(word() for _ in range(r.randrange(0, 60))) for _ in range(n)]
    return [(i, r.choice(texts)) for i in r.sample(range(10 * n), n)], [(i, texts[i][: r.randrange(5, 200)] + " " + word()) for i in range(20)]


@pytest.mark.parametrize("seed,k", [(1, 20), (2, 3), (3, 1), (4, 500)])
def test_search_equals_plain(spark, seed, k):
    docs, items = zipf_docs(seed, 400)
    items += [items[0], (99, None), (98, "!!"), (97, "unheard of"), (None, items[1][1])]
    docs += [(None, items[0][1]), docs[0], docs[0]]
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k, item_block=7)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)


def test_weak_and_over_parts_of_a_shard_skips_documents(spark):
    r = random.Random(5)
    rows = [(i, "common " * r.randrange(1, 9) + " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 12)))) for i in range(3000)]
    items = [(0, "common w1 w2 w3"), (1, "common common w7")]
    names = sorted(set().union(*[ranked.terms_of_item(t) for _, t in items]))
    table = ranked.postings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), names).toPandas()
    df = Counter(t for ts in table.terms for t in ts)
    n, total = len(table), int(table.n.sum())
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[i] + 1))) for i in range(len(names))])
    want = plain_search(rows, items, 10)
    for item, text in items:
        asked = [(names.index(t), times) for t, times in ranked.terms_of_item(text).items()]
        best, scored = [], 0
        for at in range(0, n, 700):
            some = table.iloc[at : at + 700]
            part = ranked.Inverted(some.n.to_numpy(), np.array([len(t) for t in some.terms]), np.concatenate(some.terms.to_numpy()), np.concatenate(some.tfs.to_numpy()), weights, n, total)
            scored += ranked.weak_and(part, asked, some.doc_id.tolist(), best, 10)
        assert [(item, i + 1, -d, s) for i, (s, d) in enumerate(sorted(best, reverse=True))] == [w for w in sorted(want) if w[0] == item]
        assert scored < n / 2  # every document has a term of the items


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "w1 w2 the same line"), (2, "Émile 😀"), (3, None)], "item_id long, text string")
    got = ranked.search(edge_docs(spark), items.withColumn("rank", F.lit(1)))
    docs = [(r[0], r[1]) for r in edge_rows()]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, [(1, "w1 w2 the same line"), (2, "Émile 😀"), (3, None)])
    assert ranked.search(empty_docs(spark), items).count() == 0 and ranked.search(edge_docs(spark), items.limit(0)).count() == 0


# --- token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


PIECES = ["the ", "'s", "'ll", "it's", " 'twas", "\n\n", "   ", "\t ", "!!!", "?'", "''s", "42", "1234567", "é", "日本語の文", "。", "<|endoftext|>", "<|endof", "text|>", "Ω", " ", "́", "😀", "x" * 40, "ab" * 30, "\r\n", " a", "A", "\x1c", "<|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 30, "=" * 30, "7" * 30]


def test_splices_are_boundaries_of_the_whole_text(tokenizer):
    """At any cut, every boundary that two chunks share and that is called stable splits the count."""
    r = random.Random(6)
    shared = 0
    for _ in range(4000):
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(12, 40)))
        beyond = tokencount.margin(TOKENIZER)
        overlap = r.choice([8, 16, 40])
        if len(text) < overlap + beyond + 10:
            continue
        start = r.randrange(4, len(text) - overlap - beyond)
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False)
        left = encode(text[: start + overlap + beyond])
        right = encode(text[start:])
        proven = tokencount.stable(text[: start + overlap + beyond], start, overlap)
        a = dict(zip(*tokencount.shared_boundaries(left.offsets, start, overlap)))
        b = dict(zip(*tokencount.shared_boundaries(right.offsets, 0, overlap)))
        whole = encode(text).ids
        for key in a.keys() & b.keys():
            if proven[key // (overlap + 1)]:
                shared += 1
                assert left.ids[: a[key]] + right.ids[b[key] :] == whole, (text, start, key)
    assert shared > 5000


def test_parts_are_counted_as_the_whole(tokenizer):
    import pyarrow as pa

    r = random.Random(8)
    odd = [*PIECES, "\u00a0", "\u00a0 ", "\u3000 x", "\u2028 ", "\x85 ", "é ", "日 本 ", "😀 ", "\x1c ", " \x00 ", "\x7f "]
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(0, 60))) for _ in range(3000)] + ["", " ", "x", "\n\n"]
    parts = tokencount.Parts(TOKENIZER)
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    column = pa.array(["a b", *texts], pa.large_string())
    assert parts.count(column[1:]).tolist() == want and parts.count(column.slice(1, 700)).tolist() == want[:700]
    assert parts.count(column[:0]).tolist() == [] and len(parts.names) < 30_000


def test_huge_texts_equal_whole_ones(spark, tokenizer):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(0, 300))) for _ in range(150)]
    texts += ["x" * 5000, "ab" * 3000, " " * 4000, "日本" * 2000, "'s" * 2000, "́" * 3000, "<|endoftext|>" * 300, None, "", texts[0]]
    rows = list(enumerate(texts)) + [(None, texts[1]), (3, texts[3]), (3, texts[3])]
    got = tokencount.count(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, chunk=64, overlap=16).collect()
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_unstable_texts_widen(spark, tokenizer, monkeypatch):
    seen = []
    real = tokencount.chunks
    monkeypatch.setattr(tokencount, "chunks", lambda huge, chunk, overlap, beyond: seen.append((chunk, overlap)) or real(huge, chunk, overlap, beyond))
    text = "́̂" * 700  # signs without a class in the table
    got = tokencount.count(spark.createDataFrame([(1, text), (2, "plain words " * 300)], "doc_id long, text string"), TOKENIZER, chunk=128, overlap=32)
    assert {tuple(r) for r in got.collect()} == {(i, len(t.encode()), len(tokenizer.encode(t).ids)) for i, t in [(1, text), (2, "plain words " * 300)]}
    assert seen[0] == (128, 32) and seen[-1][0] >= 1024


def test_token_count_edges(spark, tokenizer):
    got = tokencount.count(edge_docs(spark), TOKENIZER).collect()
    want = [(r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "").ids)) for r in edge_rows()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokencount.count(empty_docs(spark), TOKENIZER).count() == 0


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.count(empty_docs(spark), public_tokenizers.path("word_bpe_49k.json"))


def test_query_of_token_counts(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d.doc_id, len((d.text or "").encode()), n := len(tokenizer.encode(d.text or "").ids), n > 1024) for d in docs}
    assert set(map(tuple, queries.op13_token_counts(spark, sf).collect())) == want
