"""The registered queries: columns, contract and results against plain versions, SQL in DuckDB."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import bins, linededup, queries, toxicity
from quarry.llm.common import fold_py

from .helpers import edge_docs, edge_rows, empty_docs
from .test_operators import TOKENIZER, Sets, plain_base, plain_dedup, plain_features_of_sound, plain_fingerprint, plain_jump

COLUMNS = {
    "op1_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint",
    "op3_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op4_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, sequences bigint, least_sequences bigint",
    "op5_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_decontam": "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def results(spark, sf):
    out = {}
    for name, query in queries.QUERIES.items():
        df = query(spark, sf)
        out[name] = (", ".join(f"{n} {t}" for n, t in df.dtypes), df.collect())
    return out


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_columns_and_types(results):
    assert {n: columns for n, (columns, _) in results.items()} == COLUMNS


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(results, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    got = [tuple(r[c] for c in columns) for r in results[name][1]]
    assert sorted(map(repr, got)) == sorted(map(repr, want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False, name=None)))


def test_op1_judges_by_the_longest_rule(results, spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(results["op1_url_filter"][1]) == len(urls)
    for r in results["op1_url_filter"][1]:
        rest = re.split("://", urls[r.page_id], maxsplit=1)[1] if "://" in (urls[r.page_id] or "") else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[0]) and r.verdict in ("allow", "block") and best[1] in (None, r.verdict)


def test_op2_keeps_base_spans(results, docs):
    for r in results["op2_pii"][1]:
        base = plain_base(docs[r.doc_id].text or "")
        spans = [s for s in r.spans.split(",") if s]
        assert r.base_sha256 == sha(base) and r.n_spans == len(spans) and set(filter(None, base.split(","))) <= set(spans)
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        added = [tuple(map(int, s.split(":")[1:])) for s in spans if s not in base.split(",")]
        assert all(0 <= a < b <= len(docs[r.doc_id].text) for a, b in added)
        assert all(a >= d or c >= b for i, (a, b) in enumerate(added) for c, d in added[:i])  # none meets another


def test_op3_drops_repeated_lines(results, docs):
    want = plain_dedup([(i, r.text) for i, r in docs.items()])
    for r in results["op3_line_dedup"][1]:
        assert r.kept_sha256 == sha(want[r.doc_id]) and r.n_lines == (docs[r.doc_id].text or "").count("\n") + 1


def test_op4_packs_all_ids_in_as_few_sequences_as_there_must_be(results, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = sorted(results["op4_packing"][1], key=lambda r: (r.doc_id, r.piece))
    at = iter(rows)
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i].text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            r = next(at)
            assert (r.doc_id, r.piece, r.start, r.length) == (i, piece, start, len(cut))
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut))
    assert next(at, None) is None
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) == rows[0].sequences >= rows[0].least_sequences == bins.lower_bound(Counter(r.length for r in rows), 2048)
    assert rows[0].sequences == rows[0].least_sequences


def test_op5_reads_back_what_it_stores(results, docs):
    for r in results["op5_media"][1]:
        plain = (docs[r.doc_id].text or "").encode()
        padded = plain + bytes(-len(plain) % 64 if plain else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(plain), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.feature == plain_features_of_sound(padded)


def test_op6_places_by_key(results, docs, spark):
    keys = {r.id: r.h % (1 << 64) for r in spark.createDataFrame([(i,) for i in docs], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    slots = defaultdict(list)
    for r in results["op6_sharding"][1]:
        plain = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(plain) + 1, zlib.crc32(plain), "key")
        assert (r.shard, r.grown_shard) == (plain_jump(keys[r.doc_id], 16), plain_jump(keys[r.doc_id], 17))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(docs)


def test_op7_and_op9_hold_out_a_fifth(results, docs, spark, sf):
    for r in results["op7_langid"][1]:
        assert r.held_out == (fold_py(r.doc_id) == 0) and 0 <= r.score <= 1
    held = [r for r in results["op7_langid"][1] if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    rows = results["op9_toxicity"][1]
    assert len(rows) == len(docs) and all(r.held_out == (fold_py(r.doc_id) == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # labels of held-out rows are never learned from
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(documents, toxicity.train(documents, other)).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_op10_names_components(results, docs):
    prints = {i: plain_fingerprint(r.text) for i, r in docs.items()}
    groups = Sets(prints)
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in results["op10_simhash"][1]} == {i: (f"{p:016x}", groups.find(i)) for i, p in prints.items()}


# --- the pipeline on awkward tables ---------------------------------------------------------------


@pytest.fixture
def table(spark, sf, tmp_path):
    def make(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, None), (4, "one two three four five six seven"), (None, "w1 w2 w3 w4 w5")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_pipeline_on_nulls_repeats_and_clashing_names(spark, table):
    folder = table(edge_docs(spark).unionByName(edge_docs(spark).filter("doc_id > 7")))
    got = corpus_pipeline.run(spark, folder).collect()
    firsts = [r for r in got if r.piece == 0]
    assert 0 < len(firsts) <= len({t for _, t, *_ in edge_rows()}) and len({r.doc_id for r in firsts}) == len(firsts)
    assert 11 not in {r.doc_id for r in firsts}  # the document that is a benchmark item


def test_pipeline_on_an_empty_table(spark, table):
    assert corpus_pipeline.run(spark, table(empty_docs(spark))).count() == 0


def test_a_failing_pipeline_leaves_nothing_behind(spark, table, monkeypatch):
    def broken(*_args, **_more):
        raise RuntimeError("broken")

    folder = table(edge_docs(spark))
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError, match="broken"):
        corpus_pipeline.run(spark, folder)
    assert set(os.listdir(root)) <= before


def test_stages_on_empty_tables(spark):
    from quarry.llm import decontam, pii, simhash

    docs, labels = empty_docs(spark), spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for out in (toxicity.keep_clean(docs, labels), linededup.dedup(docs), simhash.keep_one(docs), decontam.remove(docs, items)):
        assert out.columns == docs.columns and out.count() == 0
    edge = pii.redact(pii.find(edge_docs(spark))).collect()
    assert len(edge) == len(edge_rows()) and all(r.text is not None for r in edge)
