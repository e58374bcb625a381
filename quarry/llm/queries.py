"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, interaction, langid, linededup, media, packing, pii, ranked, sharding, simhash, tokencount, toxicity, urlfilter
from quarry.llm.common import fold


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlfilter.judge(pages, RULES, urlfilter.junk_sections(pages))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_docs(spark, sf_dir))
    count = {f"n_{k}": pii.count_kind(F.col("base"), k) for k in pii.KINDS[:4]}
    return found.withColumns(count).select(
        "doc_id",
        *count,
        F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    out = linededup.LineIndex.of(docs).apply(docs)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "sequences", "least_sequences")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_docs(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return langid.identify(docs, langid.train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("containment", F.round("containment", 6))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score(docs, scorer).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_media": op5_media,
    "op6_sharding": op6_sharding,
    "op7_langid": op7_langid,
    "op8_decontam": op8_decontam,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}
#: Lower-cases A-Z alone, which DuckDB's lower() would not.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), common AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, c.last IS NOT NULL AND l.doc_id <> c.last AS gone FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_FITS = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)

OP1_SQL = f"""
WITH u AS (
  SELECT page_id, html, {_LOWER.format(f"regexp_extract(coalesce({_REST}, ''), '^([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce({_REST}, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM pages
), k AS (
  SELECT *, CASE WHEN host <> '' THEN host || '/' || regexp_extract(path, '^/([^/]*)', 1) || '/' END AS section FROM u
), bad AS (
  SELECT section FROM k WHERE section IS NOT NULL GROUP BY section
  HAVING 2 * count(*) FILTER (regexp_matches(html, '<title>[^<]*[*#%$]{{3}}')) > count(*)
), best AS (
  SELECT k.*, (SELECT max(struct_pack(n := length(h || p), r := h || p, v := v)) FROM ({_FITS})
               WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS m FROM k
)
SELECT page_id, host, path, m.r AS rule,
       coalesce(m.v, CASE WHEN section IN (SELECT section FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""


_WORDS = f"list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _shingles_sql(words: str, key: str, size: str) -> str:
    grams = f"list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i+{size}-1], ' ')))"
    return f"SELECT DISTINCT {key}, unnest({grams}) AS s FROM {words} WHERE len(w) >= {size}"


#: Shingles of five words, or of all words of an item that has fewer.
OP8_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
b AS ({_shingles_sql("bw", "item_id", "5")}
      UNION SELECT item_id, array_to_string(w, ' ') AS s FROM bw WHERE len(w) BETWEEN 1 AND 4),
d AS ({" UNION ".join(f"SELECT * FROM ({_shingles_sql('dw', 'doc_id', str(k))}) WHERE s IN (SELECT s FROM b)" for k in (5, 4, 3, 2, 1))}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM p JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""

_CUT = "[\\x20\\x09-\\x0D]+"
_ABC = "(SELECT unnest(range(5)) AS f)"

#: All orders are made by a join of the five filters with themselves; each step then sums the cells anew.
OP11_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_CUT}'), lambda w: w <> '') AS w FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x))::INT
         + 8 * regexp_matches(x, '[#$%&*|]')::INT
         + 16 * coalesce(min(t.doc_id) OVER (PARTITION BY x) < t.doc_id, false)::INT AS mask
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM {_ABC} a, {_ABC} b, {_ABC} c, {_ABC} d, {_ABC} e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT array_to_string(list_transform(fs, lambda f: chr(65 + f::INT)), '') AS filter_order, s::INT AS step,
         (1 << fs[s]) AS bit, list_sum(list_transform(fs[:s-1], lambda f: 1 << f))::BIGINT AS ahead
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
), audit AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER (mask & (coalesce(ahead, 0) | bit) = 0)::BIGINT AS kept,
         sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(ahead, 0) = 0)::BIGINT AS removed,
         sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(ahead, 0) <> 0)::BIGINT AS redundant,
         sum(n) FILTER (mask = bit)::BIGINT AS unique_fails,
         sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(ahead, 0) = 0)::BIGINT AS good_lost,
         sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(ahead, 0) = 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audit
"""

_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, big_n),
s AS (SELECT item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op8_decontam": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
