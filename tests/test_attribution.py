"""Attribution on a stream equals that of a table, whatever the order of arrival."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import attribution

SCHEMA = "session string, ts timestamp, kind string, id bigint, query string, turn_id bigint, trial_id bigint"


def table(spark, rows):
    """Rows (session, seconds, kind, id, query, turn, trial)."""
    df = spark.createDataFrame(rows, "session string, s double, kind string, id bigint, query string, turn_id bigint, trial_id bigint")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + 1_700_000_000_000_000)).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def some_rows(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        kind = r.choice(["query", "trial", "expand", "expand"])
        rows.append((f"s{r.randrange(3)}", round(r.random() * 900, 1), kind, i, f"q{r.randrange(3)}" if kind != "expand" else None, r.randrange(3) if kind != "query" else None, i if kind == "trial" else None))
    return rows


def plain(rows):
    out, decided = [], set()
    for s, at, kind, number, _, turn, _ in sorted(rows, key=lambda x: (x[1], attribution.KINDS.index(x[2]), x[3])):
        if kind != "expand":
            continue
        before = [x for x in rows if x[0] == s and (x[1], attribution.KINDS.index(x[2]), x[3]) < (at, 2, number)]
        queries = sorted((x[1], x[3], x[4]) for x in before if x[2] == "query")
        if queries and at - queries[-1][0] <= 60 + 1e-9:
            query = queries[-1][2]
            trials = sorted((x[1], x[6]) for x in before if x[2] == "trial" and x[4] == query and x[5] == turn and at - x[1] <= 300 + 1e-9 and x[6] not in decided)
            trial = trials[-1][1] if trials else None
            decided.add(trial)
            out.append((s, number, turn, query, trial))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.session, r.id, r.turn_id, r.query, r.trial_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_plain(spark, seed):
    rows = some_rows(300, seed)
    got = result(attribution.attributed(table(spark, rows)))
    assert got == plain(rows) and any(g[4] is not None for g in got) and any(g[4] is None for g in got)


def test_stream_equals_table_over_shuffled_arrivals(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", attribution.STATE_STORE)
    try:
        rows = some_rows(160, 3)
        r = random.Random(4)
        arrivals = sorted(rows, key=lambda x: x[1] + r.random() * 100)  # up to 100 seconds late
        source = str(tmp_path / "in")
        for at in range(0, len(arrivals), 60):
            table(spark, arrivals[at : at + 60]).coalesce(1).write.mode("append").parquet(source)
        end = [("end", 5000.0, "query", 10_000, "q", None, None)]
        table(spark, end).coalesce(1).write.mode("append").parquet(source)
        late = [(s, at, kind, number + 20_000, query, turn, trial) for s, at, kind, number, query, turn, trial in rows if kind == "expand"][:5]
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

        def run():
            query = attribution.attributed_stream(events, "2 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start(str(tmp_path / "out"))
            try:
                query.processAllAvailable()
            finally:
                query.stop()

        run()
        table(spark, late).coalesce(1).write.mode("append").parquet(source)  # behind the watermark: dropped
        run()
        assert result(spark.read.parquet(str(tmp_path / "out"))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_one_trial_is_decided_once(spark):
    rows = [("s", 1.0, "query", 1, "q", None, None), ("s", 2.0, "trial", 2, "q", 7, 100), ("s", 3.0, "trial", 3, "q", 7, 101), ("s", 4.0, "expand", 4, None, 7, None),
            ("s", 5.0, "expand", 5, None, 7, None), ("s", 6.0, "expand", 6, None, 7, None), ("s", 62.0, "expand", 7, None, 7, None), ("t", 5.0, "expand", 8, None, 7, None)]
    assert result(attribution.attributed(table(spark, rows))) == [("s", 4, 7, "q", 101), ("s", 5, 7, "q", 100), ("s", 6, 7, "q", None)]
