"""Transcripts that grow, are cut in a line, are written anew, and are read by a query that starts again."""

from __future__ import annotations

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import growing, transcripts
from quarry.streaming import incremental

COLUMNS = ["session_id", "project", "line_no", "block_no", "idx", "role", "content_type", "content"]


def line(text, role="user"):
    return json.dumps({"type": role, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": text}}, ensure_ascii=False)


@pytest.fixture
def at(tmp_path):
    folder = tmp_path / "-home-al-projects-demo"
    folder.mkdir()
    return folder


def trigger(spark, at, tmp_path, checkpoint="cp", range_bytes=100):
    query = incremental.ingest_stream(spark, str(at), str(tmp_path / "out"), str(tmp_path / checkpoint), range_bytes)
    query.trigger(availableNow=True).start().awaitTermination()


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def same_as_batch(spark, at, tmp_path):
    batch = transcripts.turns(transcripts.blocks(transcripts.parse_lines(transcripts.read_lines(spark, str(at)))))
    return rows(incremental.stored_turns(spark, str(tmp_path / "out"))) == rows(batch)


def test_appended_cut_rewritten_and_restarted(spark, at, tmp_path):
    a, b = at / "a.jsonl", at / "b.jsonl"
    a.write_text(f"{line('one')}\n\n{line('two é')}\n")
    trigger(spark, at, tmp_path)
    assert same_as_batch(spark, at, tmp_path)
    third = line("three")
    with a.open("a") as f:  # cut in the middle of a line
        f.write(f"{line('and more')}\n{third[:20]}")
    b.write_text(f"{line('other')}\nnot json\n{line('x' * 500)}\n")
    trigger(spark, at, tmp_path)
    stored = incremental.stored_turns(spark, str(tmp_path / "out"))
    assert sorted(r.content for r in stored.collect()) == sorted(["one", "two é", "and more", "other", "x" * 500])
    with a.open("a") as f:
        f.write(f"{third[20:]}\n")
    trigger(spark, at, tmp_path)
    trigger(spark, at, tmp_path)  # nothing new
    assert same_as_batch(spark, at, tmp_path)
    a.write_text(f"{line('anew')}\n")  # shorter
    trigger(spark, at, tmp_path)
    assert same_as_batch(spark, at, tmp_path)
    a.write_text("".join(f"{line(f'turn {i}')}\n" for i in range(40)))  # longer, with another begin
    trigger(spark, at, tmp_path)
    assert same_as_batch(spark, at, tmp_path)
    trigger(spark, at, tmp_path, checkpoint="other")  # all of it delivered again
    assert same_as_batch(spark, at, tmp_path)
    with b.open("a") as f:
        f.write(f"{line('later', 'assistant')}\n")
    trigger(spark, at, tmp_path, checkpoint="other")
    trigger(spark, at, tmp_path)
    assert same_as_batch(spark, at, tmp_path)


def test_a_batch_that_failed_is_read_again(spark, at, tmp_path, monkeypatch):
    a = at / "a.jsonl"
    a.write_text(f"{line('one')}\n{line('two')}\n")
    trigger(spark, at, tmp_path)
    with a.open("a") as f:
        f.write(f"{line('three')}\n")

    real = transcripts.turns
    monkeypatch.setattr(transcripts, "turns", lambda of: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        trigger(spark, at, tmp_path)
    monkeypatch.setattr(transcripts, "turns", real)
    with a.open("a") as f:
        f.write(f"{line('four')}\n")
    trigger(spark, at, tmp_path)
    trigger(spark, at, tmp_path)  # the first run ends with the batch that failed
    assert same_as_batch(spark, at, tmp_path)


def test_ranges_share_lines_out(tmp_path):
    r = random.Random(3)
    for _ in range(300):
        text = b"\n".join(b"x" * r.choice([0, 0, 1, 5, 30]) for _ in range(r.randrange(1, 30))) + b"\n"
        file, step = tmp_path / "f", r.randrange(1, 40)
        file.write_bytes(text)
        from pyarrow import fs

        with fs.LocalFileSystem().open_input_file(str(file)) as f:
            got = [value for first in range(0, len(text), step) for _, value in growing.lines_of(f, first, min(len(text), first + step))]
            assert growing.whole_lines(f, len(text)) == len(text)
        assert got == text.split(b"\n")[:-1]


def test_numbers_go_on_over_ranges(spark):
    batch = spark.createDataFrame([("p", False, 50, 0, "c"), ("p", False, 50, 1, "d"), ("p", False, 90, 0, "e"), ("q", True, 0, 0, "a")], growing.SCHEMA)
    known = spark.createDataFrame([("p", 7), ("q", 9)], "path string, lines bigint")
    got = incremental.numbered(batch, known).select("path", "line_no", "value").collect()
    assert sorted(map(tuple, got)) == [("p", 7, "c"), ("p", 8, "d"), ("p", 9, "e"), ("q", 0, "a")]
