"""Markdown and files: sections, chunks, edit replay."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_CHARS = 6000
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```|~~~)")


def read_files(spark: SparkSession, path: str, glob: str, largest: int = 2_000_000) -> DataFrame:
    """(path, modificationTime, length, text, sha256) of files below a folder up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    small = files.filter(F.col("length") <= largest)
    return small.select("path", "modificationTime", "length", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(path of headings, text): each section with all below it. Headings inside fences are text."""
    lines = text.split("\n")
    heads: list[tuple[int, int, str]] = []
    fence = None
    for at, line in enumerate(lines):
        if mark := FENCE.match(line):
            fence = None if fence == mark[1] else fence or mark[1]
        elif fence is None and (found := HEADING.match(line)):
            heads.append((at, len(found[1]), found[2]))
    if not heads:
        if text.strip():
            yield "(no heading)", text
        return
    stack: list[tuple[int, str]] = []
    for k, (at, level, title) in enumerate(heads):
        stack = [s for s in stack if s[0] < level] + [(level, title)]
        end = next((a for a, lv, _ in heads[k + 1 :] if lv <= level), len(lines))
        yield " > ".join(t for _, t in stack), "\n".join(lines[at:end])


def chunks(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of whole paragraphs up to ``most`` characters; longer paragraphs are cut hard."""
    piece = ""
    for paragraph in re.split(r"\n\s*\n", text):
        while len(paragraph) > most:
            if piece:
                yield piece
                piece = ""
            yield paragraph[:most]
            paragraph = paragraph[most:]
        if piece and len(piece) + 2 + len(paragraph) > most:
            yield piece
            piece = ""
        piece = f"{piece}\n\n{paragraph}" if piece else paragraph
    if piece:
        yield piece


def markdown_chunks(docs: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, section, chunk_no, content, sha256) of ``docs`` (doc_id, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [
                (doc, section, number, piece, hashlib.sha256(piece.encode()).hexdigest())
                for doc, text in zip(part["doc_id"], part["text"], strict=True)
                for section, body in sections(text or "")
                for number, piece in enumerate(chunks(body, most))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "chunk_no", "content", "sha256"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id bigint, section string, chunk_no int, content string, sha256 string")


def replay_edits(edits: DataFrame) -> DataFrame:
    """(path, text, applied, failed): edits (path, seq, op, old, new, replace_all) applied in order.

    A fold over a file's sorted edits, in the JVM: ``write`` sets the text; ``edit`` replaces the first
    occurrence of ``old`` or all of them, and fails where there is none.
    """
    ordered = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "old", "new", "replace_all"))).alias("e"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("failed"))

    def step(acc, e):  # noqa: ANN001, ANN202
        at = F.instr(acc["text"], e["old"])
        first = F.concat(F.substring(acc["text"], F.lit(1), at - 1), e["new"], F.substring(acc["text"], at + F.length(e["old"]), F.length(acc["text"])))
        edited = F.when(e["replace_all"], F.replace(acc["text"], e["old"], e["new"])).otherwise(first)
        write, found = e["op"] == "write", at > 0
        return F.struct(
            F.when(write, F.coalesce(e["new"], F.lit(""))).when(found, edited).otherwise(acc["text"]).alias("text"),
            (acc["applied"] + F.when(write | found, 1).otherwise(0)).alias("applied"),
            (acc["failed"] + F.when(write | found, 0).otherwise(1)).alias("failed"),
        )

    return ordered.select("path", F.aggregate("e", start, step).alias("r")).select("path", "r.*")


def base_texts(edits: DataFrame, snapshots: DataFrame, repository: DataFrame) -> DataFrame:
    """(path, source, text, since) from which the edits of a path are to be replayed.

    Paths that are only written start from nothing. Others start from their newest snapshot (path, ts, text),
    after which edits count, or from the repository's text (path, text): ``db-and-git`` if the first edit
    fits it, ``git`` if not; or else from nothing.
    """
    ops = edits.groupBy("path").agg(F.max(F.col("op") == "edit").alias("edited"), F.min_by("old", F.when(F.col("op") == "edit", F.col("seq"))).alias("first"))
    snap = snapshots.groupBy("path").agg(F.max("ts").alias("since"), F.max_by("text", "ts").alias("snap"))
    joined = ops.join(snap, "path", "left").join(repository.select("path", F.col("text").alias("kept")), "path", "left")
    fits = (F.col("first") != "") & F.contains("kept", "first")
    source = F.when(~F.col("edited"), "write-only").when(F.col("snap").isNotNull(), "file-history").when(fits, "db-and-git").when(F.col("kept").isNotNull(), "git").otherwise("write-only")
    text = F.when(source == "file-history", F.col("snap")).when(source.isin("db-and-git", "git"), F.col("kept")).otherwise("")
    return joined.select("path", source.alias("source"), text.alias("text"), F.when(source == "file-history", F.col("since")).alias("since"))


def replay_from(edits: DataFrame, bases: DataFrame) -> DataFrame:
    """``replay_edits`` from the texts of ``base_texts``; edits up to a snapshot do not count."""
    b = bases.select("path", "text", "since")
    later = edits.join(b.select("path", "since"), "path", "left").filter(F.col("since").isNull() | (F.col("ts") > F.col("since"))).drop("since", "ts")
    first = b.select("path", F.lit(-1).cast(edits.schema["seq"].dataType).alias("seq"), F.lit("write").alias("op"), F.lit("").alias("old"), F.col("text").alias("new"), F.lit(False).alias("replace_all"))
    return replay_edits(later.unionByName(first)).withColumn("applied", F.col("applied") - 1)


def changelog_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, version, section, bullets): bullets of each section of a changelog."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    marked = lines.withColumns({
        "version": F.last(F.nullif(F.regexp_extract("line", r"^## \[?([^\]\s]+)\]?", 1), F.lit("")), ignorenulls=True).over(w),
        "section": F.last(F.nullif(F.regexp_extract("line", r"^### (.+?)\s*$", 1), F.lit("")), ignorenulls=True).over(w),
    })
    bullets = marked.filter(F.col("line").rlike(r"^\s*[-*] ") & F.col("version").isNotNull())
    return bullets.groupBy("doc_id", "version", "section").agg(F.count("*").alias("bullets"))
