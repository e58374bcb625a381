"""Transcripts of assistant sessions: lines of JSON to sessions, turns, tool calls and file touches.

The same transform serves batch reads and the incremental stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USAGE = "struct<input_tokens:long,output_tokens:long>"
LINE = (
    "struct<type:string,uuid:string,parentUuid:string,timestamp:string,sessionId:string,cwd:string,aiTitle:string,"
    f"message:struct<role:string,model:string,usage:{USAGE},content:string>>"
)
BLOCK = (
    "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>"
)
WRITERS = ("Write", "Edit", "MultiEdit")


ORPHAN = "_orphan"


def slug_of(folder: Column) -> Column:
    """The project from an encoded folder, in which ``-`` stands for ``/``: what follows the first
    ``-projects-``, or the hidden folder of a home, or what follows the home, or all but leading hyphens."""
    after = lambda p: F.nullif(F.regexp_extract(folder, p, 1), F.lit(""))
    whole = F.when(F.coalesce(folder, F.lit("")) == "", ORPHAN).when(F.contains(folder, F.lit("-projects-")), F.coalesce(after(r"^.*?-projects-(.+)$"), folder))
    return whole.otherwise(F.coalesce(after(r"^-home-[^-]+--(.+)$"), after(r"^-home-[^-]+-(.+)$"), F.ltrim(folder, F.lit("-"))))


def project_of(path: Column) -> Column:
    """The project from the folder of a transcript."""
    return slug_of(F.try_element_at(F.split(path, "/"), F.lit(-2)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of every line below a folder, in file order."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return lines.filter(F.trim("value") != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``j``, the parsed object, or null where a line is not JSON."""
    return lines.withColumn("j", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))


def session_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def blocks(parsed: DataFrame) -> DataFrame:
    """One row for each content block of user and assistant lines, keyed by (session, line, block).

    Content is a string (one text block) or a list of blocks. The key keeps every block of a line.
    """
    rows = parsed.filter(F.col("j.type").isin("user", "assistant")).withColumn("content", F.col("j.message.content"))
    listed = F.from_json("content", f"array<{BLOCK}>")
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))
    plain = F.transform(plain, lambda b: F.from_json(F.to_json(b), BLOCK))
    either = F.when(F.col("content").startswith("["), listed).otherwise(plain)
    out = rows.select(
        session_of(F.col("path")).alias("session_id"),
        project_of(F.col("path")).alias("project"),
        "line_no",
        F.try_to_timestamp("j.timestamp").alias("ts"),
        F.coalesce("j.message.role", "j.type").alias("role"),
        F.col("j.message.model").alias("model"),
        F.col("j.message.usage.input_tokens").alias("tokens_in"),
        F.col("j.message.usage.output_tokens").alias("tokens_out"),
        F.posexplode(either).alias("block_no", "b"),
    )
    return out


def turns(of: DataFrame) -> DataFrame:
    """(session_id, project, line_no, block_no, idx, role, ts, content_type, content, ...) in order.

    NUL characters go.
    """
    content = F.coalesce("b.text", "b.thinking", F.when(F.col("b.type") == "tool_use", F.col("b.input")), "b.content")
    rows = of.select("session_id", "project", "line_no", "block_no", "role", "ts", F.coalesce("b.type", F.lit("text")).alias("content_type"),
                     F.translate(content, "\u0000", "").alias("content"), "model", "tokens_in", "tokens_out").filter("content is not null")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("session_id").orderBy("line_no", "block_no")) - 1)


def tool_calls(of: DataFrame) -> DataFrame:
    """Calls with their results: output and error flag come from the block that answers the call."""
    calls = of.filter("b.type = 'tool_use'").select("session_id", "project", "line_no", "ts", F.col("b.id").alias("call_id"),
                                                     F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"))
    results = of.filter("b.type = 'tool_result'").select(
        F.col("session_id").alias("s2"), F.col("b.tool_use_id").alias("call_id2"), F.col("b.content").alias("tool_output"),
        F.coalesce("b.is_error", F.lit(False)).alias("is_error"), F.col("ts").alias("done"),
    )
    joined = calls.join(results, (F.col("session_id") == F.col("s2")) & (F.col("call_id") == F.col("call_id2")), "left").drop("s2", "call_id2")
    return joined.withColumn("duration_ms", F.timestamp_diff("MILLISECOND", F.col("ts"), F.col("done"))).drop("done")


def file_touches(calls: DataFrame) -> DataFrame:
    """(session_id, ts, file_path, op) of calls that write files."""
    path = F.get_json_object("tool_input", "$.file_path")
    rows = calls.filter(F.col("tool_name").isin(*WRITERS)).select("session_id", "ts", path.alias("file_path"), F.lower("tool_name").alias("op"))
    return rows.filter("file_path is not null")


def edit_operations(calls: DataFrame, target: str | None = None) -> DataFrame:
    """(path, seq, op, old, new, replace_all, ts) of the writes and edits of files, in order of time.

    The edits of one call of several keep their order. ``target`` limits them to paths that end with it or
    contain it. What ``documents.replay_edits`` takes.
    """
    edit = "struct<old_string:string,new_string:string,replace_all:boolean>"
    row = f"struct<file_path:string,content:string,old_string:string,new_string:string,replace_all:boolean,edits:array<{edit}>>"
    rows = calls.filter(F.col("tool_name").isin(*WRITERS)).select("session_id", "line_no", "ts", "call_id", "tool_name", F.from_json("tool_input", row).alias("i"))
    rows = rows.withColumn("path", F.translate("i.file_path", "\\", "/")).filter("path <> ''")
    if target:
        t = target.replace("\\", "/")
        rows = rows.filter(F.col("path").endswith(t.lstrip("/")) | F.contains("path", F.lit(t)))
    write = F.array(F.struct(F.lit("write").alias("op"), F.lit("").alias("old"), F.coalesce("i.content", F.lit("")).alias("new"), F.lit(False).alias("replace_all")))
    one = lambda e: F.struct(F.lit("edit").alias("op"), F.coalesce(e["old_string"], F.lit("")).alias("old"), F.coalesce(e["new_string"], F.lit("")).alias("new"), F.coalesce(e["replace_all"], F.lit(False)).alias("replace_all"))
    ops = F.when(F.col("tool_name") == "Write", write).when(F.col("tool_name") == "Edit", F.array(one(F.col("i")))).otherwise(F.transform(F.coalesce("i.edits", F.array().cast(f"array<{edit}>")), one))
    each = rows.select("path", "session_id", "line_no", "ts", "call_id", F.posexplode(ops).alias("n", "o"))
    order = Window.partitionBy("path").orderBy("ts", "session_id", "line_no", "call_id", "n")
    return each.withColumn("seq", F.row_number().over(order) - 1).select("path", "seq", "o.op", "o.old", "o.new", "o.replace_all", "ts")


def sessions(of_turns: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per session: project, title, first and last time, turns and token totals (each line's usage once)."""
    lines = of_turns.groupBy("session_id", "project", "line_no").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.max("tokens_in").alias("i"), F.max("tokens_out").alias("o"))
    sums = lines.groupBy("session_id", "project").agg(
        F.min("a").alias("started_at"), F.max("b").alias("ended_at"), F.sum("n").alias("total_turns"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("o"), F.lit(0)).alias("tokens_out"),
    )
    titles = parsed.filter("j.type = 'ai-title'").groupBy(session_of(F.col("path")).alias("session_id")).agg(F.max_by("j.aiTitle", "line_no").alias("title"))
    return sums.join(titles, "session_id", "left")


def after_cursor(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """Lines past each session's cursor (session_id, line_no)."""
    seen = cursors.select(F.col("session_id").alias("s"), F.col("line_no").alias("upto"))
    new = lines.join(seen, session_of(F.col("path")) == F.col("s"), "left").filter(F.col("upto").isNull() | (F.col("line_no") > F.col("upto")))
    return new.drop("s", "upto")


def damaged(parsed: DataFrame) -> DataFrame:
    """(path, lines, bad): transcripts with lines that are not JSON objects."""
    return parsed.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("j").isNull() | F.col("j.type").isNull()).alias("bad")).filter("bad > 0")


def export_ndjson(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
