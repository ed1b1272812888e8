"""Transcripts: JSON lines of user and assistant messages, tool calls and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

CONTENT = "array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,input:map<string,string>,content:string>>"
MESSAGE = "type string, message struct<role:string, content:string>"
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"


def prompts(turns: DataFrame, least: int = 12, most: int = 600) -> DataFrame:
    """conv_id, turn, line: what users asked, where it is neither too short nor too long."""
    line = F.trim("text")
    return turns.where((F.col("role") == "user") & F.length(line).between(least, most)).select("conv_id", "turn", line.alias("line"))


def admissions(turns: DataFrame) -> DataFrame:
    """conv_id, turns, and in how many of them a mistake is admitted."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(rules.has_admission(F.col("text")).cast("long")).alias("admitted"))


def _parsed(lines: DataFrame, line: str) -> DataFrame:
    m = F.from_json(line, MESSAGE)
    return lines.withColumn("m", m).withColumn("role", F.coalesce("m.message.role", "m.type")).withColumn("blocks", F.from_json("m.message.content", CONTENT))


def short(value: Column, most: int = 80) -> Column:
    """On one line, cut with an ellipsis."""
    t = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def action(name: Column, args: Column) -> Column:
    """One line for a tool call; null for calls that say nothing."""
    said = lambda *keys: F.coalesce(*(args[k] for k in keys), F.lit("?"))
    path = F.regexp_replace(said("file_path"), "/+$", "")
    base = F.when(path == "", said("file_path")).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    line = lambda head, tail: F.concat(F.lit(head), tail)
    return (
        F.when(name.isin("Edit", "MultiEdit", "NotebookEdit"), line("Edited ", base))
        .when(name == "Write", line("Wrote ", base))
        .when(name == "Read", line("Read ", base))
        .when(name == "Bash", line("Ran: ", short(said("command", "description"))))
        .when(name.isin("Grep", "Glob"), line("Searched for ", short(said("pattern"), 60)))
        .when(name == "Task", line("Delegated task: ", short(said("description", "subagent_type"), 60)))
        .when(name == "WebFetch", line("Fetched ", short(said("url"), 60)))
        .when(name == "TodoWrite", F.lit(None).cast("string"))
        .when(name.startswith("mcp__"), line("Called ", name))
        .otherwise(F.concat(F.lit("Used "), name, F.lit(": "), short(F.to_json(F.coalesce(args, F.create_map().cast("map<string,string>"))), 60)))
    )


def texts(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """role and text of each message part: plain text without reminders, and an assistant's actions; scaffolding, thinking and results are left out.

    With order, a column of lines, `at` too: that and the part's place in its line.
    """
    p = _parsed(lines, line)
    at = F.col(order) if order else F.lit(0)
    plain = p.where("blocks is null").select("role", F.col("m.message.content").alias("text"), F.lit(True).alias("said"), F.struct(at.alias("line"), F.lit(0).alias("part")).alias("at"))
    b = p.select("role", at.alias("line"), F.posexplode("blocks").alias("part", "b")).withColumn("at", F.struct("line", "part"))
    part = F.when(F.col("b.type") == "text", F.col("b.text")).when((F.col("b.type") == "tool_use") & (F.col("role") == "assistant"), action(F.col("b.name"), F.col("b.input")))
    both = plain.unionByName(b.select("role", part.alias("text"), (F.col("b.type") == "text").alias("said"), "at"))
    cleaned = both.select("role", F.regexp_replace(F.regexp_replace("text", REMINDER, ""), r"^\s+|\s+$", "").alias("text"), "said", "at").where("text <> '' and role in ('user', 'assistant')")
    return cleaned.where(~((F.col("role") == "user") & F.col("said") & rules.is_harness(F.col("text")))).select("role", "text", *["at"] * bool(order))


def asked(lines: DataFrame, line: str = "value") -> DataFrame:
    """text: what users wrote, word for word."""
    return texts(lines, line).where("role = 'user'").select("text")


def tool_calls(lines: DataFrame, line: str = "value") -> DataFrame:
    """id, name, input and bytes of each tool call: its use joined with its results."""
    b = _parsed(lines, line).select(F.explode("blocks").alias("b"))
    uses = b.where("b.type = 'tool_use'").select("b.id", "b.name", "b.input")
    # the blocks as VARIANT: from_json gives a string's text where its JSON is wanted
    raw = _parsed(lines, line).select(F.explode(F.try_variant_get(F.try_parse_json("m.message.content"), "$", "array<variant>")).alias("b"))
    content = F.to_json(F.try_variant_get("b", "$.content", "variant"))
    held = raw.where(F.try_variant_get("b", "$.type", "string") == "tool_result").select(F.try_variant_get("b", "$.tool_use_id", "string").alias("id"), rules.result_bytes(content).alias("n"))
    results = held.groupBy("id").agg(F.sum(F.col("n").cast("long")).alias("bytes"))
    return uses.join(results, "id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def size_of(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def read_delta(spark: SparkSession, path: str, offset: int) -> tuple[list[str], int]:
    """The whole lines after a byte offset and the new offset; a file shorter than the offset was replaced and is read anew.

    One transcript's new tail, read through Spark's file system, is the unit of capture.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    start = offset if offset <= size else 0
    stream = fs.open(p)
    try:
        stream.seek(start)
        data = bytes(stream.readNBytes(size - start))
    finally:
        stream.close()
    whole = data[: data.rfind(b"\n") + 1]
    return whole.decode(errors="replace").splitlines(), start + len(whole)
