"""Import of other stores' observations and summaries, and of distiller output."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a session's summary that each become a fact.
SUMMARY_FIELDS = ("request", "investigated", "learned", "completed", "next_steps", "notes")
#: Kinds of observations, and the one for any other.
TYPES, OTHER_TYPE = ("decision", "bugfix", "feature", "refactor", "discovery", "change"), "discovery"


def epoch_seconds(v: Column) -> Column:
    """Milliseconds or seconds as seconds."""
    return F.when(v > 1e12, v / 1000).otherwise(v.cast("double"))


def str_list(json: Column) -> Column:
    """A JSON array of strings; empty where there is none."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def merged_files(read: Column, modified: Column) -> Column:
    """Both lists, each name once, in order of first appearance."""
    names = F.transform(F.concat(str_list(read), str_list(modified)), lambda f: F.trim(f))
    return F.array_distinct(F.filter(names, lambda f: f != ""))


def summary_facts(summaries: DataFrame, fields: list[str], *keys: str) -> DataFrame:
    """keys, field, value: a row for each field that is filled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    return summaries.select(*keys, pairs.alias("p")).select(*keys, "p.field", "p.value").where("trim(value) <> ''")


def observation_facts(observations: DataFrame) -> DataFrame:
    """A row for each fact of each observation; where it has none, its title and subtitle, else its narrative.  The files come with each."""
    facts = F.filter(F.transform(str_list(F.col("facts")), lambda f: F.trim(f)), lambda f: f != "")
    names = F.filter(F.array("title", "subtitle"), lambda t: t.isNotNull() & (t != ""))
    alone = F.when(F.size(names) > 0, F.array_join(names, " — ")).otherwise(F.trim(F.coalesce("narrative", F.lit(""))))
    lines = F.when(F.size(facts) > 0, facts).otherwise(F.array(alone))
    return observations.select("id", "project", "type", "title", "subtitle", "narrative", merged_files(F.col("files_read"), F.col("files_modified")).alias("files"), epoch_seconds(F.col("created_at_epoch")).alias("created_at"), F.posexplode(lines).alias("place", "text")).where("trim(text) <> ''")


@dataclass(frozen=True)
class Source:
    """A store of another tool: its observations and session summaries, as DataFrames; either may be missing."""

    observations: DataFrame | None = None
    summaries: DataFrame | None = None

    def available(self) -> bool:
        return self.observations is not None

    def labels(self) -> DataFrame:
        """The distinct projects of both tables; nulls and empty ones are left out."""
        parts = [t.select(F.col("project").alias("label")) for t in (self.observations, self.summaries) if t is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where("label <> ''").distinct()

    def records(self, label: str | None = None) -> DataFrame:
        """label, seq, text, title, subtitle, narrative, files, type, observation_id, created_at: observations by id, then summaries by id, in the order of seq."""
        blank = F.lit(None).cast("string")
        o = observation_facts(self.observations)
        seq = lambda table, id_, place: F.struct(F.lit(table).alias("t"), id_.cast("long").alias("i"), place.cast("int").alias("p")).alias("seq")
        out = o.select(F.col("project").alias("label"), seq(0, F.col("id"), F.col("place")), "text", "title", "subtitle", "narrative", "files", "type", F.concat(F.lit("cm-obs-"), F.col("id").cast("string")).alias("observation_id"), "created_at")
        if self.summaries is not None:
            at = {f: i for i, f in enumerate(SUMMARY_FIELDS)}
            s = summary_facts(self.summaries.withColumn("created_at", epoch_seconds(F.col("created_at_epoch"))), list(SUMMARY_FIELDS), "id", "project", "created_at")
            place = F.element_at(F.create_map(*(F.lit(x) for kv in at.items() for x in kv)), F.col("field"))
            out = out.unionByName(s.select(F.col("project").alias("label"), seq(1, F.col("id"), place), F.trim("value").alias("text"), F.col("field").alias("title"), blank.alias("subtitle"), blank.alias("narrative"), F.array().cast("array<string>").alias("files"), F.lit("summary").alias("type"), F.concat_ws("-", F.lit("cm-sum"), F.col("id").cast("string"), F.col("field")).alias("observation_id"), "created_at"))
        return out.where("label <> ''" if label is None else F.col("label") == label)


def db_path(explicit: str | None, variable: str, name: str, home: str | Path, env: Mapping[str, str] | None = None, settings: Mapping[str, str] | None = None) -> Path:
    """Where another tool keeps its store: as said, else by an environment variable (a file or its folder), else by its settings' `data_dir`, else under home."""
    env = os.environ if env is None else env
    for found in (explicit, env.get(variable)):
        if found:
            p = Path(found).expanduser()
            return p / name if p.is_dir() else p
    folder = (settings or {}).get("data_dir")
    return Path(folder).expanduser() / name if folder else Path(home) / name


OBSERVATION = "struct<type:string,title:string,subtitle:string,facts:array<string>,narrative:string,files:array<string>,supersedes:array<string>>"
RECORD = "struct<text:string,title:string,narrative:string,files:array<string>,supersedes:array<string>>"
#: Texts that stand for nothing.
SENTINELS = ("none", "null", "n/a", "na", "-", "")
RULE = "struct<title:string,scope:string,anti_pattern:string,root_cause:string,strict_rule:string,dont:string,do:string,supersedes:array<string>>"
#: Parts of a summary's narrative and their headings.
SUMMARY_PARTS = {"investigated": "Investigated", "learned": "Learned", "completed": "Completed", "next_steps": "Next steps"}


def json_body(raw: Column) -> Column:
    """The JSON object of an answer: fenced, wrapped in prose, or bare."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(raw, r"(?s)(\{.*\})", 1))


def kind_of(type_: Column) -> Column:
    """One of the kinds of observations."""
    t = F.lower(F.trim(type_))
    return F.when(t.isin(*TYPES), t).otherwise(OTHER_TYPE)


def _real(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull() & ~F.lower(F.trim(t)).isin(*SENTINELS))


def distilled(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Facts of a distiller's answers: of observations, else of records; what is superseded goes with the first fact only."""
    parsed = F.from_json(json_body(F.col(raw)), f"observations array<{OBSERVATION}>, facts array<{RECORD}>")
    rows = answers.withColumn("_p", parsed)
    o = rows.select("*", F.explode("_p.observations").alias("o"))
    nothing = F.array().cast("array<string>")
    by_observation = o.select(*[c for c in answers.columns if c != raw], F.posexplode(_real(F.col("o.facts"))).alias("place", "text"), kind_of(F.col("o.type")).alias("type"), "o.title", "o.narrative", "o.files", observation_id(F.col("o.title"), F.col("o.facts")).alias("observation_id"), _real(F.col("o.supersedes")).alias("s"))
    by_observation = by_observation.withColumn("supersedes", F.when(F.col("place") == 0, F.coalesce("s", nothing)).otherwise(nothing)).drop("s", "place")
    r = rows.where("_p.observations is null").select(*[c for c in answers.columns if c != raw], F.explode("_p.facts").alias("f"))
    by_record = r.select(*[c for c in answers.columns if c != raw], "f.text", F.lit(None).cast("string").alias("type"), "f.title", "f.narrative", "f.files", F.lit(None).cast("string").alias("observation_id"), F.coalesce(_real(F.col("f.supersedes")), nothing).alias("supersedes"))
    return by_observation.unionByName(by_record.where(~F.lower(F.trim("text")).isin(*SENTINELS)))


def observation_id(title: Column, facts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", F.coalesce(title, F.lit("")), F.array_join(facts, "\0")), 256), 1, 16)


def merged_text(raw: Column) -> Column:
    """The text that a distiller made of several facts; null if it found them distinct, or gave nothing."""
    t = F.trim(F.get_json_object(json_body(raw), "$.merged"))
    return F.when(~F.lower(t).isin(*SENTINELS) & (F.upper(t) != "DISTINCT"), t)


def summaries(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """The summary record of each answer that has one: text, title, narrative, type; the title, else the head of what was completed, is its text."""
    part = lambda f: F.trim(F.coalesce(F.get_json_object(json_body(F.col(raw)), f"$.{f}"), F.lit("")))
    lines = F.filter(F.array(*(F.when(part(f) != "", F.concat(F.lit(f"{name}: "), part(f))) for f, name in SUMMARY_PARTS.items())), lambda x: x.isNotNull())
    text = F.when(part("title") != "", part("title")).otherwise(F.substring(part("completed"), 1, 200))
    keys = [c for c in answers.columns if c != raw]
    return answers.select(*keys, text.alias("text"), part("title").alias("title"), F.array_join(lines, "\n").alias("narrative"), F.lit("session_summary").alias("type")).where("text <> ''")


def antipatterns(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """The rules of each answer: text is the rule alone; its cause and what to do instead are the narrative."""
    from ..functions import rules

    body = json_body(F.col(raw))
    listed = F.coalesce(F.from_json(body, f"antipatterns array<{RULE}>")["antipatterns"], F.from_json(F.regexp_extract(raw, r"(?s)(\[.*\])", 1), f"array<{RULE}>"))
    keys = [c for c in answers.columns if c != raw]
    r = answers.select(*keys, F.explode(listed).alias("r"))
    part = lambda f, head: F.when(F.trim(F.coalesce(F.col(f"r.{f}"), F.lit(""))) != "", F.concat(F.lit(head), F.trim(f"r.{f}")))
    lines = F.filter(F.array(part("root_cause", "Root cause: "), part("dont", "DON'T: "), part("do", "DO: ")), lambda x: x.isNotNull())
    scope = F.when(F.lower(F.trim("r.scope")) == "global", "global").otherwise("project")
    named = F.coalesce(F.filter(F.transform("r.supersedes", F.trim), lambda s: ~F.lower(s).isin(*SENTINELS)), F.array().cast("array<string>"))
    out = r.select(*keys, rules.rule_text(F.col("r.strict_rule")).alias("text"), F.trim("r.title").alias("title"), F.trim("r.anti_pattern").alias("subtitle"), F.array_join(lines, "\n").alias("narrative"), F.lit("antipattern").alias("type"), scope.alias("scope"), named.alias("supersedes"))
    return out.where("text <> ''")
