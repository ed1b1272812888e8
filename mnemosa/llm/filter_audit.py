"""Filter interaction audit: what each filter removes, in every order in which the filters can stand.

Direct relational replay: each document's flags meet the orders (a broadcast table
of k! rows for k filters, k at most MOST_FILTERS), the first failing step of each
order is the least place of a failing filter, the k steps are exploded, and one
conditional aggregate by part, order and step counts them, combined in the tasks
before the shuffle: a task sends a row for each part, order and step at most.

Texts are read once; what is left of a document is a written row of flags and a
digest, dealt evenly to tasks since its replay costs k! * k rows.  A copy is
found by the least doc_id of each SHA-256 digest that two documents or more have;
that table is written before the join, so a text with very many copies is on a
side that adaptive execution splits.

Defined cases: a null text is empty, and an empty text has no words.  A null lang
is the part of the empty string.  A document without doc_id is no copy of another,
nor another of it; rows that repeat a doc_id are documents of their own, and not
copies of each other.  A document with several rows of labels is good, or toxic,
if one of them says so; one without labels is neither.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Tables

LETTERS, MOST_FILTERS, DOCS_A_TASK = "ABCDE", 6, 1 << 16
WORD_GAP = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(text: Column) -> dict[str, Column]:
    """The failure conditions A to D, which need no other document."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, WORD_GAP)
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT * n,
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def flagged(docs: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """part, good, toxic and a boolean for each filter of LETTERS: a written row for each document."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    own = tables.write("flags", own.select("doc_id", "part", *(c.alias(k) for k, c in own_flags(F.col("text")).items()), F.unhex(F.sha2("text", 256)).alias("digest")))
    copied = tables.write("copied", own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = tables.write("marks", marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    joined = own.join(copied, "digest", "left").join(marks, "doc_id", "left")
    false = F.lit(False)
    return tables.write("flagged", joined.select("part", F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"), *"ABCD", F.coalesce(F.col("first") < F.col("doc_id"), false).alias("E")))


def orders(spark: SparkSession, letters: Sequence[str]) -> DataFrame:
    """filter_order, at_<letter> (the place of each filter, from 1) and steps (step, letter): k! rows."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters have all their orders replayed")
    rows = [("".join(p), *(p.index(x) + 1 for x in letters), list(enumerate(p, 1))) for p in permutations(letters)]
    return spark.createDataFrame(rows, ", ".join(["filter_order string", *(f"at_{x} int" for x in letters), "steps array<struct<step int, letter string>>"]))


def replay(flags: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of rows (part, good, toxic, a boolean for each letter)."""
    spark, over = flags.sparkSession, len(letters) + 1
    fails = F.array_compact(F.array(*(F.when(F.col(x), F.lit(x)) for x in letters)))
    each = flags.select("part", "good", "toxic", *letters, F.when(F.size(fails) == 1, F.get(fails, F.lit(0))).alias("only"))
    met = each.crossJoin(F.broadcast(orders(spark, letters)))
    first = F.least(F.lit(over), *(F.when(F.col(x), F.col(f"at_{x}")).otherwise(over) for x in letters))
    steps = met.select("part", "good", "toxic", "only", "filter_order", first.alias("first"), *letters, F.explode("steps").alias("s"))
    failing = F.lit(False)
    for x in letters:
        failing = failing | (F.col(x) & (F.col("s.letter") == x))
    rows = steps.select("part", "good", "toxic", "only", "filter_order", "first", F.col("s.step").alias("step"), F.col("s.letter").alias("letter"), failing.alias("fails"))
    here = F.col("first") == F.col("step")
    counted = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": F.col("fails") & (F.col("first") < F.col("step")),
        "unique_fails": F.col("only").eqNullSafe(F.col("letter")),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    sums = rows.groupBy("part", "filter_order", "step", "letter").agg(*(F.count_if(c).alias(k) for k, c in counted.items()))
    whole = W.partitionBy("part", "letter")  # k! rows at most
    return sums.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(whole).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of the contract over whole texts, in all their orders."""
    spark = docs.sparkSession
    tables = Tables(spark)
    flags = flagged(docs, labels, tables)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-flags.count() // DOCS_A_TASK))
    tables.drop("flags", "copied", "marks")
    return replay(flags.repartition(tasks))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(ws) < {LEAST_WORDS}, 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text),
    regexp_matches(text, '{SIGNS}'), coalesce(first < d.doc_id, false)] AS flags
  FROM d JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = d.doc_id),
pattern AS (SELECT part, good, toxic, flags, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, i AS step, o[i] AS k, o[:i - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS i)),
s AS (SELECT part, filter_order, step, k,
  CAST(sum(CASE WHEN NOT gone AND NOT flags[k] THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT gone AND flags[k] THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND flags[k] THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN flags[k] AND len(list_filter(flags, lambda x: x)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND flags[k] AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT gone AND flags[k] AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM (SELECT pattern.*, steps.*, len(list_filter(earlier, lambda x: flags[x])) > 0 AS gone FROM pattern, steps) GROUP BY part, filter_order, step, k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM s
"""
