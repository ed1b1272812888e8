"""State transitions of facts, each a function of the old table; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring, vec

ARCHIVED = ("superseded", "displaced", "merged", "pruned", "expired")
DAY = 86_400


def _set(df: DataFrame, where: Column, **values) -> DataFrame:
    """df with the values where the predicate is true; null counts as false."""
    hit = F.coalesce(where, F.lit(False))
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.when(hit, as_column(v)).otherwise(F.col(c)) for c, v in values.items()})


def add(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts and the rows of new with ids that facts lacks, each id once: the earliest by seq."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("seq"))).where("_n = 1").drop("_n")
    return facts.unionByName(first.join(facts.select("id"), "id", "left_anti"), allowMissingColumns=True)


def reinforce(facts: DataFrame, seen: DataFrame, now: float, promote_after: int | None = None) -> DataFrame:
    """Counts of seen ids added to frequency; archived facts are active again; promoted at the given frequency."""
    counts = seen.groupBy("id").agg(F.count("*").alias("_times"))
    out = facts.join(counts, "id", "left")
    hit = F.col("_times").isNotNull()
    if promote_after is not None:
        out = _set(out, hit & (F.col("frequency") + F.col("_times") >= promote_after), tier="ltm")
    out = _set(out, hit, frequency=(F.col("frequency") + F.col("_times")).cast(facts.schema["frequency"].dataType), last_seen=now, status="active")
    return out.drop("_times")


def promote(facts: DataFrame, where: Column, now: float) -> DataFrame:
    return _set(facts, where & (F.col("tier") == "stm"), tier="ltm", last_seen=now)


def replay(facts: DataFrame, now: float) -> DataFrame:
    """Active short-term facts that were recalled go to the long term."""
    return promote(facts, (F.col("status") == "active") & (F.coalesce("recall_count", F.lit(0)) >= 1), now)


def _ranked(facts: DataFrame, where: Column, name: str, *order: Column) -> DataFrame:
    """facts with the rank by project of the rows where the predicate holds, null elsewhere."""
    w = W.partitionBy("project_key", F.coalesce(where, F.lit(False))).orderBy(*order)
    return facts.withColumn(name, F.when(where, F.row_number().over(w)))


def displace_stm(facts: DataFrame, capacity: int) -> DataFrame:
    """Active short-term facts beyond the strongest `capacity` of their project are displaced."""
    if capacity <= 0:
        return facts
    held = (F.col("status") == "active") & (F.col("tier") == "stm")
    ranked = _ranked(facts, held, "_rank", F.desc("frequency"), F.desc("last_seen"), F.asc("id"))
    return _set(ranked, F.col("_rank") > capacity, status="displaced").drop("_rank")


def sweep(facts: DataFrame, now: float, ttl: float, keep_frequency: int) -> DataFrame:
    """Old and seldom seen active facts expire; a fact without kind or last_seen never does."""
    old = (F.col("status") == "active") & (F.col("kind") != "antipattern") & (F.col("last_seen") < now - ttl) & (F.col("frequency") < keep_frequency)
    return _set(facts, old, status="expired")


def cold(now: float, horizon: float) -> Column:
    """Archived and not seen since the horizon."""
    return F.col("status").isin(*ARCHIVED) & (F.coalesce("last_seen", "created_at") < now - horizon)


def purge(facts: DataFrame, now: float, horizon: float, project: str | None = None) -> DataFrame:
    """facts without archived ones older than the horizon; of every project unless one is named."""
    gone = cold(now, horizon)
    if project is not None:
        gone &= F.col("project_key") == project
    return facts.where(~F.coalesce(gone, F.lit(False)))


def supersede(facts: DataFrame, victims: DataFrame) -> DataFrame:
    """victims (id, by): the active ones among them are superseded."""
    by = victims.groupBy("id").agg(F.min("by").alias("_by"))
    out = facts.join(by, "id", "left")
    hit = F.col("_by").isNotNull() & (F.col("status") == "active")
    return _set(out, hit, superseded_by=F.col("_by"), status="superseded").drop("_by")


def superseding(facts: DataFrame, threshold: float, group: str = "project_key", block: int = 1024) -> DataFrame:
    """id, by: of facts (id, seq, group, vec) the first later one of the group as similar as the threshold.

    Blocks of a group meet in pairs, however large the group; a block pair keeps
    the first later match of each fact, and the least of these is taken.
    """
    import numpy as np
    import pandas as pd

    sizes = facts.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = facts.select("id", "seq", group, "vec").join(sizes, group).withColumn("_b", F.expr("cast(pmod(xxhash64(id, 3), _blocks) as int)"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "id"])
        v = np.stack(pdf["vec"].to_list()).astype(float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n > 0, n, 1)
        q = np.round(v / np.maximum(1e-300, np.abs(v).max(1, keepdims=True)) * 127)
        d = q / np.maximum(1e-300, np.linalg.norm(q, axis=1, keepdims=True))
        b = pdf["_b"].to_numpy()
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        apart = (b[:, None] != b[None, :]) if i != j else np.ones((len(b), len(b)), bool)
        later = (np.round(d @ v.T, 6) >= threshold) & apart & (np.arange(len(b))[:, None] < np.arange(len(b))[None, :])
        hit = np.flatnonzero(later.any(1))
        at = later[hit].argmax(1)
        return pd.DataFrame({"id": pdf["id"].to_numpy()[hit], "by": pdf["id"].to_numpy()[at], "by_seq": pdf["seq"].to_numpy()[at]})

    kind = facts.schema["id"].dataType.simpleString()
    found = rows.groupBy(group, "_i", "_j").applyInPandas(run, f"id {kind}, by {kind}, by_seq long")
    return found.groupBy("id").agg(F.min(F.struct("by_seq", "by"))["by"].alias("by"))


def superseding_new(facts: DataFrame, new: DataFrame, threshold: float, block: int = 1024, group: str | None = None) -> DataFrame:
    """key, by, by_seq: of facts (key, seq, vec) the first later of new (id, seq, vec), of the same group if one is named, as similar as the threshold; in pairs of blocks."""
    import numpy as np
    import pandas as pd

    of = F.col(group) if group else F.lit(0)
    left, right = facts.select(of.alias("_g"), "key", "seq", "vec"), new.select(of.alias("_g"), "id", "seq", "vec")
    blocks = lambda df, name: df.groupBy("_g").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(left, "_m").join(blocks(right, "_n"), "_g")
    deal = lambda df, key, own, mine, other, theirs: df.join(sizes, "_g").withColumn(own, F.expr(f"cast(pmod(xxhash64({key}, 3), {mine}) as int)")).withColumn(other, F.explode(F.expr(f"sequence(0, {theirs} - 1)")))
    apart = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  both sides may come from one table
    left, right = apart(deal(left, "key", "_i", "_m", "_j", "_n")), apart(deal(right, "id", "_j", "_n", "_i", "_m"))

    frame = lambda key, by, by_seq: pd.DataFrame({"key": pd.Series(key, dtype=object), "by": pd.Series(by, dtype=object), "by_seq": pd.Series(by_seq, dtype="int64")})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return frame([], [], [])
        b = b.sort_values(["seq", "id"])
        u, v = (np.stack(x["vec"].to_list()).astype(float) for x in (a, b))
        norm = lambda x: x / np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
        q = np.round(u / np.maximum(1e-300, np.abs(u).max(1, keepdims=True)) * 127)
        later = (np.round(norm(q) @ norm(v).T, 6) >= threshold) & (a["seq"].to_numpy()[:, None] < b["seq"].to_numpy()[None, :])
        hit = np.flatnonzero(later.any(1))
        at = later[hit].argmax(1)
        return frame(a["key"].to_numpy()[hit], b["id"].to_numpy()[at], b["seq"].to_numpy()[at])

    found = left.groupBy("_g", "_i", "_j").cogroup(right.groupBy("_g", "_i", "_j")).applyInPandas(run, "key string, by string, by_seq long")
    return found.groupBy("key").agg(F.min(F.struct("by_seq", "by")).alias("_b")).select("key", "_b.by", "_b.by_seq")


def named_victims(new: DataFrame, facts: DataFrame) -> DataFrame:
    """id, by of facts of the same project that new facts (id, project_key, supersedes: ids) name, but for themselves."""
    named = new.select(F.col("id").alias("by"), "project_key", F.explode("supersedes").alias("id")).where("id <> by")
    return named.join(facts.select("id", "project_key"), ["id", "project_key"]).select("id", "by")


def cluster_duplicates(facts: DataFrame, threshold: float, pool: int = 512) -> DataFrame:
    """id, survivor of facts that a stronger one of their project absorbs, greedily from the strongest.

    The pool is the operator's own bound: the newest `pool` active short-term facts of a project.
    """
    import numpy as np
    import pandas as pd

    held = facts.where("status = 'active' and tier = 'stm'")
    newest = held.withColumn("_n", F.row_number().over(W.partitionBy("project_key").orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("_n") <= pool)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["text"].fillna("").str.len()).sort_values(["frequency", "recall_count", "last_seen", "size", "id"], ascending=[False, False, False, False, True])
        v = np.stack(pdf["vec"].to_list()).astype(float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n > 0, n, 1)
        sims, ids = np.round(v @ v.T, 6), pdf["id"].to_numpy()
        survivor = np.full(len(ids), -1)
        for x in range(len(ids)):
            if survivor[x] < 0:
                hit = np.flatnonzero((sims[x] >= threshold) & (survivor < 0) & (np.arange(len(ids)) > x))
                survivor[hit] = x
        gone = np.flatnonzero(survivor >= 0)
        return pd.DataFrame({"id": ids[gone], "survivor": ids[survivor[gone]]})

    kind = facts.schema["id"].dataType.simpleString()
    columns = ["id", "project_key", "text", "vec", "frequency", "recall_count", "last_seen"]
    return newest.select(*columns).groupBy("project_key").applyInPandas(run, f"id {kind}, survivor {kind}")


def integrate(facts: DataFrame, threshold: float, pool: int = 512) -> DataFrame:
    gone = cluster_duplicates(facts, threshold, pool).select("id", F.col("survivor").alias("_by"))
    return _set(facts.join(gone, "id", "left"), F.col("_by").isNotNull(), status="merged").drop("_by")


def with_retention(facts: DataFrame, now: float) -> DataFrame:
    """facts with the retention score, from their counters and from how many facts each superseded."""
    counts = facts.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("_supersedes"))
    out = facts.join(counts, "id", "left")
    recalled = F.coalesce(F.col("last_recalled") if "last_recalled" in facts.columns else F.lit(None).cast("double"), F.col("last_seen"))
    depth = scoring.depth_of(F.col("title"), F.col("narrative") if "narrative" in facts.columns else F.lit(None).cast("string"), F.col("type"))
    score = scoring.retention(F.coalesce("recall_count", F.lit(0)), F.lit(now) - recalled, depth, F.coalesce("_supersedes", F.lit(0)), F.col("frequency"))
    return out.withColumn("retention", F.round(score, 6)).drop("_supersedes")


def refine(scored: DataFrame, keep_max: int = 20_000, percentile: float = 0) -> DataFrame:
    """Weak long-term facts are pruned: beyond keep_max, under a percentile (below 1) or an absolute score (1 and over).

    Anti-patterns are neither pruned nor counted.
    """
    held = (F.col("status") == "active") & (F.col("tier") == "ltm") & F.coalesce(F.col("kind") != "antipattern", F.lit(True))
    out = _ranked(scored, held, "_rank", F.desc("retention"), F.asc("id"))
    count = F.count("*").over(W.partitionBy("project_key", F.coalesce(held, F.lit(False))))
    weak = F.lit(False)
    if keep_max > 0:
        weak = weak | (F.col("_rank") > keep_max)
    if 0 < percentile < 1:
        weak = weak | (F.col("_rank") > F.col("_count") - F.ceil(F.col("_count") * percentile))
    elif percentile >= 1:
        weak = weak | (F.col("retention") < percentile)
    return _set(out.withColumn("_count", count), held & weak, status="pruned").drop("_rank", "_count")


def invalidate(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Active anti-patterns of which no referenced file (files: array) is left in files (path) expire."""
    refs = facts.where("status = 'active' and kind = 'antipattern'").select("id", F.explode("files").alias("path"))
    known = refs.join(files.select("path").distinct().withColumn("_here", F.lit(1)), "path", "left")
    gone = known.groupBy("id").agg(F.max("_here").alias("_any")).where("_any is null").select("id", F.lit(1).alias("_gone"))
    return _set(facts.join(gone, "id", "left"), F.col("_gone") == 1, status="expired").drop("_gone")


STEPS = ("replayed", "displaced", "merged", "pruned", "expired", "purged")


def consolidation(facts: DataFrame, now: float, capacity: int, threshold: float, keep_max: int, percentile: float = 0, horizon: float = 0, pool: int = 512, files: DataFrame | None = None) -> DataFrame:
    """facts after replay, displace, integrate, refine and invalidate, with a flag for each of STEPS; purged ones still there.

    files (path) are those that exist: without them no anti-pattern is invalidated.
    """

    def step(before: DataFrame, name: str, change, column: str) -> DataFrame:
        after = change(before.withColumn("_was", F.col(column)))
        return after.withColumn(name, (~F.col("_was").eqNullSafe(F.col(column))).cast("int")).drop("_was")

    out = step(facts, "replayed", lambda f: replay(f, now), "tier")
    out = step(out, "displaced", lambda f: displace_stm(f, capacity), "status")
    out = step(out, "merged", lambda f: integrate(f, threshold, pool), "status")
    out = step(out, "pruned", lambda f: refine(with_retention(f, now), keep_max, percentile).drop("retention"), "status")
    out = step(out, "expired", lambda f: f if files is None else invalidate(f, files), "status")
    return out.withColumn("purged", F.coalesce(cold(now, horizon), F.lit(False)).cast("int") if horizon > 0 else F.lit(0))


def consolidate(facts: DataFrame, now: float, capacity: int, threshold: float, keep_max: int, percentile: float = 0, horizon: float = 0, pool: int = 512, files: DataFrame | None = None) -> DataFrame:
    """facts after all six steps."""
    return consolidation(facts, now, capacity, threshold, keep_max, percentile, horizon, pool, files).where("purged = 0").drop(*STEPS)


def consolidation_counts(done: DataFrame) -> DataFrame:
    """One row: how many facts each step changed, from consolidation()."""
    return done.agg(*(F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in STEPS))


def mark(facts: DataFrame, ids: DataFrame, counter: str, now: float | None = None) -> DataFrame:
    """Counter plus one for each distinct id; with now, last_recalled too."""
    out = facts.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    hit = F.col("_hit") == 1
    values = {counter: (F.coalesce(F.col(counter), F.lit(0)) + 1).cast(facts.schema[counter].dataType)}
    if now is not None:
        values["last_recalled"] = F.lit(now)
    return _set(out, hit, **values).drop("_hit")


def bulk_import(facts: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts: inserted and reinforced of records (id); a record whose id came before reinforces it."""
    n = records.groupBy("id").agg(F.count("*").alias("n")).join(facts.select("id", F.lit(1).alias("old")), "id", "left")
    return n.agg(F.sum(F.when(F.col("old").isNull(), 1).otherwise(0)).alias("inserted"), F.sum(F.when(F.col("old").isNull(), F.col("n") - 1).otherwise(F.col("n"))).alias("reinforced"))


def import_counts(facts: DataFrame, rows: DataFrame, records: DataFrame, batch: int = 256) -> DataFrame:
    """label, project_key, inserted, reinforced, batches of records (label, project_key) of which rows (id, seq, label) are mapped; all null where a label isn't.

    Of the records of one new id the first by seq inserts it, whatever its label.
    """
    n = F.row_number().over(W.partitionBy("id").orderBy("seq"))
    marked = rows.withColumn("_n", n).join(facts.select("id", F.lit(1).alias("_old")).distinct(), "id", "left")
    new = (F.col("_n") == 1) & F.col("_old").isNull()
    per = marked.groupBy("label").agg(F.sum(new.cast("long")).alias("inserted"), F.sum((~new).cast("long")).alias("reinforced"))
    per = per.withColumn("batches", F.ceil(F.col("inserted") / batch))
    return records.select("label", "project_key").distinct().join(per, "label", "left")


def similar_pairs(facts: DataFrame, threshold: float, group: str, block: int = 1024) -> DataFrame:
    """a, b, sim of facts (id, group, vec) of one group as similar as the threshold, a < b, by blocks of a group."""
    import numpy as np
    import pandas as pd

    sizes = facts.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = facts.select("id", group, "vec").join(sizes, group).withColumn("_b", F.expr("cast(pmod(xxhash64(id, 3), _blocks) as int)"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["vec"].to_list()).astype(float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        sims = np.round((v / np.where(n > 0, n, 1)) @ (v / np.where(n > 0, n, 1)).T, 6)
        ids, b = pdf["id"].to_numpy(), pdf["_b"].to_numpy()
        apart = (b[:, None] != b[None, :]) if pdf["_i"].iloc[0] != pdf["_j"].iloc[0] else True
        x, y = np.nonzero((sims >= threshold) & apart & (ids[:, None] < ids[None, :]))
        return pd.DataFrame({"a": ids[x], "b": ids[y], "sim": sims[x, y]})

    return rows.groupBy(group, "_i", "_j").applyInPandas(run, "a long, b long, sim double").distinct()


def cosine_to_quantised(a: Column, b: Column) -> Column:
    """Similarity of a to b as it is stored."""
    scale = vec.scale_of(b)
    return vec.cosine(a, vec.dequantize_int8(vec.quantize_int8(b, scale), scale))
