"""Ranking and retention scores as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

DAY = 86_400


def recency_decay(age: Column, half_life_days: float) -> Column:
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.exp(F.greatest(F.lit(0.0), age) * (-math.log(2) / (half_life_days * DAY)))


def frequency_boost(frequency: Column, cap: int = 8) -> Column:
    f = F.coalesce(frequency, F.lit(0))
    return F.when(f <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.log(f) / math.log(cap)))


def priority(sim: Column, decay: Column, boost: Column, c: Config = DEFAULT) -> Column:
    return sim * c.w_sim + decay * c.w_recency + boost * c.w_freq


def filled(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), 1.0).otherwise(0.0)


def depth_of(title: Column, narrative: Column, type_: Column) -> Column:
    return (filled(title) + filled(narrative) + filled(type_)) / 3


def inhibition(injected: Column, used: Column) -> Column:
    i = F.coalesce(injected, F.lit(0))
    return F.when(i <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i - F.coalesce(used, F.lit(0))) / i)))


def retention(recall_count: Column, since_recall: Column, depth: Column, supersedes: Column, frequency: Column, half_life_days: float = 30) -> Column:
    """Salience and inhibition have no weight on this path."""
    return 0.3 * frequency_boost(recall_count + 1) + 0.3 * recency_decay(since_recall, half_life_days) + 0.1 * depth + 0.1 * frequency_boost(supersedes + 1) + 0.2 * frequency_boost(frequency)


def confidence(first: Column, second: Column, identity: Column) -> Column:
    """From the two leading similarities and the identity's trust; 0.0 without a first."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    gap = F.when(first <= 0, 0.0).otherwise(unit((first - F.coalesce(second, F.lit(0.0))) / first))
    strength = unit(1 - F.exp(-first / 0.5))
    log = lambda x: F.log(F.greatest(x, F.lit(1e-6)))
    return F.when(first.isNull(), 0.0).otherwise(F.bround(F.exp(0.35 * log(gap) + 0.40 * log(strength) + 0.25 * log(identity)), 3))


def importance(text: Column) -> Column:
    return F.least(F.lit(1.0), F.length(text) / 240)
