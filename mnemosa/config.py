"""Settings of the engine with the defaults that recall and lifecycle operators use."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    """The defaults of the settings."""

    dim: int = 256
    top_k: int = 3
    activated_k: int = 0
    min_sim: float = 0.12
    core_size: int = 5
    max_chars: int = 800
    index_top_k: int = 2
    index_min_sim: float = 0.18
    index_max_chars: int = 400
    cross_project: bool = False
    half_life_days: float = 30
    w_sim: float = 1.0
    w_recency: float = 0.3
    w_freq: float = 0.2
    supersede_threshold: float = 0.85
    stm_capacity: int = 2000
    promote_after_freq: int = 2
    stm_recall_weight: float = 1.0
    spread_weight: float = 0.0
    queue_max_deliver: int = 5
    queue_backoff: tuple[int, ...] = (5, 30, 120, 600)
    lease_ttl: float = 300
    queue_dead_after: float = 604_800
    integrate_threshold: float = 0.92
    refine_keep_max: int = 20_000
    refine_prune_percentile: float = 0
    ttl_days: float = 0
    ttl_keep_frequency: int = 3
    recall_min_confidence: float = 0.35
    recall_max_chars: int = 1200
    attention_window_seconds: float = 300
    sensory_capacity: int = 64
    sensory_ttl_seconds: float = 900
    channel_weights: dict[str, float] = field(default_factory=lambda: {"similarity": 1.0, "lexical": 0.8, "fts": 0.6, "recency": 0.4, "frequency": 0.3})
    index_weights: dict[str, float] = field(default_factory=lambda: {"similarity": 1.0, "fts": 0.8})
    smoothing: int = 60
    per_file_cap: int = 3
    truncate_dim: int = 0
    scorer: str = "sql"
    #: Partitions of tables, chosen so that one of them fits a task: by project, by key, of a segment of postings; segments before merging.
    project_buckets: int = 8
    key_buckets: int = 8
    term_buckets: int = 4
    term_segments: int = 8

    def size(self) -> int:
        """Components of a stored vector."""
        return self.truncate_dim if 0 < self.truncate_dim < self.dim else self.dim

    @classmethod
    def from_env(cls, options: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None, prefix: str = "MNEMOSA_") -> Config:
        """Settings from options by name, else from the environment by prefix and name in capitals, else the defaults.

        A value that doesn't parse counts as not given; activated_k is at least top_k.
        """
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = (options or {}).get(f.name) or env.get(prefix + f.name.upper())
            default = getattr(DEFAULT, f.name)
            if not raw or isinstance(default, dict):
                continue
            try:
                if isinstance(default, bool):
                    given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                elif isinstance(default, tuple):
                    given[f.name] = tuple(int(x) for x in raw.split(","))
                else:
                    given[f.name] = type(default)(raw)
            except ValueError:
                continue
        out = cls(**given)
        return out if out.activated_k >= out.top_k else cls(**(given | {"activated_k": out.top_k}))


DEFAULT = Config()
