"""Parameters of the analytics; every one can be passed to the operators instead."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    now: str = "2026-03-26 00:00:00"  # analytics never ask the clock
    min_group: int = 5
    min_area: float = 20.0
    max_area: float = 500.0
    min_per_sqm: float = 700.0
    max_per_sqm: float = 15_000.0
    min_price: float = 5_000.0
    min_rent: float = 100.0
    z_limit: float = -1.5
    share_of_mean: float = 0.85
    drop_pct: float = 5.0
    sold_after_days: int = 14
    min_seen_ratio: float = 0.5
    eur_rate: float = 1.9558
    smoothing: float = 20.0
    ridge_alpha: float = 0.1
    min_exits: int = 10
    deal_residual: float = -15.0
    photo_bits: int = 6
    text_bits: int = 3
    text_shingle: int = 5
    text_similarity: float = 0.8
    candidate_cap: int = 400
    material_delta: float = 0.25
    drift_pct: float = 30.0
    benchmark_pct: float = 40.0
    apartment_like: tuple[str, ...] = field(default=("apartment", "studio", "maisonette"))


DEFAULT = Rules()
