"""Risk parameters, kept together so that a caller can replace any of them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LogisticScore:
    """Coefficients of the behavioural default score."""

    intercept: float = -3.5
    utilization: float = 2.5
    dpd_per_30_days: float = 1.8
    delinquent_month: float = 0.4
    payment_ratio: float = -1.5


@dataclass(frozen=True)
class RiskConfig:
    delinquent_dpd: int = 30
    serious_dpd: int = 60
    default_dpd: int = 90
    ccf: float = 0.75
    balance_shock: float = 1.25
    delinquency_shock: float = 1.30
    stage_2_score: float = 0.20
    stage_3_score: float = 0.60
    maxed_utilization: float = 0.9
    early_statements: int = 3
    early_mob: int = 6
    streak_months: int = 3
    origination_mob: int = 1
    key_mobs: tuple[int, ...] = (6, 12, 18, 24)
    seed: int = 42
    test_share: float = 0.2
    score: LogisticScore = field(default_factory=LogisticScore)


DEFAULTS = RiskConfig()
