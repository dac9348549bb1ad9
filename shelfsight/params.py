"""Business constants of the analyses, as overridable parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReorderPolicy:
    """Replenishment assumptions: lead time in days, service level z, ceiling factor."""

    lead_time_days: float = 7.0
    z_score: float = 1.65
    max_factor: float = 1.5


# Advice and alert labels.
STOCKOUT, REORDER_NOW = "STOCKOUT", "REORDER NOW"
INCREASE, HOLD, DECREASE = "INCREASE", "HOLD", "DECREASE"
ACTIONS = (INCREASE, HOLD, DECREASE)

# Revenue classes by cumulative share.
SHARE_CLASSES = ("A", "B", "C")
SHARE_CLASS_NAMES = ("A - Fast Mover", "B - Medium Mover", "C - Slow Mover")

# Revenue classes by percent rank.
RANK_CLASS_NAMES = ("A-Class (Top 20%)", "B-Class (Next 30%)", "C-Class (Bottom 50%)")

# Labels of the exploratory suite.
HIGH_RISK, HEALTHY = "High Risk", "Healthy"
FAST_SELLING, SLOW_MOVING = "Fast-Selling", "Slow-Moving"
REDUCE_STOCK = "Reduce Stock / Holding Cost Risk"
INCREASE_STOCK = "Increase Stock / Stockout Risk"
OPTIMAL_STOCK = "Optimal"
