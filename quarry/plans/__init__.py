"""Plans as trees of plain values."""

from quarry.plans.explain import explain_plan

__all__ = ["explain_plan"]
