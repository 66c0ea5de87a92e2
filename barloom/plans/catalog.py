"""Imports every plan module so that its queries are registered."""

from barloom.plans import (
    bars_plans,
    extra_plans,
    feature_plans,
    indicator_plans,
    ingest_plans,
    label_plans,
    ledger_plans,
    model_plans,
    report_plans,
    rule_plans,
    stream_plans,
)
from barloom.plans.registry import REG

__all__ = ["REG"]
