"""Registered queries, one module per operator group."""

from importlib import import_module

from panelwright.plans.registry import ORACLE, QUERIES
from panelwright.sources.panels import split_plan

for _name in ("io_plans", "prep_plans", "window_plans", "xs_plans", "join_plans", "agg_plans", "account_plans", "feature_plans", "signal_plans", "model_plans", "diag_plans", "audit_plans"):
    import_module(f"panelwright.plans.{_name}")


def _split_twin(name):
    """The same result from the plan for cross-sections that fit no single task."""
    def run(spark, sf):
        with split_plan():
            return QUERIES[name](spark, sf)

    return run


for _name in [n for n in QUERIES if n.startswith("cs_")]:
    QUERIES[f"{_name}_split"] = _split_twin(_name)
    if _name in ORACLE:
        ORACLE[f"{_name}_split"] = ORACLE[_name]
