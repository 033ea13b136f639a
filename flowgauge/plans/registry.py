"""All registered queries of the library and their oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from flowgauge.plans import chart_plans, drift_plans, evidence_plans, fact_plans, fold_queries, fragment_plans, harness_plans, lean_plans, measure_plans, overlap_plans, ratio_plans, report_plans, repository_plans, sample_plans, session_plans
from flowgauge.plans.catalog import Plan

def extended(plans: dict[str, Plan], more: Iterable[Plan]) -> dict[str, Plan]:
    """A registry of plans with more of them; a name that is there already is refused."""
    out = dict(plans)
    for plan in more:
        if plan.name in out:
            raise ValueError(f"a plan {plan.name} is registered already")
        out[plan.name] = plan
    return out


PLANS = extended({}, (*session_plans.PLANS, *lean_plans.PLANS, *measure_plans.PLANS, *report_plans.PLANS, *fact_plans.PLANS, *drift_plans.PLANS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan.run for name, plan in PLANS.items()} | fold_queries.queries() | {p.name: p.run for p in ratio_plans.PLANS} | sample_plans.queries() | harness_plans.queries() | repository_plans.queries() | fragment_plans.queries() | chart_plans.queries() | overlap_plans.queries() | {p.name: p.run for p in evidence_plans.PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: plan.oracle for name, plan in PLANS.items()} | fold_queries.oracle_sql() | {p.name: p.oracle for p in ratio_plans.PLANS} | sample_plans.oracle_sql() | harness_plans.oracle_sql() | repository_plans.oracle_sql() | fragment_plans.oracle_sql() | chart_plans.oracle_sql() | overlap_plans.oracle_sql() | {p.name: p.oracle for p in evidence_plans.PLANS}
