"""All queries of the core, by name."""

from __future__ import annotations

from folioscope.plans import drift_queries, page_queries, run_queries, snapshot_queries, structure_queries, style_queries

MODULES = [snapshot_queries, style_queries, structure_queries, drift_queries, run_queries, page_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def entry(spark, sf_dir):
    return snapshot_queries.p1_found(spark, sf_dir)
