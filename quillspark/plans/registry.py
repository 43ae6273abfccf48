"""The registered queries and their DuckDB statements."""

from __future__ import annotations

from quillspark.operators import hierarchy, incremental, orphans, wide
from quillspark.plans import pipeline_sql as sql
from quillspark.plans import reference, reference_sql, relational


def queries():
    return {
        "p1_found": incremental.p1_found,
        "p2_found": wide.p2_found,
        "p2_wide": wide.p2_wide,
        "p5_found": hierarchy.p5_found,
        "p5_paths": hierarchy.p5_paths,
        "p5_descendants": hierarchy.p5_descendants,
        "p6_found": orphans.p6_found,
        "p6_report": orphans.p6_report,
    } | reference.QUERIES | relational.QUERIES


def oracle_sql():
    return {
        "p1_found": sql.P1,
        "p2_found": sql.P2,
        "p2_wide": sql.P2_WIDE,
        "p5_found": sql.P5,
        "p5_paths": sql.P5_PATHS,
        "p5_descendants": sql.P5_DESCENDANTS,
        "p6_found": sql.P6,
        "p6_report": sql.P6_REPORT,
    } | reference_sql.SQL | relational.SQL


def flagship(spark, sf_dir):
    return reference.bm25_topk(spark, sf_dir)
