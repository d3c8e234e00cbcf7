"""All named queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from sessionloom.plans import engine, preparation


def queries() -> dict:
    return engine.QUERIES | {
        "p1_found": preparation.p1_found,
        "p1_instants": preparation.p1_instants,
        "p1_micros": preparation.p1_micros,
        "p3_found": preparation.p3_found,
        "p3_descendants": preparation.p3_descendants,
        "p3_ancestors": preparation.p3_ancestors,
        "p3_all_descendants": preparation.p3_all_descendants,
        "p3_all_ancestors": preparation.p3_all_ancestors,
        "p3_hierarchy": preparation.p3_hierarchy,
        "p5_found": preparation.p5_found,
        "p5_unified": preparation.p5_unified,
        "p5_cells": preparation.p5_cells,
        "p7_found": preparation.p7_found,
        "p7_messages": preparation.p7_messages,
        "p7_tables": preparation.p7_tables,
        "p7_columns": preparation.p7_columns,
        "p7_elements": preparation.p7_elements,
        "p7_tool_calls": preparation.p7_tool_calls,
    }


def oracle_sql() -> dict[str, str]:
    return engine.SQL | preparation.SQL
