"""The queries of the training-data problems and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import importlib

# query name -> (module, function[, function that gives its SQL])
_QUERIES = {
    "p1_found": ("common_form", "p1_found", "p1_found_sql"),
    "p1_changed": ("common_form", "p1_changed", "p1_changed_sql"),
    "p2_found": ("splitting", "p2_found", "p2_found_sql"),
    "p2_pieces": ("splitting", "p2_pieces"),
    "p3_found": ("near_duplicates", "p3_found", "p3_found_sql"),
    "p3_classes": ("near_duplicates", "p3_classes"),
    "p4_found": ("answer_defects", "p4_found"),
    "p4_report": ("answer_defects", "p4_report"),
    "p5_found": ("split_overlap", "p5_found", "p5_found_sql"),
    "p5_report": ("split_overlap", "p5_report"),
    "p6_found": ("encoding", "p6_found"),
    "p6_restored": ("encoding", "p6_restored"),
    "p7_packed": ("packing", "p7_packed"),
    "p7_fill": ("packing", "p7_fill"),
    "p8_found": ("leaks", "p8_found", "p8_found_sql"),
    "p8_report": ("leaks", "p8_report", "p8_report_sql"),
    "p9_found": ("subjects", "p9_found"),
    "p9_makeup": ("subjects", "p9_makeup"),
}


def _load(module: str, name: str):
    return getattr(importlib.import_module(f"kervan.llm.{module}"), name)


def queries() -> dict:
    return {q: _load(*spec[:2]) for q, spec in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: _load(spec[0], spec[2])() for q, spec in _QUERIES.items() if len(spec) > 2}
