"""Queries over the TPC-H-like tables, one or more per operator."""

from reportloom.catalog import aggregates, checks, combining, formulas, lookups, predicates, presets, reports, shaping
from reportloom.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES",
    "aggregates", "checks", "combining", "formulas", "lookups", "predicates", "presets", "reports", "shaping",
]
