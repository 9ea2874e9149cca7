"""Registered queries over the given tables."""

from __future__ import annotations

from . import analytics, features, quality, research, sources
from .registry import ORACLE, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(ORACLE)


def flagship(spark, sf_dir: str):
    return QUERIES["w1_research_table"](spark, sf_dir)
