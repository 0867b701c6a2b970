"""Registry of every implemented query: name -> (spark, sf_dir) -> DataFrame, plus its DuckDB oracle."""

from __future__ import annotations

import importlib

_MODULES = ["q_core", "q_text", "q_report", "q_eval", "q_lab", "q_catalog", "q_sources", "q_scoring", "q_stream"]


def _load():
    queries, sql = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"revidence.plans.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"duplicate query key {k}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
