"""All registered queries with their oracle SQL."""

from __future__ import annotations

from equiloom.plans import base, candidates, company, evidence, flows, gov_map, history, lists, market, more, parsers, screener, signals_store, texts


def queries() -> dict:
    assert candidates and company and evidence and flows and gov_map and history and lists and market and more and parsers and screener and signals_store and texts
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE)
