"""Collects the queries and oracles of the plan modules."""

from __future__ import annotations

from . import metagene_queries, overlap_queries, report_queries


def _modules():
    return report_queries, metagene_queries, overlap_queries


def queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
