"""Registered queries (one per operator of the survey) and their oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ["catalog", "vendors", "orders", "ratings", "changes", "integrity", "streams", "listing"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .registry import ORACLE, QUERIES
    return QUERIES, ORACLE


def all_queries():
    return dict(_load()[0])


def all_oracle():
    return dict(_load()[1])
