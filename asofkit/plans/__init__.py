"""Registered queries: each a function of (spark, folder of tables) with SQL that says the same."""

from __future__ import annotations

from asofkit.plans import aggregates, asof, builders, evaluation, groups, lifecycles, messages, metrics, regimes, rows, simulation, store, text
from asofkit.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregates", "asof", "builders", "evaluation", "groups", "lifecycles", "messages", "metrics", "regimes", "rows", "simulation", "store", "text"]
