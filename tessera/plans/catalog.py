"""Every query of the engine by name, with its oracle SQL."""

from __future__ import annotations

import importlib

from tessera.plans.registry import Builder
from tessera.plans.scoring_queries import flagship

__all__ = ["flagship", "oracles", "queries"]

MODULES = ("scoring_queries", "metric_queries", "policy_queries", "training_queries", "geometry_queries", "conversation_queries", "source_queries", "dataset_queries", "streaming_queries", "calls_queries")


def _registries():
    return [importlib.import_module(f"tessera.plans.{m}").registry for m in MODULES]


def queries() -> dict[str, Builder]:
    return {name: f for r in _registries() for name, f in r.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for r in _registries() for name, sql in r.oracles.items()}
