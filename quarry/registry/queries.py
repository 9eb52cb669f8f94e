"""Registered queries: one per operator of the inventory, each over whole supplied tables
(or tables Spark derives from them). Keys are ``<id>_<function>``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

NOW = "2024-06-01 00:00:00"


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from quarry.registry import q_web, q_core  # noqa: F401
    for mod in ("q_search", "q_catalog", "q_text", "q_extract", "q_analyses", "q_stream"):
        try:
            __import__(f"quarry.registry.{mod}")
        except ModuleNotFoundError as e:  # modules are added as operators land
            if e.name != f"quarry.registry.{mod}":
                raise
