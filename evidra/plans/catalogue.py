"""Named queries of the engine and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidra.plans import evaluation, evidence, retrieval, tables, texts

_MODULES = (retrieval, tables, texts, evaluation, evidence)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
