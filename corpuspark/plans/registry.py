"""All registered queries of the engine with their DuckDB SQL."""

from __future__ import annotations

from corpuspark.plans import access, audit, ingest, metrics, retrieval, streaming, usage, versions  # noqa: F401
from corpuspark.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "r20_search"
