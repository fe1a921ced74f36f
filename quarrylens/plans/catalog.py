"""The registered queries and their SQL, by name."""

from __future__ import annotations

from quarrylens.plans import anomaly_queries, calculator_queries, contract_queries, quality_queries, record_queries, stats_queries, stream_queries, tracing_queries, trend_queries

PARTS = (stats_queries, anomaly_queries, trend_queries, tracing_queries, calculator_queries, record_queries, contract_queries, quality_queries, stream_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
