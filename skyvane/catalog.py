"""All queries of the analytics operators by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from skyvane.plans import check_queries, history_queries, log_queries, report_queries, stateful_queries

QUERIES: dict = {**report_queries.QUERIES, **history_queries.QUERIES, **log_queries.QUERIES, **stateful_queries.QUERIES, **check_queries.QUERIES}
SQL: dict = {**report_queries.SQL, **history_queries.SQL, **log_queries.SQL, **stateful_queries.SQL, **check_queries.SQL}
