"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayline.plans import q_checks, q_evals, q_issues, q_knowledge, q_rest, q_runs, q_streams, q_verdicts, q_web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**q_runs.QUERIES, **q_evals.QUERIES, **q_issues.QUERIES, **q_web.QUERIES, **q_streams.QUERIES, **q_knowledge.QUERIES, **q_checks.QUERIES, **q_rest.QUERIES, **q_verdicts.QUERIES}
ORACLE_SQL: dict[str, str] = {**q_runs.SQL, **q_evals.SQL, **q_issues.SQL, **q_web.SQL, **q_streams.SQL, **q_knowledge.SQL, **q_checks.SQL, **q_rest.SQL, **q_verdicts.SQL}
