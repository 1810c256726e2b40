"""Registry of queries: a DataFrame callable plus, where SQL can say it, its oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meltwise.plans.fixtures import Tables
from meltwise.plans.fixture_sql import FIXTURE_SQL

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}  # raw text; expand() adds the fixture views
_NAME = re.compile(r"\bf_[a-z0-9_]+\b")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may use the f_* fixture views."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def expand(sql: str) -> str:
    """Prefix the fixture views that ``sql`` uses, in dependency order, as a WITH list."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for ref in _NAME.findall(text):
            if ref in FIXTURE_SQL and ref not in ordered:
                visit(FIXTURE_SQL[ref])
                if ref not in ordered:
                    ordered.append(ref)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    views = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    return run
