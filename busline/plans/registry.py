"""Registry of queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from busline.plans.views import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _needs(body: str) -> list[str]:
    """Shared CTEs a statement mentions, each after those it builds on."""
    order: list[str] = []

    def visit(text: str, open_: tuple[str, ...]) -> None:
        for name in CTES:
            if name not in order and name not in open_ and re.search(rf"\b{name}\b", text):
                visit(CTES[name], (*open_, name))
                order.append(name)

    visit(body, ())
    return order


def with_ctes(body: str) -> str:
    """Prefix a statement with the shared CTEs it uses; its own WITH list is kept."""
    body = body.strip()
    names = _needs(body)
    if not names:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    own = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return f"WITH {own[1] or ''}{head},\n{body[own.end():]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
