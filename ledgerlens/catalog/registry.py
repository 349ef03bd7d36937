"""Query registry, and shared table expressions for the check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerlens.sources.testtables import Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def R(x: str, digits: int) -> str:
    """SQL for ``numbers.rounded``."""
    scale = f"1e{digits}"
    return f"(round_even(CAST({x} AS DOUBLE)*{scale},0)/{scale})"


def MED(x: str) -> str:
    """SQL aggregate: median as the mean of the two middle values."""
    s = f"list_sort(list({x}) FILTER (({x}) IS NOT NULL))"
    return f"(({s})[(count({x})+1)//2]+({s})[count({x})//2+1])/2e0"


def SIG(x: str, slope: float, centre: float) -> str:
    return f"(1e0/(1e0+exp(({-slope}::DOUBLE)*(({x})-({centre}::DOUBLE)))))"


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(body: str) -> str:
    """Put the table expressions that ``body`` mentions, and theirs, in front of it."""
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in CTES:
            if name != own and name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional check query."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register
