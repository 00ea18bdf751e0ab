"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from barline.sources.market import Market

QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
ORACLES: dict[str, tuple[str, str]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def compose(needs: str, body: str) -> str:
    """``body`` below the named common table expressions and all that they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    parts = []
    for n in order:
        text = CTES[n][1].strip()
        head = n if not text.startswith("#cols") else n + text.split("\n", 1)[0][5:].strip()
        text = text.split("\n", 1)[1] if text.startswith("#cols") else text
        parts.append(f"{head} AS (\n{text}\n)")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def query(name: str, needs: str = "", sql: str | None = None):
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (needs, sql)
        return fn

    return deco


def q(x: str, digits: int = 4) -> str:
    """SQL text of ``functions.numeric.report``."""
    return f"floor(({x}) * 1e{digits} + 0.500001) / 1e{digits}"


def he(x: str, digits: int = 0) -> str:
    """SQL text of ``functions.numeric.half_even``."""
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"
