"""DuckDB statements that compute the registered queries independently of Spark."""

from __future__ import annotations

import re

from oracle import data, orders, performance, reports, research, storage

VIEWS = {**data.VIEWS, **research.VIEWS, **reports.VIEWS, **performance.VIEWS, **orders.VIEWS,
         **storage.VIEWS}
QUERIES = {
    **data.QUERIES, **research.QUERIES, **reports.QUERIES, **performance.QUERIES, **orders.QUERIES,
    **storage.QUERIES,
}


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\bv_\w+", sql)) if n in VIEWS]


def _collect(sql: str, done: dict[str, str]) -> None:
    for name in _needs(sql):
        if name not in done:
            _collect(VIEWS[name], done)
            done[name] = VIEWS[name]


def _rounded(name: str, digits: int) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"round_even({name}::DOUBLE * {scale}, 0) / {scale} + 0.0::DOUBLE AS {name}"


def statement(sql: str, plain: list[str], measures: dict[str, int]) -> str:
    """The query with the views it needs, its measures rounded like the registered query's."""
    views: dict[str, str] = {}
    _collect(sql, views)
    head = ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in views.items())
    columns = [f'"{c}"' for c in plain] + [_rounded(c, d) for c, d in measures.items()]
    prefix = f"WITH {head}\n" if head else ""
    return f"{prefix}SELECT {', '.join(columns)} FROM ({sql}) AS result"
