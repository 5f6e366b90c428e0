"""All registered queries."""

from __future__ import annotations

from codeloom.catalog.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from codeloom.catalog import corpus, evaluation, streams, structure  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
