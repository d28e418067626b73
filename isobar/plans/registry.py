"""Registered queries by name, each a callable on (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _load() -> None:
    from . import fields, globes, grids, records, regrids, scalars, shapes  # noqa: F401
    from . import checks  # noqa: F401, I001  # last: its SQL takes the place of the functions' own text


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return SQL
