"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {}
