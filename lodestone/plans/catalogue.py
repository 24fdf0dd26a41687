"""Every registered query of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from lodestone.plans import base, clusters, lifecycle, relational, retrieval, scalars  # noqa: F401  registers


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
