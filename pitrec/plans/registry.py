"""Named queries over the provided tables, with SQL twins."""

from __future__ import annotations

from . import early, late, more, runs
from .late import flagship  # noqa: F401


def queries() -> dict:
    return early.Q.queries | late.Q.queries | more.Q.queries | runs.Q.queries


def oracle_sql() -> dict:
    return early.Q.sql | late.Q.sql | more.Q.sql | runs.Q.sql
