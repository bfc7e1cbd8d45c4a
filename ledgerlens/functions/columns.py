"""Helpers for expressions over nested columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often `use` reads it; within lambdas nothing else sees to that."""
    return F.get(F.transform(F.array(x), use), 0)
