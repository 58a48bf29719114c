"""Expressions that any part of the library may use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once: a lambda's argument is bound, where a column named twice
    inside a lambda or a CASE would be evaluated for every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)
