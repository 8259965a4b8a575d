"""Evaluate an expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a higher-order function is computed again for every element. Bound as a
    lambda variable it is a plain reference there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
