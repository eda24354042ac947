"""Naming an intermediate value inside one expression.

The optimizer copies an expression to every place that refers to it when it moves
filters and merges projections. A regex match or a JSON parse is too dear for
that; bound here, it is written down once and evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_if(value: Column, holds: Callable[[Column], Column]) -> Column:
    """Array with the value if the condition holds for it, else empty."""
    return F.filter(F.array(value), holds)
