"""Binding of intermediate values in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer inlines: a one-element array is mapped."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]
