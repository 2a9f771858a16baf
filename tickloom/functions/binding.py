"""Local values inside column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bind(x: Column, f) -> Column:
    """Evaluate ``x`` once and use it several times inside a higher-order function."""
    return F.element_at(F.transform(F.array(x), f), 1)
