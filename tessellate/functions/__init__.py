"""Expressions as text for either engine; ``column`` makes a Spark Column of one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dialect import SPARK


def column(build: Callable[..., str], *args) -> Column:
    """column(urls.section, "path"): the expression over a column or SQL text, for select() and filter()."""
    return F.expr(build(SPARK, *args))
