"""All registered queries outside the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import operators  # noqa: F401  registers the relations
from ..operators import sampling
from ..sources import queries as sources
from ..streaming import states
from . import registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.queries() | {"stratified_sample": sampling.stratified_sample} | sources.QUERIES | states.QUERIES


def oracles() -> dict[str, str]:
    return registry.oracles() | sampling.checks() | sources.CHECKS | states.CHECKS
