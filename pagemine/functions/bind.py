"""Evaluate shared values once instead of once per array element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer may copy a projected expression into its only reference; inside a
    lambda that reference runs once per array element. It never copies an expression
    that depends on the partition id, so the values are guarded by a condition on it
    that always holds.
    """
    always = F.spark_partition_id() >= 0
    return df.withColumns({name: F.when(always, value) for name, value in columns.items()})


def let(value: Column | dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value evaluated once, also where the body uses it in lambdas.

    The value becomes the only element of an array, so the body sees a lambda variable.
    """
    if isinstance(value, dict):
        value = F.struct(*[part.alias(name) for name, part in value.items()])
    return F.get(F.transform(F.array(value), body), F.lit(0))
