"""Values of constant expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def evaluate(expression: Any) -> Any:
    """The value of an expression without variables, computed by Spark itself."""
    from spindrel.plans.expressions import Scope

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    one = spark.range(1)
    value = one.select(Scope(one, {}).compile(expression).col.alias("x")).first()["x"]
    return bytes(value) if isinstance(value, bytearray) else value
