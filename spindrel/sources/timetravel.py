"""Point-in-time reads of relations whose last key column is a validity."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.plans import ast as A

END_OF_TIME = (1 << 63) - 1


def moment(at: Any) -> int:
    """Microseconds of a validity specification: a number, NOW, END or RFC 3339 text."""
    from spindrel.plans.parser import fold

    value = fold(at)
    if isinstance(value, bool) or value is None:
        raise A.ScriptError("a validity is a time")
    if isinstance(value, int | float):
        return int(value)
    if value == "NOW":
        return int(datetime.datetime.now(datetime.UTC).timestamp() * 1e6)
    if value == "END":
        return END_OF_TIME
    try:
        return micros(value.removeprefix("~"))
    except ValueError as e:
        raise A.ScriptError(f"{value!r} is not a time") from e


def micros(text: str) -> int:
    when = datetime.datetime.fromisoformat(text)
    when = when if when.tzinfo else when.replace(tzinfo=datetime.UTC)
    return round((when - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) / datetime.timedelta(microseconds=1))


def as_of(df: DataFrame, relation: Any, at: Any) -> DataFrame:
    """Per key the newest version at or before the time, unless it is a retraction.

    ``max_by`` aggregates before the shuffle, so only one version per key and task moves.
    """
    *keys, validity = relation.key_columns
    if not relation.is_versioned:
        raise A.ScriptError(f"{relation.name} has no validity to travel by")
    past = df.where(F.col(validity)["ts"] <= F.lit(moment(at)))
    order = F.struct(F.col(validity)["ts"], F.col(validity)["is_assert"])
    rest = [c for c in df.columns if c not in keys]
    newest = past.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return newest.where(F.col("_v")[validity]["is_assert"]).select(*[c if c in keys else F.col("_v")[c].alias(c) for c in df.columns])
