"""The aggregates of rule heads, with their values over no rows, and the lattice merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.functions.scalars import Typed
from spindrel.plans.ast import ScriptError

#: Aggregates that may be computed in recursion: merging more rows in never undoes anything.
MEET = {"and", "or", "union", "intersection", "min", "max", "min_cost", "shortest", "choice", "bit_and", "bit_or"}


def part(pair: Typed, i: int) -> Column:
    """Element i of a pair, which is a list or a tuple."""
    if isinstance(pair.type, T.StructType):
        return pair.col[pair.type.fieldNames()[i]]
    return F.get(pair.col, F.lit(i))


def known(name: str, a: Typed) -> Column:
    """Numbers only, and an error for a null among them."""
    if not a.num:
        raise ScriptError(f"{name} takes numbers")
    return F.when(a.col.isNotNull(), a.col.cast("double")).otherwise(F.raise_error(F.lit(f"{name} of null")).cast("double"))


def _boxed(a: Typed) -> Column:
    """Nulls are values: wrapped, so that Spark's collectors keep them."""
    return F.struct(a.col.alias("v"))


def _unbox(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: b["v"])


@lru_cache
def _bits(name: str):
    op = {"bit_and": np.bitwise_and, "bit_or": np.bitwise_or, "bit_xor": np.bitwise_xor}[name]

    def run(s: pd.Series) -> bytes:
        out = None
        for x in s:
            if x is not None:
                a = np.frombuffer(x, np.uint8)
                if out is not None and len(a) != len(out):
                    raise ValueError("bytes of different lengths")
                out = a if out is None else op(out, a)
        return b"" if out is None else out.tobytes()

    run.__annotations__ = {"s": pd.Series, "return": bytes}
    return F.pandas_udf(run, T.BinaryType())


def _boolean(name: str, a: Typed) -> Column:
    if not a.bool and not a.null:
        raise ScriptError(f"{name} takes truth values")
    return a.col.cast("boolean")


def _list(name: str, a: Typed) -> Column:
    if not a.list:
        raise ScriptError(f"{name} takes lists")
    return a.col


def _intersection(a: Typed) -> Column:
    lists = F.collect_set(_list("intersection", a))  # equal lists are merged before the shuffle
    rest = F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0)))
    return F.sort_array(F.coalesce(F.aggregate(rest, F.array_distinct(F.get(lists, F.lit(0))), F.array_intersect), F.array().cast(a.type)))


def _collect(a: Typed, limit: Typed | None = None) -> Column:
    out = _unbox(F.sort_array(F.collect_list(_boxed(a))))
    return F.slice(out, 1, int(limit.constant)) if limit is not None else out


def _numbers(name: str, f: Callable[[Column], Column]) -> Callable[[Typed], Column]:
    def run(a: Typed) -> Column:
        if not a.num and not a.null:
            raise ScriptError(f"{name} takes numbers")
        return f(a.col)

    return run


BUILDERS: dict[str, Callable[..., Column]] = {
    "and": lambda a: F.coalesce(F.bool_and(_boolean("and", a)), F.lit(True)),
    "or": lambda a: F.coalesce(F.bool_or(_boolean("or", a)), F.lit(False)),
    "unique": lambda a: _unbox(F.sort_array(F.collect_set(_boxed(a)))),
    "count_unique": lambda a: F.count_distinct(_boxed(a)),
    "union": lambda a: F.sort_array(F.array_distinct(F.flatten(F.collect_set(_list("union", a))))),
    "intersection": _intersection,
    "collect": _collect,
    "choice_rand": lambda a: F.max_by(a.col, F.col("_rand")),
    "count": lambda a: F.count(F.lit(1)),
    "variance": lambda a: F.coalesce(F.var_samp(known("variance", a)), F.lit(float("nan"))),
    "std_dev": lambda a: F.coalesce(F.stddev_samp(known("std_dev", a)), F.lit(float("nan"))),
    "mean": lambda a: F.coalesce(F.avg(known("mean", a)), F.lit(float("nan"))),
    "sum": lambda a: F.coalesce(F.sum(known("sum", a)), F.lit(0.0)),
    "product": lambda a: F.coalesce(F.product(known("product", a)), F.lit(1.0)),
    "min": _numbers("min", F.min),
    "max": _numbers("max", F.max),
    "latest_by": lambda a: F.max_by(part(a, 0), F.when(part(a, 1).isNotNull(), F.struct(part(a, 1), part(a, 0)))),
    "smallest_by": lambda a: F.min_by(part(a, 0), F.when(part(a, 1).isNotNull(), F.struct(part(a, 1), part(a, 0)))),
    "min_cost": lambda a: F.min_by(a.col, F.when(part(a, 1).isNotNull(), F.struct(part(a, 1), part(a, 0)))),
    "shortest": lambda a: F.min_by(a.col, F.when(a.col.isNotNull(), F.struct(F.size(_list("shortest", a)), a.col))),
    "choice": lambda a: F.min(a.col),
    "bit_and": lambda a: _bits("bit_and")(a.col),
    "bit_or": lambda a: _bits("bit_or")(a.col),
    "bit_xor": lambda a: _bits("bit_xor")(a.col),
}
NAMES = {*BUILDERS, "group_count"}


def build(name: str, a: Typed, extra: list[Typed]) -> Column:
    if name not in BUILDERS:
        raise ScriptError(f"no aggregate {name}")
    return BUILDERS[name](a, *extra)
