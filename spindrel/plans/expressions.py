"""Expressions to typed Spark columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.functions import scalars as S
from spindrel.plans import ast as A

JSON_FLAG = "spindrel.json"


def flagged(field: T.StructField) -> bool:
    return bool((field.metadata or {}).get(JSON_FLAG))


class Scope:
    """Variables bound to columns of a DataFrame."""

    def __init__(self, df: DataFrame, columns: dict[str, str]):
        self.df, self.columns = df, columns

    def type_of(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("_")).schema[0].dataType

    def typed(self, column: Column, json: bool = False, constant: Any = None) -> S.Typed:
        return S.Typed(column, self.type_of(column), json, constant)

    def compile(self, e: Any) -> S.Typed:
        if isinstance(e, A.Lit):
            return self.literal(e.value)
        if isinstance(e, A.Var):
            if e.name not in self.columns:
                raise A.ScriptError(f"variable {e.name} is not bound")
            field = self.df.schema[self.columns[e.name]]
            return S.Typed(F.col(f"`{field.name}`"), field.dataType, flagged(field))
        if isinstance(e, A.ListOf):
            return self.result(S.build("list", [self.compile(x) for x in e.items]))
        if isinstance(e, A.ObjectOf):
            return self.result(S.build("json_object", [self.compile(x) for pair in e.pairs for x in pair]))
        return self.result(S.build(e.name, [self.compile(x) for x in e.args]))

    def literal(self, value: Any) -> S.Typed:
        if value is None:
            return S.Typed(F.lit(None), T.NullType())
        if isinstance(value, bool):
            return S.Typed(F.lit(value), T.BooleanType(), constant=value)
        if isinstance(value, int):
            return S.Typed(F.lit(value).cast("long"), T.LongType(), constant=value)
        if isinstance(value, float):
            return S.Typed(F.lit(value), T.DoubleType(), constant=value)
        if isinstance(value, bytes | bytearray):
            return S.Typed(F.lit(bytes(value)), T.BinaryType(), constant=value)
        if isinstance(value, str):
            return S.Typed(F.lit(value), T.StringType(), constant=value)
        raise A.ScriptError(f"{value!r} cannot be a literal")

    def result(self, made: Column | S.Json) -> S.Typed:
        return self.typed(made.col, True) if isinstance(made, S.Json) else self.typed(made)

    def column(self, e: Any, name: str) -> Column:
        made = self.compile(e)
        return made.col.alias(name, metadata={JSON_FLAG: True}) if made.json else made.col.alias(name)

    def test(self, e: Any) -> Column:
        made = self.compile(e)
        if not made.bool and not made.null:
            raise A.ScriptError("a condition must be true or false")
        return made.col
