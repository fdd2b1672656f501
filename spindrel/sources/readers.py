"""Constant rows, CSV and JSON sources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.plans import ast as A
from spindrel.sources.durable import written


def kind_of(value: Any) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, bytes | bytearray):
        return T.BinaryType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list | tuple):
        inner = common([kind_of(v) for v in value])
        if isinstance(inner, T.StructType) and inner.fieldNames() == ["?"]:  # really mixed: a tuple
            return T.StructType([T.StructField(f"_{i}", kind_of(v)) for i, v in enumerate(value)])
        return T.ArrayType(inner)
    if isinstance(value, T.Row):
        return T.StructType([T.StructField(k, kind_of(v)) for k, v in value.asDict().items()])
    raise A.ScriptError(f"{value!r} cannot be a value")


def common(kinds: list[T.DataType]) -> T.DataType:
    """One type for all; a struct with the field ``?`` if there is none."""
    out: T.DataType = T.NullType()
    for k in kinds:
        if isinstance(k, T.NullType) or k == out:
            continue
        if isinstance(out, T.NullType):
            out = k
        elif {type(out), type(k)} == {T.LongType, T.DoubleType}:
            out = T.DoubleType()
        elif isinstance(out, T.ArrayType) and isinstance(k, T.ArrayType):
            out = T.ArrayType(common([out.elementType, k.elementType]))
        else:
            return T.StructType([T.StructField("?", T.NullType())])
    return out


def fitted(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType) and isinstance(value, list | tuple):
        return tuple(fitted(v, f.dataType) for v, f in zip(value, kind, strict=True))
    return value


def constant_frame(spark: SparkSession, rows: Any, width: int | None) -> DataFrame:
    """Rows of a constant rule, columns by position."""
    from spindrel.plans.parser import fold

    values = fold(rows) if not isinstance(rows, list) else rows
    if not isinstance(values, list):
        raise A.ScriptError("a constant rule takes a list of rows")
    values = [r if isinstance(r, list) else [r] for r in values]
    if not values and width is None:
        raise A.ScriptError("a constant rule without rows needs a head")
    width = width if width is not None else len(values[0])
    if any(len(r) != width for r in values):
        raise A.ScriptError("rows of a constant rule differ from its head in length")
    kinds = [common([kind_of(r[i]) for r in values]) for i in range(width)]
    for k in kinds:
        if isinstance(k, T.StructType) and k.fieldNames() == ["?"]:
            raise A.ScriptError("a column of a constant rule mixes types")
    kinds = [T.StringType() if isinstance(k, T.NullType) else k for k in kinds]
    schema = T.StructType([T.StructField(f"_{i}", k) for i, k in enumerate(kinds)])
    return spark.createDataFrame([tuple(fitted(v, k) for v, k in zip(r, kinds, strict=True)) for r in values], schema)


#: Column types of scripts and of Spark.
PRIMITIVE = {
    "Bool": "boolean", "Int": "bigint", "Float": "double", "String": "string", "Bytes": "binary", "Uuid": "string", "Json": "string",
    "Any": "string", "Validity": "struct<ts:bigint,is_assert:boolean>",
}


def spark_type(kind: tuple | None) -> str | None:
    """DDL of a parsed column type; None where any type will do."""
    if kind is None or kind[0] == "Any":
        return None
    name, inner = kind[0], kind[1]
    if name == "List":
        return f"array<{spark_type(inner[0]) or 'string'}>"
    if name == "Tuple":
        return "struct<" + ",".join(f"_{i}:{spark_type(t) or 'string'}" for i, t in enumerate(inner)) + ">"
    if name == "Vec":
        return f"array<{'double' if inner[0] == 'F64' else 'float'}>"
    return PRIMITIVE[name]


def local_path(url: str) -> str:
    if url.startswith(("http://", "https://")):
        raise A.ScriptError("remote sources need a network; give a path that Spark can read")
    return url


def read_csv(spark: SparkSession, url: str, types: list[str], delimiter: str = ",", has_headers: bool = True, prepend_index: bool = False) -> DataFrame:
    """Typed columns by position; a bad cell is null where the type allows it, else an error."""
    from spindrel.plans.parser import Parser

    kinds = [Parser(t).type() for t in types]
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(kinds))])
    raw = spark.read.csv(local_path(url), schema=schema, sep=delimiter, header=has_headers, enforceSchema=True, mode="PERMISSIVE", multiLine=False)
    out = []
    for i, kind in enumerate(kinds):
        cell, ddl = F.col(f"_{i}"), spark_type(kind) or "string"
        value = cell.try_cast(ddl) if ddl != "string" else cell
        if not kind[2]:
            bad = F.raise_error(F.concat(F.lit(f"column {i} holds a value that is not {kind[0]}: "), F.coalesce(cell, F.lit("null")))).cast(ddl)
            value = F.coalesce(value, bad) if ddl != "string" else F.coalesce(cell, F.lit(""))
        out.append(value.alias(f"_{i}"))
    return indexed(raw.select(*out), prepend_index)


def read_json(
    spark: SparkSession, url: str, fields: list[str], json_lines: bool = True, null_if_absent: bool = False, prepend_index: bool = False
) -> DataFrame:
    raw = spark.read.json(local_path(url), multiLine=not json_lines)
    missing = [f for f in fields if f not in raw.columns]
    if missing and not null_if_absent:
        raise A.ScriptError(f"no field {', '.join(missing)} in {url}")
    out = []
    for i, f in enumerate(fields):
        value = F.lit(None).cast("string") if f in missing else F.col(f"`{f}`")
        if not null_if_absent:
            value = F.coalesce(value, F.raise_error(F.lit(f"field {f} is absent in a row")).cast(raw.schema[f].dataType))
        out.append(value.alias(f"_{i}"))
    return indexed(raw.select(*out), prepend_index)


def indexed(df: DataFrame, wanted: bool) -> DataFrame:
    """Row numbers from 0 in the order of ``df``, first column.

    Rows are written with their partition and place in it, which later reads keep; a
    partition's offset is then one row of a small table.
    """
    if not wanted:
        return df
    names = [f"_{i + 1}" for i in range(len(df.columns))]
    placed = df.toDF(*names).select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_n"), *names)
    rows, _ = written(placed)
    parts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_first"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_p", (before - F.col("_first")).alias("_shift"))
    return rows.join(offsets, "_p").select((F.col("_n") + F.col("_shift")).cast("long").alias("_0"), *names)
