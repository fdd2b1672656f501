"""Utility algorithms: ranked output, constants and file readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.operators.fixed import Context, algorithm
from spindrel.plans import ast as A
from spindrel.sources.readers import constant_frame, indexed, read_csv, read_json


@algorithm("ReorderSort")
def reorder_sort(c: Context) -> DataFrame:
    """Rank (rows that tie share one unless ``break_ties``), then the ``out`` expressions."""
    source = c.input(0)
    scope = source.scope()
    wanted = c.expression("out")
    if not isinstance(wanted, A.ListOf):
        raise A.ScriptError("ReorderSort needs the option out, a list")
    by = c.expression("sort_by")
    keys = list(by.items) if isinstance(by, A.ListOf) else [by] if by is not None else []
    down = c.option("descending", False)
    columns = [scope.compile(e).col.alias(f"o{i}") for i, e in enumerate(wanted.items)]
    sorts = [scope.compile(k).col.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = source.df.select(*columns, *sorts)
    order = [F.col(f"k{i}").desc_nulls_last() if down else F.col(f"k{i}").asc_nulls_first() for i in range(len(keys))]
    ties = [F.col(f"o{i}") for i in range(len(columns))]
    skip, take = int(c.option("skip", 0)), int(c.option("take", 0))
    # the sorted rows numbered in all partitions at once; rows that tie then take the least number among them
    kept = [c for c, _ in zip(rows.columns, [*columns, *sorts], strict=True)]
    numbered = indexed(rows.orderBy(*order, *ties), True).toDF("_at", *kept)
    place = F.col("_at") + 1
    if c.option("break_ties", False):
        out = numbered.select(place.alias("rank"), *ties, place.alias("_place"))
    else:
        same = [f"k{i}" for i in range(len(order))] or [f"o{i}" for i in range(len(columns))]
        first = numbered.groupBy(*same).agg(F.min("_at").alias("_first")).select(*[F.col(k).alias(f"r{k}") for k in same], "_first")
        condition = F.lit(True)
        for i, k in enumerate(same):
            equal = F.col(k).eqNullSafe(F.col(f"r{k}"))
            condition = equal if not i else condition & equal
        out = numbered.join(first, condition).select((F.col("_first") + 1).alias("rank"), *ties, place.alias("_place"))
    if skip:
        out = out.where(F.col("_place") > skip)
    if take:
        out = out.where(F.col("_place") <= skip + take)
    return out.drop("_place")


@algorithm("Constant")
def constant(c: Context) -> DataFrame:
    return constant_frame(c.spark, c.expression("data"), len(c.head) or None)


@algorithm("CsvReader")
def csv_reader(c: Context) -> DataFrame:
    return read_csv(c.spark, c.option("url"), c.option("types"), c.option("delimiter", ","), c.option("has_headers", True), c.option("prepend_index", False))


@algorithm("JsonReader")
def json_reader(c: Context) -> DataFrame:
    return read_json(c.spark, c.option("url"), c.option("fields"), c.option("json_lines", True), c.option("null_if_absent", False), c.option("prepend_index", False))
