"""Algorithms behind ``<~``: inputs resolved to DataFrames, options to values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrel.plans import ast as A
from spindrel.plans.expressions import Scope

_MISSING = object()


class Input:
    """A relation handed to an algorithm: its rows, and the names given to its columns."""

    def __init__(self, df: DataFrame, bindings: dict[str, str]):
        self.df, self.bindings = df, bindings

    def column(self, i: int) -> Column:
        return F.col(f"`{self.df.columns[i]}`")

    def edges(self, undirected: bool = False, negative: bool = False) -> DataFrame:
        """src, dst, weight (1 unless there is a third column)."""
        if len(self.df.columns) < 2:
            raise A.ScriptError("a graph needs two columns")
        weight = self.column(2).cast("double") if len(self.df.columns) > 2 else F.lit(1.0)
        bad = F.isnan(weight) | (F.abs(weight) == float("inf")) | weight.isNull()
        if not negative:
            bad = bad | (weight < 0)
        if len(self.df.columns) > 2:
            weight = F.when(bad, F.raise_error(F.lit("edge weights must be finite numbers, not below 0")).cast("double")).otherwise(weight)
        out = self.df.select(self.column(0).alias("src"), self.column(1).alias("dst"), weight.alias("weight"))
        return out.union(out.select("dst", "src", "weight")) if undirected else out

    def nodes(self) -> DataFrame:
        return self.df.select(self.column(0).alias("node"))

    def scope(self) -> Scope:
        return Scope(self.df, {**{c: c for c in self.df.columns}, **self.bindings})


class Context:
    """What an algorithm runs on."""

    def __init__(self, evaluator: Any, rule: A.FixedRule):
        self.evaluator, self.spark = evaluator, evaluator.spark
        self.name = rule.algorithm
        self.inputs = [resolved(evaluator, i) for i in rule.inputs]
        self.options = dict(rule.options)
        self.head = rule.head

    def input(self, i: int) -> Input:
        if i >= len(self.inputs):
            raise A.ScriptError(f"{self.name} needs {i + 1} relations")
        return self.inputs[i]

    def has(self, i: int) -> bool:
        return i < len(self.inputs)

    def option(self, name: str, default: Any = _MISSING) -> Any:
        from spindrel.plans.parser import fold

        if name not in self.options:
            if default is _MISSING:
                raise A.ScriptError(f"{self.name} needs the option {name}")
            return default
        return fold(self.options[name])

    def expression(self, name: str) -> Any:
        return self.options.get(name)

    def edges(self, negative: bool = False) -> DataFrame:
        return self.input(0).edges(bool(self.option("undirected", False)), negative)


def resolved(evaluator: Any, i: A.FixedInput) -> Input:
    if i.stored:
        atom = A.StoredAtom(i.name, None, (), i.at)
        df = evaluator.source(atom, None)[0]
        if i.named:
            df = df.select(*[F.col(f"`{c}`") for c, _ in i.bindings])
            return Input(df, {v: c for c, v in i.bindings})
    else:
        df = evaluator.results.get(i.name, evaluator.total.get(i.name))
        if df is None:
            raise A.ScriptError(f"rule {i.name} is not defined")
    if len(i.bindings) > len(df.columns):
        raise A.ScriptError(f"{i.name} has only {len(df.columns)} columns")
    return Input(df, {v: c for v, c in zip(i.bindings, df.columns, strict=False)})


Algorithm = Callable[[Context], DataFrame]
BUILTIN: dict[str, Algorithm] = {}


def algorithm(*names: str):
    def add(run: Algorithm) -> Algorithm:
        for n in names:
            BUILTIN[n] = run
        return run

    return add


def run_fixed(evaluator: Any, rule: A.FixedRule) -> DataFrame:
    """The rows of an algorithm, columns by position."""
    from spindrel.operators import graph, ranking, traversal  # noqa: F401  they register themselves

    context = Context(evaluator, rule)
    own = evaluator.session.fixed_rules.get(rule.algorithm)
    if own is not None:
        out = own([i.df for i in context.inputs], {k: context.option(k) for k in context.options})
    elif rule.algorithm in BUILTIN:
        out = BUILTIN[rule.algorithm](context)
    else:
        raise A.ScriptError(f"no algorithm {rule.algorithm}")
    if rule.head and len(rule.head) != len(out.columns):
        raise A.ScriptError(f"{rule.algorithm} yields {len(out.columns)} columns, not {len(rule.head)}")
    evaluator.session.last_fixed_columns = out.columns
    return out.toDF(*[f"_{i}" for i in range(len(out.columns))])
