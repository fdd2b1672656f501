"""The public entry point: a session runs scripts over its relations."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.scalars import add_function, drop_function
from spindrel.plans import ast as A
from spindrel.plans.analyze import ENTRY, definitions
from spindrel.plans.compile import Evaluator, headers, order_column
from spindrel.plans.parser import Parser
from spindrel.sources.catalog import Callback, Catalog, Change, Writer, decoded, encoded, with_entries
from spindrel.sources.durable import written


class Session:
    """Relations, algorithms and callbacks, and the scripts that use them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalog = Catalog(spark)
        self.fixed_rules: dict[str, Callable] = {}
        self.callbacks: dict[int, tuple[str, Callback]] = {}
        self.running: dict[str, tuple[str, float]] = {}
        self._pending: list[Change] = []

    # --- relations -----------------------------------------------------------------

    def register(self, name: str, df: DataFrame, keys: list[str] | None = None, check: bool = False) -> Session:
        """Make a DataFrame a relation.  Keys are believed, as checking them reads all rows, unless ``check``."""
        if check and keys and not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise A.ScriptError(f"{name} holds several rows of one key")
        self.catalog.register(name, df, keys)
        return self

    def export_relations(self, names: list[str]) -> dict[str, DataFrame]:
        return {n: self.catalog.readable(n).frame() for n in names}

    def import_relations(self, data: dict[str, DataFrame]) -> None:
        """Put rows by relation; a name after ``-`` removes by key.  Triggers do not run."""
        with self.transaction():
            for name, rows in data.items():
                op = "rm" if name.startswith("-") else "put"
                Writer(self.catalog, A.Store(op, name.lstrip("-"), None), rows).run()

    def backup(self, path: str) -> None:
        """Every relation, with its types, defaults, indices, triggers and access level, in one folder."""
        specs = []
        for name, r in self.catalog.relations.items():
            r.frame().write.mode("overwrite").parquet(f"{path}/{name}")
            specs.append((name, encoded(replace(r, data=None, stored=(), layers=0))))
        self.spark.createDataFrame(specs, "name string, spec string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_spindrel_index")

    def restore(self, path: str, names: list[str] | None = None) -> None:
        """Relations of a backup as they were; ``names`` restores only some."""
        for row in self.spark.read.parquet(f"{path}/_spindrel_index").collect():
            if names is None or row["name"] in names:
                data, _ = written(self.spark.read.parquet(f"{path}/{row['name']}"))
                self.catalog.relations[row["name"]] = with_entries(replace(decoded(row["spec"]), data=data))

    # --- extension -----------------------------------------------------------------

    def register_fixed_rule(self, name: str, run: Callable) -> None:
        """``run(inputs: list[DataFrame], options: dict) -> DataFrame`` as an algorithm."""
        from spindrel.operators.fixed import BUILTIN

        if name in BUILTIN or name in self.fixed_rules:
            raise A.ScriptError(f"algorithm {name} exists already")
        self.fixed_rules[name] = run

    def unregister_fixed_rule(self, name: str) -> bool:
        return self.fixed_rules.pop(name, None) is not None

    def register_function(self, name: str, arity: int, build: Callable[..., Column]) -> None:
        """``build(*columns) -> Column`` as a scalar function: Spark expressions, or a (pandas) UDF that it calls."""
        add_function(name, arity, build)

    def unregister_function(self, name: str) -> bool:
        return drop_function(name)

    def register_callback(self, relation: str, call: Callback) -> int:
        """``call(op, new, old)`` after each committed put or rm of a relation."""
        number = max(self.callbacks, default=0) + 1
        self.callbacks[number] = (relation, call)
        return number

    def unregister_callback(self, number: int) -> bool:
        return self.callbacks.pop(number, None) is not None

    # --- transactions --------------------------------------------------------------

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Session]:
        """All changes inside are kept together or not at all; callbacks run after the outermost."""
        before, outer = dict(self.catalog.relations), self._pending
        self._pending = []
        try:
            yield self
        except BaseException:
            self.catalog.relations = before
            self._pending = outer
            raise
        done, self._pending = self._pending, outer
        if getattr(self, "_depth", 0):
            outer.extend(done)
            return
        for change in done:
            for relation, call in list(self.callbacks.values()):
                if relation == change.relation:
                    call("rm" if change.kind == "rm" else "put", change.new, change.old)

    @contextlib.contextmanager
    def nested(self) -> Iterator[None]:
        self._depth = getattr(self, "_depth", 0) + 1
        try:
            yield
        finally:
            self._depth -= 1

    # --- scripts -------------------------------------------------------------------

    def run(self, script: str, params: dict[str, Any] | None = None, immutable: bool = False) -> DataFrame:
        """The result of a script: rows, a listing, or the status of a change."""
        parsed = Parser(script, params).script()
        if isinstance(parsed, A.SysOp):
            from spindrel.sysops import run_sysop

            return run_sysop(self, parsed, immutable)
        if isinstance(parsed, tuple):
            from spindrel.imperative import Interpreter

            with self.transaction(), self.nested():
                out = Interpreter(self, immutable).run(parsed)
            self._flush()
            return out
        with self.transaction():
            out = self.program(parsed, {}, immutable)
        return out

    def _flush(self) -> None:
        done, self._pending = self._pending, []
        for change in done:
            for relation, call in list(self.callbacks.values()):
                if relation == change.relation:
                    call("rm" if change.kind == "rm" else "put", change.new, change.old)

    def evaluate(self, program: A.Program, temporary: dict[str, DataFrame]) -> DataFrame:
        """Rows of a program's entry rule with its headers, before options."""
        rules = definitions(program)
        if program.options.magic:
            from spindrel.plans.magic import specialised

            rules = specialised(rules)
        df = Evaluator(self, rules, temporary).run()
        return df.toDF(*unique(headers(rules[ENTRY], df)))

    def program(self, program: A.Program, temporary: dict[str, DataFrame], immutable: bool = False) -> DataFrame:
        o = program.options
        if o.sleep:
            time.sleep(o.sleep)
        if o.store and immutable and not o.store.name.startswith("_"):
            raise A.ScriptError("an immutable script cannot change relations")
        if not program.rules and o.store and o.store.op == "create":
            schema = o.store.schema
            df = self.empty(schema)
        else:
            with self.watched(o.timeout):
                df = self.evaluate(program, temporary)
        if o.assertion == "none" and not df.isEmpty():
            raise A.ScriptError("the query should have no rows, but has some")
        if o.assertion == "some" and df.isEmpty():
            raise A.ScriptError("the query should have rows, but has none")
        if o.order:
            for name, _ in o.order:
                if name not in df.columns:
                    raise A.ScriptError(f"sort key {name} is not in the head of the entry rule")
            df = df.orderBy(*[order_column(n, down) for n, down in o.order])
        if o.offset:
            df = df.offset(o.offset)
        if o.limit is not None:
            df = df.limit(o.limit)
        if o.store:
            return self.store(o.store, df, o.returning, temporary)
        return df

    def empty(self, schema: A.Schema | None) -> DataFrame:
        from spindrel.sources.readers import spark_type

        columns = [*schema.keys, *schema.values] if schema else []
        return self.spark.createDataFrame([], ", ".join(f"`{c.name}` {spark_type(c.type) or 'string'}" for c in columns))

    @contextlib.contextmanager
    def watched(self, timeout: float | None) -> Iterator[None]:
        """Spark jobs under a group of their own, cancelled after ``timeout`` seconds."""
        group = uuid.uuid4().hex
        self.running[group] = ("query", time.time())
        timer = None
        if timeout:
            self.spark.sparkContext.setJobGroup(group, "spindrel", True)
            timer = threading.Timer(timeout, lambda: self.spark.sparkContext.cancelJobGroup(group))
            timer.start()
        try:
            yield
        finally:
            self.running.pop(group, None)
            if timer:
                timer.cancel()

    def store(self, store: A.Store, rows: DataFrame, returning: bool, temporary: dict[str, DataFrame]) -> DataFrame:
        if store.name.startswith("_"):
            temporary[store.name] = written(rows)[0]
            return self.status("OK")
        change = Writer(self.catalog, store, rows).run()
        if change is None:
            return self.status("OK")
        self._pending.append(change)
        self.trigger(change)
        if not returning:
            return self.status("OK")
        if change.kind == "rm":
            parts = [("requested", change.new), ("deleted", change.old)]
        else:
            parts = [("inserted", change.new), ("replaced", change.old)]
        out = None
        for kind, df in parts:
            one = df.select(F.lit(kind).alias("_kind"), "*")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def trigger(self, change: Change) -> None:
        relation = self.catalog.relations[change.relation]
        for event, text in relation.triggers:
            if event == change.kind:
                inner = Parser(text).program()
                with self.transaction(), self.nested():
                    self.program(inner, {"_new": change.new, "_old": change.old, "*_new": change.new})

    def status(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    # --- expressions ---------------------------------------------------------------

    def evaluate_expression(self, text: str, params: dict[str, Any] | None = None) -> Any:
        """The value of an expression without variables."""
        from spindrel.plans.parser import fold

        return fold(Parser(text, params).expr())

    def free_variables(self, text: str) -> set[str]:
        return A.variables(Parser(text).expr())

    def explain(self, script: str, params: dict[str, Any] | None = None) -> str:
        """Spark's plan of a query."""
        df = self.run(script, params, True)
        return df._jdf.queryExecution().toString()

    def _set(self, name: str, **changes: Any) -> None:
        self.catalog.relations[name] = replace(self.catalog.relations[name], **changes)


def unique(names: list[str]) -> list[str]:
    """Column names with repeats numbered."""
    out: list[str] = []
    for n in names:
        k, name = 1, n
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out
