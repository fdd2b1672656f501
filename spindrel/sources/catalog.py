"""Stored relations: schemas with keys, snapshots as Parquet, keyed mutations."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.plans import ast as A
from spindrel.plans.expressions import JSON_FLAG, Scope
from spindrel.sources.durable import written
from spindrel.sources.readers import spark_type

LEVELS = ("hidden", "read_only", "protected", "normal")
#: Changes to a relation after which its rows are written whole again.
LAYERS = 8


@dataclass(frozen=True)
class Field:
    name: str
    kind: tuple | None = None
    default: Any = None

    @property
    def nullable(self) -> bool:
        return self.kind is None or self.kind[2]


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    options: tuple = ()


@dataclass(frozen=True)
class Relation:
    name: str
    keys: tuple[Field, ...]
    values: tuple[Field, ...]
    data: DataFrame
    access: str = "normal"
    indices: tuple[Index, ...] = ()
    triggers: tuple[tuple[str, str], ...] = ()
    description: str = ""
    own: bool = False  # made here, so all its changes are known
    layers: int = 0  # changes since the rows were last written whole
    stored: tuple[tuple[str, DataFrame], ...] = ()  # durable entries of search indices, by index name

    @property
    def columns(self) -> list[str]:
        return [f.name for f in (*self.keys, *self.values)]

    @property
    def key_columns(self) -> list[str]:
        return [f.name for f in self.keys]

    @property
    def is_versioned(self) -> bool:
        return bool(self.keys) and self.data.schema[self.keys[-1].name].dataType.simpleString() == "struct<ts:bigint,is_assert:boolean>"

    def frame(self) -> DataFrame:
        return self.data


@dataclass
class Change:
    """What a mutation did: rows put or removed, and the rows they replaced."""

    relation: str
    kind: str
    new: DataFrame
    old: DataFrame


@dataclass
class Catalog:
    spark: SparkSession
    relations: dict[str, Relation] = field(default_factory=dict)

    def get(self, name: str) -> Relation:
        if name not in self.relations:
            raise A.ScriptError(f"no relation {name}")
        return self.relations[name]

    def readable(self, name: str) -> Relation:
        base, _, index = name.partition(":")
        found = self.get(base)
        if found.access == "hidden":
            raise A.ScriptError(f"{base} is hidden")
        if not index:
            return found
        for i in found.indices:
            if i.name == index:
                return index_relation(found, i)
        raise A.ScriptError(f"{base} has no index {index}")

    def writable(self, name: str, level: str = "protected") -> Relation:
        found = self.get(name)
        if LEVELS.index(found.access) < LEVELS.index(level):
            raise A.ScriptError(f"{name} is {found.access.replace('_', ' ')}")
        return found

    def register(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """Make a DataFrame a relation; ``keys`` are columns known to be unique together."""
        keys = keys or []
        self.relations[name] = Relation(
            name, tuple(Field(k) for k in keys), tuple(Field(c) for c in df.columns if c not in keys), df.select(*keys, *[c for c in df.columns if c not in keys])
        )


#: What a relation's definition is made of, besides plain values.
PARTS = {c.__name__: c for c in (Relation, Field, Index, *(c for c in vars(A).values() if isinstance(c, type) and is_dataclass(c)))}


def encoded(value: Any) -> str:
    """A definition as JSON text: objects by class and fields, tuples apart from lists."""

    def plain(x: Any) -> Any:
        if is_dataclass(x):
            return {"is": type(x).__name__, "of": [plain(getattr(x, f.name)) for f in fields(x)]}
        if isinstance(x, tuple):
            return {"is": "tuple", "of": [plain(v) for v in x]}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, bytes):
            return {"is": "bytes", "of": [x.hex()]}
        return x

    return json.dumps(plain(value))


def decoded(text: str) -> Any:
    def made(x: Any) -> Any:
        if isinstance(x, list):
            return [made(v) for v in x]
        if not isinstance(x, dict):
            return x
        if x["is"] == "bytes":
            return bytes.fromhex(x["of"][0])
        values = [made(v) for v in x["of"]]
        return tuple(values) if x["is"] == "tuple" else PARTS[x["is"]](*values)

    return made(json.loads(text))


def index_relation(relation: Relation, index: Index) -> Relation:
    """An index read as a relation."""
    if index.kind == "normal":
        columns = [*index.options, *[k for k in relation.key_columns if k not in index.options]]
        return Relation(f"{relation.name}:{index.name}", tuple(Field(c) for c in columns), (), relation.data.select(*columns))
    from spindrel.operators.search import index_frame

    df, keys = index_frame(relation, index)
    return Relation(f"{relation.name}:{index.name}", tuple(Field(k) for k in keys), tuple(Field(c) for c in df.columns if c not in keys), df)


def with_entries(relation: Relation) -> Relation:
    """The relation with the entries of its search indices stored, if its changes are known."""
    from spindrel.operators.search import entries_of, stored_entries

    if not relation.own:
        return relation
    held, stored = dict(relation.stored), []
    for i in relation.indices:
        made = held.get(i.name)
        if made is None:
            fresh = entries_of(relation, i, relation.frame())
            made = stored_entries(fresh, i) if fresh is not None else None
        if made is not None:
            stored.append((i.name, made))
    return replace(relation, stored=tuple(stored))


# --- writing ------------------------------------------------------------------------


def coerced(source: Column, kind: tuple | None, given: Any, name: str) -> Column:
    """A value as its column's type, or an error."""
    ddl = spark_type(kind)
    out = source
    if ddl is not None and given.simpleString() != ddl:
        if kind[0] == "Int" and given.simpleString() == "double":
            out = F.when(source == F.floor(source), source.cast("bigint")).when(source.isNotNull(), F.raise_error(F.lit(f"{name}: not an integer")).cast("bigint"))
        elif kind[0] == "Bytes" and given.simpleString() == "string":
            out = F.unbase64(source)
        elif kind[0] == "Validity":
            out = validity_of(source, given, name)
        elif kind[0] == "String" and given.simpleString() != "string" and given.simpleString() != "void":
            raise A.ScriptError(f"{name} takes a String, not {given.simpleString()}")
        elif kind[0] in ("Int", "Float", "Bool") and given.simpleString() == "string":
            raise A.ScriptError(f"{name} takes {kind[0]}, not a String")
        else:
            out = source.cast(ddl)
    if kind is not None and kind[0] == "List" and kind[1][1] is not None:
        n = int(kind[1][1])
        out = F.when(source.isNull() | (F.size(source) == n), out).otherwise(F.raise_error(F.lit(f"{name}: a list of {n} is needed")).cast(ddl))
    if kind is not None and kind[0] == "Vec":
        n = kind[1][1]
        out = F.when(source.isNull() | (F.size(source) == n), out).otherwise(F.raise_error(F.lit(f"{name}: a vector of {n} is needed")).cast(ddl))
    if kind is not None and not kind[2]:
        out = F.coalesce(out, F.raise_error(F.lit(f"{name} cannot be null")).cast(ddl or given))
    return out


def validity_of(source: Column, given: Any, name: str) -> Column:
    """ASSERT, RETRACT, RFC 3339 text (after ~ a retraction), or [micros, asserted]."""
    make = lambda ts, flag: F.struct(ts.cast("bigint").alias("ts"), flag.alias("is_assert"))
    if given.simpleString() == "string":
        now = F.unix_micros(F.current_timestamp())
        off = F.startswith(source, F.lit("~"))
        moment = F.unix_micros(F.to_timestamp(F.when(off, F.substr(source, F.lit(2))).otherwise(source)))
        return F.when(source == "ASSERT", make(now, F.lit(True))).when(source == "RETRACT", make(now, F.lit(False))).otherwise(make(moment, ~off))
    if given.simpleString().startswith("struct"):
        a, b = given.fieldNames()[:2]
        return make(source[a], source[b].cast("boolean"))
    raise A.ScriptError(f"{name} takes a validity")


def shaped(rows: DataFrame, fields: tuple[Field, ...], bindings: dict[str, str], optional: bool = False) -> DataFrame:
    """Rows as the columns of ``fields``; defaults fill what is missing."""
    out, scope = [], Scope(rows, {})
    for f in fields:
        source = bindings.get(f.name, f.name)
        if source in rows.columns:
            value = coerced(F.col(f"`{source}`"), f.kind, rows.schema[source].dataType, f.name)
        elif f.default is not None:
            made = scope.compile(f.default)
            value = coerced(made.col, f.kind, made.type, f.name)
        elif optional:
            continue
        elif f.nullable and f.kind is not None:
            value = F.lit(None).cast(spark_type(f.kind) or "string")
        else:
            raise A.ScriptError(f"column {f.name} is missing")
        json = f.kind is not None and f.kind[0] == "Json"
        out.append(value.alias(f.name, metadata={JSON_FLAG: True}) if json else value.alias(f.name))
    return rows.select(*out)


def on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    condition = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(f"`{k}`").eqNullSafe(F.col(f"`r_{k}`"))
        condition = same if i == 0 else condition & same
    return left.join(other, condition, how)


class Writer:
    """One mutation of one relation."""

    def __init__(self, catalog: Catalog, store: A.Store, rows: DataFrame):
        self.catalog, self.store, self.rows = catalog, store, rows
        schema = store.schema
        listed = [*schema.keys, *schema.values] if schema else []
        self.bindings = {c.name: c.binding for c in listed if c.binding}

    def fields(self) -> tuple[tuple[Field, ...], tuple[Field, ...]]:
        schema = self.store.schema
        if schema is None:
            return tuple(Field(c, None) for c in self.rows.columns), ()
        make = lambda cs: tuple(Field(c.name, c.type, c.default) for c in cs)
        return make(schema.keys), make(schema.values)

    def run(self) -> Change | None:
        return getattr(self, self.store.op)()

    def saved(self, relation: Relation, gone: DataFrame, new: DataFrame | None) -> None:
        """Take the keys of ``gone`` out and put ``new`` in, both durable already.

        The rows are written whole only every LAYERS changes; until then readers leave out
        what was changed since, which costs them a join with few keys.
        """
        keys = relation.key_columns
        df = on_keys(relation.data, gone, keys, "left_anti")
        df = df if new is None else df.unionByName(new)
        layers = relation.layers + 1
        if layers >= LAYERS:
            df, layers = written(df)[0], 0
        stored = tuple((n, self.maintained(relation, n, t, gone, new)) for n, t in relation.stored)
        self.catalog.relations[relation.name] = replace(relation, data=df, layers=layers, stored=stored)

    def maintained(self, relation: Relation, name: str, table: DataFrame, gone: DataFrame, new: DataFrame | None) -> DataFrame:
        from spindrel.operators.search import entries_of, stored_entries

        index = next(i for i in relation.indices if i.name == name)
        kept = on_keys(table, gone.select(*relation.key_columns), relation.key_columns, "left_anti")
        return stored_entries(kept if new is None else kept.unionByName(entries_of(relation, index, new)), index)

    def one_per_key(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Of rows of one key the one with the largest values, column by column."""
        if not keys:
            return rows.orderBy(*[F.col(f"`{c}`").desc() for c in rows.columns]).limit(1)
        rest = [c for c in rows.columns if c not in keys]
        if not rest:
            return rows.dropDuplicates()
        best = F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_best")
        whole = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
        made = {c: F.col("_best").getField(c).alias(c, metadata=rows.schema[c].metadata) for c in rest}
        return whole.select(*[made.get(c, F.col(f"`{c}`")) for c in rows.columns])

    # --- create and replace --------------------------------------------------------

    def create(self) -> Change:
        if self.store.name in self.catalog.relations:
            raise A.ScriptError(f"{self.store.name} exists already")
        return self.fresh(None)

    def replace(self) -> Change:
        old = self.catalog.relations.get(self.store.name)
        if old is not None:
            self.catalog.writable(old.name, "normal")
            if old.indices:
                raise A.ScriptError(f"{old.name} has indices and cannot be replaced")
        return self.fresh(old)

    def fresh(self, old: Relation | None) -> Change:
        keys, values = self.fields()
        rows = self.one_per_key(shaped(self.rows, (*keys, *values), self.bindings), [f.name for f in keys])
        data, _ = written(rows)
        relation = Relation(self.store.name, keys, values, data, triggers=old.triggers if old else (), own=True)
        self.catalog.relations[relation.name] = relation
        return Change(relation.name, "replace", data, old.data if old else data.limit(0))

    # --- put, insert, update -------------------------------------------------------

    def put(self) -> Change:
        relation = self.catalog.writable(self.store.name)
        new = written(self.one_per_key(shaped(self.rows, (*relation.keys, *relation.values), self.bindings), relation.key_columns))[0]
        old = written(on_keys(relation.data, new, relation.key_columns, "left_semi"))[0]
        self.saved(relation, new, new)
        return Change(relation.name, "put", new, old)

    def insert(self) -> Change:
        relation = self.catalog.writable(self.store.name)
        new = shaped(self.rows, relation.keys, self.bindings)
        if not on_keys(new, relation.data, relation.key_columns, "left_semi").isEmpty():
            raise A.ScriptError(f"{relation.name} holds a key already that was to be inserted")
        return self.put()

    def update(self) -> Change:
        relation = self.catalog.writable(self.store.name)
        given = [f for f in relation.values if self.bindings.get(f.name, f.name) in self.rows.columns]
        new = written(self.one_per_key(shaped(self.rows, (*relation.keys, *given), self.bindings), relation.key_columns))[0]
        if not on_keys(new, relation.data, relation.key_columns, "left_anti").isEmpty():
            raise A.ScriptError(f"{relation.name} lacks a key that was to be updated")
        old = written(on_keys(relation.data, new, relation.key_columns, "left_semi"))[0]
        names = {f.name for f in given}
        merged = on_keys(relation.data, new, relation.key_columns, "inner").select(
            *[F.col(f"`r_{c}`").cast(relation.data.schema[c].dataType).alias(c) if c in names else F.col(f"`{c}`") for c in relation.columns]
        )
        merged = written(merged)[0]
        self.saved(relation, new, merged)
        return Change(relation.name, "put", merged, old)

    # --- removal -------------------------------------------------------------------

    def rm(self, strict: bool = False) -> Change:
        relation = self.catalog.writable(self.store.name)
        keys = written(self.one_per_key(shaped(self.rows, relation.keys, self.bindings), relation.key_columns))[0]
        if strict and not on_keys(keys, relation.data, relation.key_columns, "left_anti").isEmpty():
            raise A.ScriptError(f"{relation.name} lacks a key that was to be deleted")
        old = written(on_keys(relation.data, keys, relation.key_columns, "left_semi"))[0]
        self.saved(relation, keys, None)
        return Change(relation.name, "rm", keys, old)

    def delete(self) -> Change:
        return self.rm(True)

    # --- assertions ----------------------------------------------------------------

    def ensure(self) -> None:
        relation = self.catalog.readable(self.store.name)
        held = [f for f in (*relation.keys, *relation.values) if self.bindings.get(f.name, f.name) in self.rows.columns]
        rows = shaped(self.rows, tuple(held), self.bindings)
        if not on_keys(rows, relation.data, [f.name for f in held], "left_anti").isEmpty():
            raise A.ScriptError(f"{relation.name} does not hold all rows that it should")

    def ensure_not(self) -> None:
        relation = self.catalog.readable(self.store.name)
        rows = shaped(self.rows, relation.keys, self.bindings)
        if not on_keys(rows, relation.data, relation.key_columns, "left_semi").isEmpty():
            raise A.ScriptError(f"{relation.name} holds a key that it should not")


Callback = Callable[[str, DataFrame, DataFrame], None]
