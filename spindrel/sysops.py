"""System operations: listings, indices, triggers, access levels."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from spindrel.plans import ast as A
from spindrel.plans.analyze import definitions, recursive, strata
from spindrel.sources.catalog import LEVELS, Index, index_relation, with_entries

CHANGING = {"remove", "rename", "access_level", "set_triggers", "create_index", "drop_index", "compact", "describe", "kill"}


def rows(session: Any, data: list[tuple], schema: str) -> DataFrame:
    return session.spark.createDataFrame(data, schema)


def run_sysop(session: Any, op: A.SysOp, immutable: bool = False) -> DataFrame:
    if immutable and op.op in CHANGING:
        raise A.ScriptError("an immutable script cannot change the system")
    return globals()[f"op_{op.op}"](session, *op.args)


def ok(session: Any) -> DataFrame:
    return session.status("OK")


def op_relations(session: Any) -> DataFrame:
    out = [
        (r.name, len(r.columns), r.access, len(r.keys), len(r.values), *(sum(e == kind for e, _ in r.triggers) for kind in ("put", "rm", "replace")), r.description)
        for r in session.catalog.relations.values()
    ]
    return rows(session, sorted(out), "name string, arity int, access_level string, n_keys int, n_non_keys int, n_put_triggers int, n_rm_triggers int, n_replace_triggers int, description string")


def op_columns(session: Any, name: str) -> DataFrame:
    r = session.catalog.readable(name)
    types = {f.name: f.dataType.simpleString() for f in r.data.schema}
    out = [(f.name, f in r.keys, i, types[f.name], f.default is not None) for i, f in enumerate((*r.keys, *r.values))]
    return rows(session, out, "column string, is_key boolean, index int, type string, has_default boolean")


def op_indices(session: Any, name: str) -> DataFrame:
    r = session.catalog.get(name)
    return rows(session, [(i.name, i.kind, repr(i.options)) for i in r.indices], "name string, type string, config string")


def op_describe(session: Any, name: str, text: str | None) -> DataFrame:
    session.catalog.get(name)
    session._set(name, description=text or "")
    return ok(session)


def op_remove(session: Any, *names: str) -> DataFrame:
    for n in names:
        r = session.catalog.writable(n, "normal")
        if r.indices:
            raise A.ScriptError(f"{n} has indices; drop them first")
    for n in names:
        del session.catalog.relations[n]
    return ok(session)


def op_rename(session: Any, *pairs: tuple[str, str]) -> DataFrame:
    from dataclasses import replace

    for old, new in pairs:
        r = session.catalog.writable(old, "normal")
        if new in session.catalog.relations:
            raise A.ScriptError(f"{new} exists already")
        del session.catalog.relations[old]
        session.catalog.relations[new] = replace(r, name=new)
    return ok(session)


def op_access_level(session: Any, level: str, names: tuple[str, ...]) -> DataFrame:
    if level not in LEVELS:
        raise A.ScriptError(f"no access level {level}")
    for n in names:
        session.catalog.get(n)
        session._set(n, access=level)
    return ok(session)


def op_set_triggers(session: Any, name: str, triggers: tuple) -> DataFrame:
    session.catalog.writable(name, "protected")
    session._set(name, triggers=triggers)
    return ok(session)


def op_show_triggers(session: Any, name: str) -> DataFrame:
    triggers = session.catalog.get(name).triggers
    numbered: list[tuple] = []
    for kind in ("put", "rm", "replace"):
        numbered += [(kind, i, text) for i, text in enumerate(t for e, t in triggers if e == kind)]
    return rows(session, numbered, "type string, idx int, trigger string")


def op_create_index(session: Any, relation: str, name: str, kind: str, options: tuple) -> DataFrame:
    r = session.catalog.writable(relation, "protected")
    if any(i.name == name for i in r.indices):
        raise A.ScriptError(f"{relation} has an index {name} already")
    index = Index(name, kind, tuple(options))
    needed = {"hnsw": ("dim", "fields"), "fts": ("extractor", "tokenizer"), "lsh": ("extractor", "tokenizer")}.get(kind, ())
    if missing := [n for n in needed if n not in dict(options)] if kind != "normal" else []:
        raise A.ScriptError(f"the index needs {', '.join(missing)}")
    if kind == "normal" and (unknown := [c for c in options if c not in r.columns]):
        raise A.ScriptError(f"{relation} has no column {', '.join(unknown)}")
    index_relation(r, index)  # fails on what cannot be indexed
    session._set(relation, indices=(*r.indices, index))
    session.catalog.relations[relation] = with_entries(session.catalog.relations[relation])
    return ok(session)


def op_drop_index(session: Any, relation: str, name: str) -> DataFrame:
    r = session.catalog.writable(relation, "protected")
    if all(i.name != name for i in r.indices):
        raise A.ScriptError(f"{relation} has no index {name}")
    session._set(relation, indices=tuple(i for i in r.indices if i.name != name), stored=tuple(x for x in r.stored if x[0] != name))
    return ok(session)


def op_compact(session: Any) -> DataFrame:
    """Rewrite every relation that was written here, one file per shuffle partition."""
    from spindrel.sources.durable import written

    for name, r in list(session.catalog.relations.items()):
        if r.keys:
            session._set(name, data=written(r.data.repartition(*r.key_columns))[0], layers=0)
    return ok(session)


def op_running(session: Any) -> DataFrame:
    return rows(session, [(k, float(t)) for k, (_, t) in session.running.items()], "id string, started_at double")


def op_kill(session: Any, group: str) -> DataFrame:
    if str(group) not in session.running:
        return session.status("NOT_FOUND")
    session.spark.sparkContext.cancelJobGroup(str(group))
    return session.status("KILLING")


def op_fixed_rules(session: Any) -> DataFrame:
    from spindrel.operators import graph, ranking, traversal  # noqa: F401
    from spindrel.operators.fixed import BUILTIN

    return rows(session, [(n,) for n in sorted({*BUILTIN, *session.fixed_rules})], "rule string")


def op_explain(session: Any, program: A.Program) -> DataFrame:
    """Strata, rules and the atoms of their bodies in the order in which they run."""
    from spindrel.plans.analyze import arguments, ordered

    rules = definitions(program)
    out = []
    for number, group in enumerate(strata(rules)):
        for name in group:
            d = rules[name]
            kind = "recursive" if recursive(group, rules) else "once"
            if d.fixed:
                out.append((number, name, 0, 0, "algorithm", d.fixed.algorithm, kind))
            for b, body in enumerate(d.bodies):
                bound: set[str] = set()
                for i, atom in enumerate(ordered(body)):
                    inner = atom.atom if isinstance(atom, A.Not) else atom
                    seen = {e.name for e in arguments(inner) if isinstance(e, A.Var)}
                    joins = ", ".join(sorted(seen & bound))
                    op = type(inner).__name__ if not isinstance(atom, A.Not) else f"not {type(inner).__name__}"
                    out.append((number, name, b, i, op, getattr(inner, "name", getattr(inner, "relation", "")) or joins, f"{kind}; joins on {joins or 'nothing'}"))
                    bound |= seen | ({inner.var} if isinstance(inner, A.Unify) else set())
    return rows(session, out, "stratum int, rule string, definition int, step int, op string, reference string, note string")
