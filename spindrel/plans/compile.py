"""Rule bodies to DataFrames, and the evaluation of strata.

A body is a chain of DataFrame operations in atom order; Catalyst reorders, prunes and
pushes down.  Only recursion is driven from here, by semi-naive rounds over durable
deltas.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.functions import aggregates as G
from spindrel.plans import ast as A
from spindrel.plans.analyze import ENTRY, Definition, binds, needs, ordered, recursive, strata
from spindrel.plans.expressions import JSON_FLAG, Scope, flagged
from spindrel.sources.durable import counted, delete, written

MAX_ROUNDS = 10_000
#: Deltas are merged into one table whenever so many have gathered.
COMPACT = 12


def position(i: int) -> str:
    return f"_{i}"


def flags(df: DataFrame, name: str) -> dict:
    return {JSON_FLAG: True} if flagged(df.schema[name]) else {}


class Body:
    """One conjunction: a DataFrame and the columns that hold its variables."""

    def __init__(self, evaluator: Evaluator):
        self.evaluator = evaluator
        self.df: DataFrame | None = None
        self.columns: dict[str, str] = {}
        self.constants: dict[str, Any] = {}  # variables that are literals, which sources filter by
        self.made = 0
        self.unique: list[set[str]] | None = []  # for each source so far, variables that tell its rows apart

    # --- state ---------------------------------------------------------------------

    def frame(self) -> DataFrame:
        if self.df is None:
            self.df = self.evaluator.spark.range(0, 1, 1, 1).select(F.lit(0).alias("_unit"))
        return self.df

    def scope(self) -> Scope:
        return Scope(self.frame(), self.columns)

    def fresh(self) -> str:
        self.made += 1
        return f"v{self.made}"

    # --- atoms ---------------------------------------------------------------------

    def run(self, atoms: list[Any], wanted: set[str] | None = None) -> Body:
        """All atoms in turn.  Where rows are a set, ``wanted`` are the variables that the head takes."""
        order = ordered(atoms)
        for i, atom in enumerate(order):
            self.apply(atom, None if wanted is None else wanted.union(*map(mentioned, order[i + 1 :])))
        return self

    def apply(self, atom: Any, later: set[str] | None = None) -> None:
        """One atom; ``later`` are the variables that anything after it needs, if only their values count."""
        if isinstance(atom, A.Test):
            self.df = self.frame().where(self.scope().test(atom.expr))
        elif isinstance(atom, A.Unify):
            self.unify(atom)
        elif isinstance(atom, A.Not):
            source, pairs, keys = self.evaluator.source(atom.atom, self)
            self.anti_join(source, [(c, e) for c, e in pairs if not isinstance(e, A.Var) or e.name in self.columns])
        elif isinstance(atom, A.SearchAtom):
            self.evaluator.search(atom, self)
            self.unique = None
        else:
            source, pairs, keys = self.evaluator.source(atom, self)
            self.join(source, pairs, keys, later)

    def unify(self, atom: A.Unify) -> None:
        scope = self.scope()
        if atom.spread:
            values = scope.compile(atom.expr)
            if values.json or not values.list:
                raise A.ScriptError("in takes a list")
            name = self.fresh()
            if isinstance(values.type.elementType, T.NullType):
                self.df = self.frame().select("*", F.lit(None).cast("long").alias(name)).where(F.lit(False))
            else:
                self.df = self.frame().select("*", F.explode(values.col).alias(name))
            self.unique = None
            if atom.var in self.columns:
                self.df = self.df.where(F.col(name).eqNullSafe(F.col(self.columns[atom.var]))).drop(name)
            else:
                self.columns[atom.var] = name
        elif atom.var in self.columns:
            self.df = self.frame().where(scope.test(A.Call("eq", (A.Var(atom.var), atom.expr))))
        else:
            name = self.fresh()
            self.df = self.frame().select("*", scope.column(atom.expr, name))
            self.columns[atom.var] = name
            if isinstance(atom.expr, A.Lit):
                self.constants[atom.var] = atom.expr

    def narrowed(self, source: DataFrame, pairs: list[tuple[str, Any]]) -> tuple[DataFrame, dict[str, str], list[tuple[str, Any]]]:
        """Source filtered by constants and repeated variables: (rows, variable -> column, computed arguments)."""
        own: dict[str, str] = {}
        later: list[tuple[str, Any]] = []
        for column, e in pairs:
            if isinstance(e, A.Var):
                if e.name in self.constants:
                    source = source.where(Scope(source, {"_": column}).test(A.Call("eq", (A.Var("_"), self.constants[e.name]))))
                if e.name in own:
                    source = source.where(F.col(f"`{column}`").eqNullSafe(F.col(f"`{own[e.name]}`")))
                else:
                    own[e.name] = column
            elif A.variables(e):
                later.append((column, e))
            else:
                scope = Scope(source, {"_": column})
                source = source.where(scope.test(A.Call("eq", (A.Var("_"), e))))
        return source, own, later

    def join(self, source: DataFrame, pairs: list[tuple[str, Any]], keys: set[str] | None, needed: set[str] | None = None) -> None:
        source, own, later = self.narrowed(source, pairs)
        names = {column: self.fresh() for column in [*own.values(), *(c for c, _ in later)]}
        # constants count as known; a computed argument does too, as it depends on variables
        fixed = {c for c, e in pairs if not isinstance(e, A.Var)}
        told = {v for v, c in own.items() if keys and c in keys}
        whole = keys is not None and keys <= {own[v] for v in told} | fixed
        right = source.select(*[F.col(f"`{c}`").alias(n, metadata=flags(source, c)) for c, n in names.items()])
        shared = [v for v in own if v in self.columns]
        if self.df is None:
            self.df = right
        else:
            condition = None
            computed = [(c, e) for c, e in later if A.variables(e) <= set(self.columns)]
            later = [x for x in later if x not in computed]
            extra = []
            for column, e in computed:  # arguments over bound variables are join keys too
                name = self.fresh()
                self.df = self.df.select("*", self.scope().column(e, name))
                same = F.col(name).eqNullSafe(F.col(names[column]))
                condition = same if condition is None else condition & same
                extra += [name, names[column]]
            for v in shared:
                same = F.col(self.columns[v]).eqNullSafe(F.col(names[own[v]]))
                condition = same if condition is None else condition & same
            if condition is not None and not later and needed is not None and not needed & {v for v in own if v not in shared}:
                # nothing that the atom brings is used: it only tests whether there is a row
                self.df = self.df.join(right, condition, "left_semi").drop(*extra)
                return
            self.df = (self.df.crossJoin(right) if condition is None else self.df.join(right, condition)).drop(*[names[own[v]] for v in shared], *extra)
        for v, column in own.items():
            self.columns.setdefault(v, names[column])
        for column, e in later:
            self.columns["#"] = names[column]
            self.df = self.df.where(self.scope().test(A.Call("eq", (A.Var("#"), e)))).drop(names[column])
            del self.columns["#"]
        if self.unique is not None:
            self.unique = [*self.unique, told] if whole else None

    def anti_join(self, source: DataFrame, pairs: list[tuple[str, Any]]) -> None:
        source, own, later = self.narrowed(source, pairs)
        left = self.frame()
        dropped = []
        keys = [(self.columns[v], c) for v, c in own.items()]
        for column, e in later:
            name = self.fresh()
            left = left.select("*", self.scope().column(e, name))
            dropped.append(name)
            keys.append((name, column))
        if not keys:
            self.df = left.join(source.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
            return
        names = [self.fresh() for _ in keys]
        right = source.select(*[F.col(f"`{c}`").alias(n) for (_, c), n in zip(keys, names, strict=True)])
        condition = None
        for (mine, _), n in zip(keys, names, strict=True):
            same = F.col(mine).eqNullSafe(F.col(n))
            condition = same if condition is None else condition & same
        self.df = left.join(right, condition, "left_anti").drop(*dropped)

    # --- heads ---------------------------------------------------------------------

    def project(self, head: tuple) -> DataFrame:
        """The head's variables by position; arguments of aggregates included."""
        frame, out = self.frame(), []
        for i, h in enumerate(head):
            if h.var not in self.columns:
                raise A.ScriptError(f"head variable {h.var} is not bound")
            column = self.columns[h.var]
            out.append(F.col(column).alias(position(i), metadata=flags(frame, column)))
        return frame.select(*out)

    def distinct_in(self, head: tuple) -> bool:
        """Whether no two rows can agree in the head."""
        mine = {h.var for h in head}
        return self.unique is not None and all(u <= mine for u in self.unique)


def mentioned(atom: Any) -> set[str]:
    """Every variable that an atom reads or binds."""
    inner = atom.atom if isinstance(atom, A.Not) else atom
    out = binds(inner) | needs(inner)
    if isinstance(inner, A.SearchAtom):
        out |= set().union(*(A.variables(e) for _, e in inner.options), set())
    return out


def wanted_by(d: Definition) -> set[str] | None:
    """The variables of a head; None where the number of rows counts too."""
    return None if d.aggregates else {h.var for h in d.head}


def unioned(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames by position, numbers widened."""
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    if len(frames) > 1:
        marked = [any(flagged(df.schema[i]) for df in frames) for i in range(len(out.columns))]
        if any(marked):
            out = out.select(*[F.col(c).alias(c, metadata={JSON_FLAG: True}) if m else F.col(c) for c, m in zip(out.columns, marked, strict=True)])
    return out


def null_safe_minus(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    other = right.select(*[F.col(c).alias(f"r{c}") for c in columns])
    condition = None
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"r{c}"))
        condition = same if condition is None else condition & same
    return left.join(other, condition, "left_anti") if condition is not None else left


def null_safe_common(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``left`` whose ``columns`` occur in ``right``."""
    other = right.select(*[F.col(c).alias(f"r{c}") for c in columns])
    condition = F.lit(True)
    for i, c in enumerate(columns):
        same = F.col(c).eqNullSafe(F.col(f"r{c}"))
        condition = same if not i else condition & same
    return left.join(other, condition, "left_semi")


def aggregated(rows: DataFrame, head: tuple, nonempty_only: bool = False) -> DataFrame:
    """Group by the plain head variables; without any there is one row, even over nothing."""
    if any(h.aggregate == "choice_rand" for h in head):
        rows = rows.withColumn("_rand", F.rand())
    scope = Scope(rows, {position(i): position(i) for i in range(len(head))})
    keys = [position(i) for i, h in enumerate(head) if not h.aggregate]
    made, counted, plain = [], [], rows
    for i, h in enumerate(head):
        if h.aggregate == "group_count":
            counted.append(i)
        elif h.aggregate:
            value = scope.compile(A.Var(position(i)))
            column = G.build(h.aggregate, value, [scope.compile(e) for e in h.extra])
            made.append((column, h.aggregate, i))
    bits = [m for m in made if m[1].startswith("bit_")]
    rest = [m for m in made if not m[1].startswith("bit_")]
    parts: list[DataFrame] = []
    for group in (rest, bits):  # pandas aggregates cannot stand beside built-in ones
        if group:
            columns = [c.alias(position(i)) for c, _, i in group]
            parts.append(plain.groupBy(*keys).agg(*columns) if keys else plain.agg(*columns))
    for i in counted:
        pairs = rows.groupBy(*[k for k in keys], F.col(position(i)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        packed = F.sort_array(F.collect_list(F.struct(F.col("_v").alias("_0"), F.col("_n").alias("_1")))).alias(position(i))
        parts.append(pairs.groupBy(*keys).agg(packed) if keys else pairs.agg(packed))
    out = parts[0]
    for extra in parts[1:]:
        if not keys:
            out = out.crossJoin(extra)
            continue
        other = extra.select(*[F.col(k).alias(f"r{k}") if k in keys else F.col(k) for k in extra.columns])
        condition = None
        for k in keys:
            same = F.col(k).eqNullSafe(F.col(f"r{k}"))
            condition = same if condition is None else condition & same
        out = out.join(other, condition).drop(*[f"r{k}" for k in keys])
    out = out.select(*[position(i) for i in range(len(head))])
    if nonempty_only and not keys:
        out = out.join(rows.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_semi")
    return out


class Evaluator:
    """Evaluates the strata of a program against a session's relations."""

    def __init__(self, session: Any, rules: dict[str, Definition], temporary: dict[str, DataFrame] | None = None):
        self.session, self.spark, self.rules = session, session.spark, rules
        self.results: dict[str, DataFrame] = {}
        self.temporary = temporary or {}
        self.total: dict[str, DataFrame] = {}
        self.fresh: dict[str, DataFrame] = {}

    # --- sources -------------------------------------------------------------------

    def source(self, atom: Any, body: Body) -> tuple[DataFrame, list[tuple[str, Any]], set[str] | None]:
        """(rows, [(column, argument)], key columns if known) of a relational atom."""
        if isinstance(atom, Delta):
            return self.paired(self.fresh[atom.name], atom)
        if isinstance(atom, A.RuleAtom):
            if atom.name in self.total:
                return self.paired(self.total[atom.name], atom)
            if atom.name in self.results:
                return self.paired(self.results[atom.name], atom)
            if atom.name in self.temporary:
                return self.paired(self.temporary[atom.name], atom)
            raise A.ScriptError(f"rule {atom.name} is not defined")
        if atom.name in self.temporary:
            df, keys = self.temporary[atom.name], None
            names = df.columns
        else:
            relation = self.session.catalog.readable(atom.name)
            df, names = relation.frame(), relation.columns
            keys = set(relation.key_columns) or None
            if atom.at is not None:
                from spindrel.sources.timetravel import as_of

                df, keys = as_of(df, relation, atom.at), set(relation.key_columns[:-1]) or None
        if atom.args is not None:
            if len(atom.args) != len(names):
                raise A.ScriptError(f"{atom.name} has {len(names)} columns, not {len(atom.args)}")
            pairs = list(zip(names, atom.args, strict=True))
        else:
            for c, _ in atom.named:
                if c not in names:
                    raise A.ScriptError(f"{atom.name} has no column {c}")
            pairs = list(atom.named)
        wild = [(c, e) for c, e in pairs if not (isinstance(e, A.Var) and e.name.startswith("_") and e.name.endswith("_") and e.name[1:-1].isdigit())]
        return df, wild, keys

    def paired(self, df: DataFrame, atom: Any) -> tuple[DataFrame, list[tuple[str, Any]], set[str] | None]:
        if len(atom.args) != len(df.columns):
            raise A.ScriptError(f"{atom.name} has {len(df.columns)} columns, not {len(atom.args)}")
        pairs = list(zip(df.columns, atom.args, strict=True))
        wild = [(c, e) for c, e in pairs if not (isinstance(e, A.Var) and e.name.startswith("_") and e.name.endswith("_") and e.name[1:-1].isdigit())]
        return df, wild, set(df.columns)

    def search(self, atom: A.SearchAtom, body: Body) -> None:
        from spindrel.operators.search import search_join

        search_join(self.session, atom, body)

    # --- strata --------------------------------------------------------------------

    def run(self) -> DataFrame:
        """The entry rule's rows, columns by position."""
        for group in strata(self.rules):
            if recursive(group, self.rules):
                self.fixpoint(group)
            else:
                self.results[group[0]] = self.single(self.rules[group[0]])
        return self.results[ENTRY]

    def constant_rows(self, d: Definition, rows: Any) -> DataFrame:
        from spindrel.sources.readers import constant_frame

        return constant_frame(self.spark, rows, len(d.head) or None)

    def single(self, d: Definition) -> DataFrame:
        if d.fixed:
            from spindrel.operators.fixed import run_fixed

            return run_fixed(self, d.fixed)
        frames = [self.constant_rows(d, rows) for rows in d.constants]
        bodies = [Body(self).run(b, wanted_by(d)) for b in d.bodies]
        frames += [b.project(d.head) for b in bodies]
        if not frames:
            raise A.ScriptError(f"{d.name} has no definition")
        rows = unioned(frames)
        if d.aggregates:
            return aggregated(rows, d.head)
        if len(frames) == 1 and bodies and bodies[0].distinct_in(d.head):
            return rows
        return rows.dropDuplicates()

    # --- recursion -----------------------------------------------------------------

    def fixpoint(self, group: list[str]) -> None:
        inside = set(group)
        for name in {a.name for n in group for b in self.rules[n].bodies for a in b if isinstance(a, A.RuleAtom)} - inside:
            if name in self.results:  # read again in every round
                self.results[name], _ = written(self.results[name])
        kept: dict[str, list[tuple[DataFrame, str]]] = {n: [] for n in group}
        found = {n: self.base(self.rules[n], inside) for n in group}
        self.settle_types(group, found, inside)
        self.total, self.fresh = {}, {}
        size: dict[str, int] = {}
        for name in group:
            df, path, size[name] = counted(found[name])
            self.total[name] = self.fresh[name] = df
            kept[name].append((df, path))
        for _ in range(MAX_ROUNDS):
            live = {n for n in group if size[n]}
            if not live:
                break
            after: dict[str, DataFrame] = {}
            for name in group:
                new = self.step(self.rules[name], inside, live)
                after[name] = self.total[name].limit(0) if new is None else new
            fresh = {}
            for name in group:
                fresh[name], path, size[name] = self.news(name, after[name], kept[name])
                if size[name]:
                    kept[name].append((fresh[name], path))
            for name in group:
                self.fresh[name] = fresh[name]
                if len(kept[name]) > COMPACT:
                    old = kept[name][:-1]
                    kept[name] = [written(self.known(name, old)), kept[name][-1]]
                    for _, path in old:
                        delete(self.spark, path)
                self.total[name] = self.known(name, kept[name])
        else:
            raise A.ScriptError(f"no fixpoint after {MAX_ROUNDS} rounds")
        for name in group:
            self.results[name] = self.total[name]
        self.total, self.fresh = {}, {}

    def known(self, name: str, layers: list[tuple[DataFrame, str]]) -> DataFrame:
        """A rule's rows so far; of aggregated rows the best of each key, as later rounds only better them."""
        rows = unioned([df for df, _ in layers])
        d = self.rules[name]
        return aggregated(rows, merge_head(d), True) if d.aggregates and len(layers) > 1 else rows

    def news(self, name: str, rows: DataFrame, layers: list[tuple[DataFrame, str]]) -> tuple[DataFrame, str, int]:
        """What a round adds: (rows, path, count).  Old rows are read, and only those of the keys at hand merged."""
        d, columns = self.rules[name], rows.columns
        old = unioned([df for df, _ in layers])
        if not d.aggregates:
            return counted(null_safe_minus(rows.dropDuplicates(), old, columns))
        offers, path, count = counted(rows)
        if not count:
            return offers, path, 0
        keys = [position(i) for i, h in enumerate(d.head) if not h.aggregate]
        merged = aggregated(offers.union(null_safe_common(old, offers, keys)), merge_head(d), True)
        found = counted(null_safe_minus(merged, old, columns))
        delete(self.spark, path)
        return found

    def base(self, d: Definition, inside: set[str]) -> DataFrame | None:
        """What a rule yields before anything recursive is known."""
        frames = [self.constant_rows(d, rows) for rows in d.constants]
        frames += [Body(self).run(b, wanted_by(d)).project(d.head) for b in d.bodies if not calls_to(b, inside)]
        if not frames:
            return None
        rows = unioned(frames)
        return aggregated(rows, d.head, True) if d.aggregates else rows.dropDuplicates()

    def settle_types(self, group: list[str], found: dict[str, DataFrame | None], inside: set[str]) -> None:
        """Give rules without a base their column types, from bodies whose inputs are typed; widen the others."""
        for _ in range(2 * len(group) + 1):
            changed = False
            for name in group:
                d = self.rules[name]
                self.total = {n: df for n, df in found.items() if df is not None}
                for body in d.bodies:
                    used = calls_to(body, inside)
                    if not used or not {body[i].name for i in used} <= set(self.total):
                        continue
                    rows = Body(self).run(body).project(d.head)
                    shape = aggregated(rows.limit(0), d.head, True) if d.aggregates else rows
                    if found[name] is None:
                        found[name] = shape.limit(0)
                        changed = True
                    else:
                        wide = unioned([found[name], shape]).schema
                        if [f.dataType for f in wide] != [f.dataType for f in found[name].schema]:
                            found[name] = found[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wide])
                            changed = True
            if not changed:
                break
        self.total = {}
        for name in group:
            if found[name] is None:
                raise A.ScriptError(f"{name} has no definition that does not depend on itself")

    def step(self, d: Definition, inside: set[str], live: set[str]) -> DataFrame | None:
        """New rows of one round: in turn each recursive atom reads the last round only."""
        frames = []
        for body in d.bodies:
            for i in calls_to(body, inside):
                if body[i].name in live:
                    changed = [Delta(a.name, a.args) if j == i else a for j, a in enumerate(body)]
                    frames.append(Body(self).run(changed, wanted_by(d)).project(d.head))
        if not frames:
            return None
        rows = unioned(frames)
        kinds = self.total[d.name].schema
        if d.aggregates:
            rows = aggregated(rows, d.head, True)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=flags(self.total[d.name], f.name)) for f in kinds])


class Delta(A.RuleAtom):
    """A recursive atom that reads the last round's new rows."""


def calls_to(body: list[Any], inside: set[str]) -> list[int]:
    return [i for i, a in enumerate(body) if isinstance(a, A.RuleAtom) and a.name in inside]


def merge_head(d: Definition) -> tuple:
    """The head that merges already aggregated rows of a rule."""
    return tuple(A.HeadArg(position(i), h.aggregate, ()) for i, h in enumerate(d.head))


def headers(d: Definition, df: DataFrame) -> list[str]:
    if d.head and len(d.head) == len(df.columns):
        return [f"{h.aggregate}({h.var})" if h.aggregate else h.var for h in d.head]
    return df.columns


def order_column(name: str, down: bool) -> Column:
    c = F.col(f"`{name}`")
    return c.desc_nulls_last() if down else c.asc_nulls_first()
