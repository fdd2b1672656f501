"""From parsed programs to safe conjunctions in strata."""

from __future__ import annotations

from collections import defaultdict
from typing import Any

from spindrel.functions.aggregates import MEET
from spindrel.plans import ast as A

ENTRY = "?"


def negated(atom: Any) -> Any:
    if isinstance(atom, A.Not):
        return normal(atom.atom)
    if isinstance(atom, A.All):
        return A.Any_(tuple(negated(a) for a in atom.atoms))
    if isinstance(atom, A.Any_):
        return A.All(tuple(negated(a) for a in atom.branches))
    if isinstance(atom, A.Unify):
        return A.Test(A.Call("negate", (A.Call("is_in" if atom.spread else "eq", (A.Var(atom.var), atom.expr)),)))
    if isinstance(atom, A.Test):
        return A.Test(A.Call("negate", (atom.expr,)))
    return A.Not(atom)


def normal(atom: Any) -> Any:
    """Negations moved down to single atoms."""
    if isinstance(atom, A.Not):
        return negated(atom.atom)
    if isinstance(atom, A.All):
        return A.All(tuple(map(normal, atom.atoms)))
    if isinstance(atom, A.Any_):
        return A.Any_(tuple(map(normal, atom.branches)))
    return atom


def branches(atom: Any) -> list[list[Any]]:
    """Disjunctive normal form: conjunctions of plain atoms."""
    if isinstance(atom, A.Any_):
        return [c for b in atom.branches for c in branches(b)]
    if isinstance(atom, A.All):
        out: list[list[Any]] = [[]]
        for a in atom.atoms:
            out = [left + right for left in out for right in branches(a)]
        return out
    return [[atom]]


def arguments(atom: Any) -> list[Any]:
    """The expressions in the columns of a relational atom."""
    if isinstance(atom, A.RuleAtom):
        return list(atom.args)
    if isinstance(atom, A.StoredAtom):
        return list(atom.args) if atom.args is not None else [e for _, e in atom.named]
    if isinstance(atom, A.SearchAtom):
        return [e for _, e in atom.named]
    return []


def binds(atom: Any) -> set[str]:
    """Variables that an atom can bind."""
    if isinstance(atom, A.Unify):
        return {atom.var}
    out = {e.name for e in arguments(atom) if isinstance(e, A.Var)}
    if isinstance(atom, A.SearchAtom):
        out |= {e.name for k, e in atom.options if k.startswith("bind_") and isinstance(e, A.Var)}
    return out


def needs(atom: Any) -> set[str]:
    """Variables that must be bound before an atom can run."""
    if isinstance(atom, A.Test):
        return A.variables(atom.expr)
    if isinstance(atom, A.Unify):
        return A.variables(atom.expr)
    out = set().union(*(A.variables(e) for e in arguments(atom) if not isinstance(e, A.Var)), set())
    if isinstance(atom, A.SearchAtom):
        out |= set().union(*(A.variables(e) for k, e in atom.options if k in ("query", "k", "ef", "radius", "score_kind")), set())
    return out


def ordered(atoms: list[Any]) -> list[Any]:
    """Atoms in written order, each delayed until what it needs is bound."""
    left, out, bound = list(atoms), [], set()
    # variables that some positive atom binds: a negation waits for its own among them
    bindable = set().union(*(binds(a) for a in atoms if not isinstance(a, A.Not)), set())
    while left:
        for i, atom in enumerate(left):
            if isinstance(atom, A.Not):
                inside = (binds(atom.atom) & bindable) | needs(atom.atom)
                ready = inside <= bound
            elif isinstance(atom, A.Unify) and not atom.spread and isinstance(atom.expr, A.Var) and atom.var in bound:
                ready = True
                if atom.expr.name not in bound:
                    atom = A.Unify(atom.expr.name, A.Var(atom.var))
            else:
                # a relation brings its own plain variables: r[x, x + 1] filters what it binds
                brings = binds(atom) if isinstance(atom, A.RuleAtom | A.StoredAtom) else set()
                ready = needs(atom) <= bound | brings
            if ready:
                out.append(atom)
                bound |= set() if isinstance(atom, A.Not) else binds(atom)
                del left[i]
                break
        else:
            open_ = set().union(*(needs(a.atom if isinstance(a, A.Not) else a) for a in left)) - bound
            raise A.ScriptError(f"unsafe rule: {', '.join(sorted(open_)) or 'a negation'} is not bound")
    return out


class Definition:
    """All definitions of a rule: head and conjunctions, or constant rows, or an algorithm."""

    def __init__(self, name: str):
        self.name = name
        self.head: tuple = ()
        self.bodies: list[list[Any]] = []
        self.constants: list[Any] = []
        self.fixed: A.FixedRule | None = None

    @property
    def aggregates(self) -> list[str]:
        return [h.aggregate for h in self.head if h.aggregate]

    @property
    def meet(self) -> bool:
        """All aggregates can be merged, and come after the keys."""
        flags = [bool(h.aggregate) for h in self.head]
        return any(flags) and flags == sorted(flags) and all(a in MEET for a in self.aggregates)

    def calls(self) -> dict[str, bool]:
        """Rules used; True where the use does not allow recursion."""
        out: dict[str, bool] = defaultdict(bool)
        for body in self.bodies:
            for atom in body:
                inner, hard = (atom.atom, True) if isinstance(atom, A.Not) else (atom, False)
                if isinstance(inner, A.RuleAtom):
                    out[inner.name] |= hard or bool(self.aggregates and not self.meet)
        if self.fixed:
            for i in self.fixed.inputs:
                if not i.stored:
                    out[i.name] = True
        return out


def definitions(program: A.Program) -> dict[str, Definition]:
    out: dict[str, Definition] = {}
    for rule in program.rules:
        d = out.setdefault(rule.name, Definition(rule.name))
        first = not (d.bodies or d.constants or d.fixed)
        if isinstance(rule, A.FixedRule):
            if not first:
                raise A.ScriptError(f"{rule.name} cannot have other definitions beside an algorithm")
            d.fixed, d.head = rule, rule.head
            continue
        if d.fixed:
            raise A.ScriptError(f"{rule.name} cannot have other definitions beside an algorithm")
        shape = [(h.aggregate, h.extra) for h in rule.head]
        if not first and (len(shape) != len(d.head) or shape != [(h.aggregate, h.extra) for h in d.head]) and (rule.head or d.head):
            raise A.ScriptError(f"definitions of {rule.name} differ in their heads")
        d.head = d.head or rule.head
        if isinstance(rule, A.ConstRule):
            d.constants.append(rule.rows)
        else:
            d.bodies += [renamed(b, rule.head, d.head) for b in branches(normal(rule.body))]
    if ENTRY not in out:
        raise A.ScriptError("a program needs an entry rule ?")
    return out


def renamed(body: list[Any], own: tuple, shared: tuple) -> list[Any]:
    """A later definition's body with the head variables of the first."""
    if [h.var for h in own] == [h.var for h in shared]:
        return body
    # its own variables move out of the way; those of its head become the shared ones
    names = {v: f"{v}'" for atom in body for v in _names(atom)}
    more = []
    for h, s in zip(own, shared, strict=True):
        if h.var in names and names[h.var] == f"{h.var}'":
            names[h.var] = s.var
        else:
            more.append(A.Unify(s.var, A.Var(names.get(h.var, h.var))))
    return [substitute(a, names) for a in body] + more


def _names(atom: Any) -> set[str]:
    if isinstance(atom, A.Not):
        return _names(atom.atom)
    out = binds(atom) | needs(atom)
    return out | set().union(*(A.variables(e) for e in arguments(atom)), set())


def substitute(x: Any, names: dict[str, str]) -> Any:
    """Rename variables anywhere in an atom or expression."""
    if isinstance(x, A.Var):
        return A.Var(names.get(x.name, x.name))
    if isinstance(x, A.Unify):
        return A.Unify(names.get(x.var, x.var), substitute(x.expr, names), x.spread)
    if isinstance(x, tuple):
        return tuple(substitute(i, names) for i in x)
    if hasattr(x, "__dataclass_fields__"):
        return type(x)(**{f: substitute(getattr(x, f), names) for f in x.__dataclass_fields__})
    return x


def reachable(rules: dict[str, Definition]) -> set[str]:
    seen, todo = set(), [ENTRY]
    while todo:
        name = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        if name in rules:
            todo += list(rules[name].calls())
    return seen


def strata(rules: dict[str, Definition]) -> list[list[str]]:
    """Strongly connected groups of rules, callees first; only what the entry uses."""
    used = reachable(rules)
    for name in used:
        if name not in rules and not name.startswith("_"):
            raise A.ScriptError(f"rule {name} is not defined")
    graph = {n: [c for c in rules[n].calls() if c in rules] for n in used if n in rules}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(start: str) -> None:
        work = [(start, iter(graph[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    work.append((to, iter(graph[to])))
                    break
                if to in stack:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        group.append(stack.pop())
                        if group[-1] == node:
                            break
                    out.append(sorted(group))

    for name in sorted(graph):
        if name not in index:
            visit(name)
    for group in out:
        for name in group:
            for to, hard in rules[name].calls().items():
                if to in group and hard:
                    raise A.ScriptError(f"program cannot be stratified: {name} depends on {to} through a negation, an aggregate or an algorithm")
    return out


def recursive(group: list[str], rules: dict[str, Definition]) -> bool:
    return len(group) > 1 or group[0] in rules[group[0]].calls()
