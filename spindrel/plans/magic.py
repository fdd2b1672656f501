"""Bound calls of rules: make a recursion compute only what its callers ask for.

A call is adorned by which of its arguments are bound when it runs (``b``) or not
(``f``).  For every adornment of a recursive rule that is called with something bound, a
copy of the rule is made that is guarded by a *demand* relation holding the bound
arguments asked for.  Demand starts from the callers and is passed on sideways: what the
atoms before a recursive call bind is what that call asks.  The copies' fixpoint then
touches only the reachable part.

Where all callers bind an argument to one constant and every recursive call passes it on
unchanged, the constant simply moves into the definitions, which needs no demand at all.

Left alone are rules with aggregates (their groups must be whole), the entry rule,
algorithm inputs, and rules used under a negation or by other recursive groups.
"""

from __future__ import annotations

from typing import Any

from spindrel.plans import ast as A
from spindrel.plans.analyze import ENTRY, Definition, binds, ordered, recursive, strata


def constant_of(body: list[Any], e: Any) -> Any:
    """The literal that an argument surely equals, or None."""
    if isinstance(e, A.Lit):
        return e
    if isinstance(e, A.Var):
        for atom in body:
            if isinstance(atom, A.Unify) and not atom.spread and atom.var == e.name and isinstance(atom.expr, A.Lit):
                return atom.expr
            if isinstance(atom, A.Test) and isinstance(atom.expr, A.Call) and atom.expr.name == "eq":
                left, right = atom.expr.args
                if left == e and isinstance(right, A.Lit):
                    return right
                if right == e and isinstance(left, A.Lit):
                    return left
    return None


def calls(body: list[Any], name: str) -> list[tuple[bool, A.RuleAtom]]:
    out = []
    for atom in body:
        negated = isinstance(atom, A.Not)
        inner = atom.atom if negated else atom
        if isinstance(inner, A.RuleAtom) and inner.name == name:
            out.append((negated, inner))
    return out


def specialised(rules: dict[str, Definition]) -> dict[str, Definition]:
    """Definitions with what their callers bind pushed into recursion where that is safe."""
    for group in strata(rules):
        if len(group) != 1 or not recursive(group, rules) or group[0] == ENTRY:
            continue
        d = rules[group[0]]
        if d.constants or d.fixed or used_by_algorithm(rules, d.name):
            continue
        if not pushed_constant(rules, d) and not d.aggregates:
            demanded(rules, d)
    return rules


def used_by_algorithm(rules: dict[str, Definition], name: str) -> bool:
    return any(r.fixed and any(not i.stored and i.name == name for i in r.fixed.inputs) for r in rules.values())


def pushed_constant(rules: dict[str, Definition], d: Definition) -> bool:
    done = False
    for i, h in enumerate(d.head):
        if h.aggregate:
            continue
        outside: set[Any] = set()
        for other in rules.values():
            if other is not d:
                for body in other.bodies:
                    outside |= {constant_of(body, call.args[i]) if len(call.args) > i else None for _, call in calls(body, d.name)}
        inside = all(len(call.args) > i and call.args[i] == A.Var(h.var) for body in d.bodies for _, call in calls(body, d.name))
        if len(outside) == 1 and None not in outside and inside:
            constant = next(iter(outside))
            d.bodies = [[*body, A.Test(A.Call("eq", (A.Var(h.var), constant)))] for body in d.bodies]
            done = True
    return done


def adornment(call: A.RuleAtom, bound: set[str]) -> str:
    known = lambda e: isinstance(e, A.Lit) or (not isinstance(e, A.Var) and A.variables(e) <= bound) or (isinstance(e, A.Var) and e.name in bound)
    return "".join("b" if known(e) else "f" for e in call.args)


def literals(body: list[Any]) -> set[str]:
    return {a.var for a in body if isinstance(a, A.Unify) and not a.spread and isinstance(a.expr, A.Lit)}


def demanded(rules: dict[str, Definition], d: Definition) -> None:
    """Replace calls of ``d`` by calls of guarded copies, if every caller binds something."""
    callers: list[tuple[Definition, int, int, list[Any], str]] = []
    for other in rules.values():
        if other is d:
            continue
        for b, body in enumerate(other.bodies):
            found = calls(body, d.name)
            if not found:
                continue
            if any(negated for negated, _ in found) or recursive([other.name], rules):
                return
            run = ordered(body)
            bound: set[str] = set()
            for n, atom in enumerate(run):
                if isinstance(atom, A.RuleAtom) and atom.name == d.name:
                    how = adornment(atom, bound | literals(body))
                    if "b" not in how or len(how) != len(d.head):
                        return
                    callers.append((other, b, n, run, how))
                bound |= set() if isinstance(atom, A.Not) else binds(atom)
    if not callers or any(len(run) and sum(isinstance(a, A.RuleAtom) and a.name == d.name for a in run) > 1 for *_, run, _ in callers):
        return
    made: dict[str, Definition] = {}
    demand: dict[str, Definition] = {}
    head = tuple(h.var for h in d.head)

    def demand_of(how: str) -> Definition:
        name = f"{d.name}.demand.{how}"
        if name not in demand:
            own = demand[name] = Definition(name)
            own.head = tuple(A.HeadArg(v) for v, c in zip(head, how, strict=True) if c == "b")
        return demand[name]

    def ask(how: str, before: list[Any], call: A.RuleAtom) -> None:
        """What the atoms before a call know about its bound arguments is asked for."""
        wanted = [(v, e) for v, e, c in zip(head, call.args, how, strict=True) if c == "b"]
        apart = {v: f"{v}'" for atom in before for v in names_in(atom)} | {v: f"{v}'" for _, e in wanted for v in A.variables(e)}
        from spindrel.plans.analyze import substitute

        body = [substitute(a, apart) for a in before] + [A.Unify(v, substitute(e, apart)) for v, e in wanted]
        own = demand_of(how)
        if body not in own.bodies and not (len(body) == len(wanted) + 1 and trivial(own, body)):
            own.bodies.append(body)

    def trivial(own: Definition, body: list[Any]) -> bool:
        """A demand that only repeats itself."""
        first = body[0]
        return isinstance(first, A.RuleAtom) and first.name == own.name and [a.expr for a in body[1:]] == list(first.args)

    def copy_for(how: str) -> str:
        name = f"{d.name}.{how}"
        if name in made:
            return name
        own = made[name] = Definition(name)
        own.head = d.head
        guard = A.RuleAtom(demand_of(how).name, tuple(A.Var(v) for v, c in zip(head, how, strict=True) if c == "b"))
        for body in d.bodies:
            run, bound, out = ordered_after(body, guard), set(binds(guard)), [guard]
            for atom in run:
                if isinstance(atom, A.RuleAtom) and atom.name == d.name:
                    inner = adornment(atom, bound | literals(body))
                    if "b" not in inner:  # nothing known here: this rule cannot be guarded
                        raise Unbound
                    ask(inner, list(out), atom)
                    atom = A.RuleAtom(copy_for(inner), atom.args)
                out.append(atom)
                bound |= set() if isinstance(atom, A.Not) else binds(atom)
            own.bodies.append(out)
        return name

    changed: list[tuple[Definition, int, list[Any]]] = []
    try:
        for other, b, n, run, how in callers:
            ask(how, run[:n] + [a for a in run[n + 1 :] if isinstance(a, A.Unify) and a.var in literals(run) and isinstance(a.expr, A.Lit)], run[n])
            changed.append((other, b, [*run[:n], A.RuleAtom(copy_for(how), run[n].args), *run[n + 1 :]]))
    except (Unbound, A.ScriptError):
        return
    for other, b, body in changed:
        other.bodies[b] = body
    rules |= made | demand


class Unbound(Exception):
    """A recursive call without any bound argument."""


def names_in(atom: Any) -> set[str]:
    from spindrel.plans.analyze import _names

    return _names(atom)


def ordered_after(body: list[Any], guard: A.RuleAtom) -> list[Any]:
    """The body's atoms in running order when the guard's variables are bound first.

    Atoms that share a bound variable come before those that do not, so that a recursive
    call is asked with as much as possible.
    """
    out = ordered([guard, *body])
    out.remove(guard)
    bound, sorted_ = set(binds(guard)), []
    left = list(out)
    while left:
        ready = [a for a in left if safe(a, bound, left)]
        best = max(ready, key=lambda a: (bool(names_in(a) & bound) or not isinstance(a, A.RuleAtom | A.StoredAtom), -left.index(a)))
        sorted_.append(best)
        left.remove(best)
        bound |= set() if isinstance(best, A.Not) else binds(best)
    return sorted_


def safe(atom: Any, bound: set[str], left: list[Any]) -> bool:
    from spindrel.plans.analyze import needs

    if isinstance(atom, A.Not):
        later = set().union(*(binds(a) for a in left if a is not atom and not isinstance(a, A.Not)), set())
        return not ((names_in(atom) & later) - bound)
    own = binds(atom) if isinstance(atom, A.RuleAtom | A.StoredAtom) else set()
    return needs(atom) <= bound | own
