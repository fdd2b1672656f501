"""Syntax tree of scripts."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class ScriptError(ValueError):
    """A script that cannot be parsed, is unsafe, or fails an assertion."""


# --- expressions -------------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class ObjectOf:
    pairs: tuple


def variables(e) -> set[str]:
    """Free variables of an expression."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(variables, e.args)) if e.args else set()
    if isinstance(e, ListOf):
        return set().union(*map(variables, e.items)) if e.items else set()
    if isinstance(e, ObjectOf):
        return set().union(*(variables(x) for pair in e.pairs for x in pair)) if e.pairs else set()
    return set()


# --- atoms -------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleAtom:
    name: str
    args: tuple


@dataclass(frozen=True)
class StoredAtom:
    """``*rel[..]`` (args) or ``*rel{..}`` (named: column -> expression)."""

    name: str
    args: tuple | None
    named: tuple | None
    at: Any = None


@dataclass(frozen=True)
class SearchAtom:
    relation: str
    index: str
    named: tuple
    options: tuple


@dataclass(frozen=True)
class Unify:
    var: str
    expr: Any
    spread: bool = False


@dataclass(frozen=True)
class Test:
    expr: Any


@dataclass(frozen=True)
class Not:
    atom: Any


@dataclass(frozen=True)
class All:
    atoms: tuple


@dataclass(frozen=True)
class Any_:
    branches: tuple


# --- programs ----------------------------------------------------------------------


@dataclass(frozen=True)
class HeadArg:
    var: str
    aggregate: str | None = None
    extra: tuple = ()


@dataclass(frozen=True)
class Rule:
    name: str
    head: tuple
    body: Any


@dataclass(frozen=True)
class ConstRule:
    name: str
    head: tuple
    rows: Any


@dataclass(frozen=True)
class FixedInput:
    """A relation handed to an algorithm: rule or stored, with its bindings."""

    name: str
    stored: bool
    bindings: tuple
    named: bool = False
    at: Any = None


@dataclass(frozen=True)
class FixedRule:
    name: str
    head: tuple
    algorithm: str
    inputs: tuple
    options: tuple


@dataclass(frozen=True)
class Column:
    name: str
    type: Any = None
    default: Any = None
    binding: str | None = None


@dataclass(frozen=True)
class Schema:
    keys: tuple
    values: tuple


@dataclass(frozen=True)
class Store:
    op: str
    name: str
    schema: Schema | None


@dataclass
class Options:
    limit: int | None = None
    offset: int = 0
    order: list = field(default_factory=list)
    store: Store | None = None
    returning: bool = False
    assertion: str | None = None
    timeout: float | None = None
    sleep: float | None = None
    magic: bool = True


@dataclass
class Program:
    rules: list
    options: Options


@dataclass(frozen=True)
class SysOp:
    op: str
    args: tuple = ()


# --- imperative --------------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    program: Any
    into: str | None = None
    ignore_error: bool = False


@dataclass(frozen=True)
class If:
    condition: Any
    negated: bool
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Loop:
    label: str | None
    body: tuple


@dataclass(frozen=True)
class Jump:
    kind: str
    label: str | None = None


@dataclass(frozen=True)
class Return:
    items: tuple


@dataclass(frozen=True)
class Swap:
    left: str
    right: str


@dataclass(frozen=True)
class Debug:
    name: str
