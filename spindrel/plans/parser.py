"""Hand-written recursive descent parser of the rule language."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from spindrel.plans import ast as A

_SKIP = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)+")
_VAR = re.compile(r"(?:[^\W\d]|_)[\w.]*")
_IDENT = re.compile(r"[^\W\d_]\w*")
_NAME = re.compile(r"[^\W\d]\w*|_\w*")
_DOTTED = re.compile(r"[^\W\d_]\w*(?:\.[^\W\d_]\w*)*")
_STORED = re.compile(r"[^\W\d_]\w*(?:\.[^\W\d_]\w*)*(?::[^\W\d_]\w*)*|_\w+")
_NUMBER = re.compile(r"0x[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7][0-7_]*|0b[01][01_]*|(?:0|[1-9][\d_]*)(?:\.(?!\.)[\d_]*)?[eE][+-]?[\d_]+|(?:0|[1-9][\d_]*)\.(?![.\w])[\d_]*|(?:0|[1-9][\d_]*)\.\d[\d_]*|\d[\d_]*")
_RAW = re.compile(r'(_*)"')
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

#: Binary operators from loosest to tightest; the function that each stands for.
LEVELS = (
    {"||": "or"},
    {"&&": "and"},
    {">=": "ge", "<=": "le", ">": "gt", "<": "lt"},
    {"==": "eq", "!=": "neq"},
    {"%": "mod"},
    {"++": "concat", "+": "add", "-": "sub"},
    {"*": "mul", "/": "div"},
    {"^": "pow"},
    {"~": "coalesce"},
)
_OPS = sorted((op for level in LEVELS for op in level), key=len, reverse=True)
STORE_OPS = ("create", "replace", "insert", "put", "update", "rm", "delete", "ensure_not", "ensure")


class Parser:
    def __init__(self, text: str, params: dict[str, Any] | None = None):
        self.text, self.at, self.params = text, 0, params or {}
        self.wild = 0

    # --- tokens --------------------------------------------------------------------

    def fail(self, what: str) -> A.ScriptError:
        line = self.text.count("\n", 0, self.at) + 1
        return A.ScriptError(f"line {line}: expected {what} at {self.text[self.at : self.at + 30]!r}")

    def skip(self) -> None:
        while True:
            if m := _SKIP.match(self.text, self.at):
                self.at = m.end()
            elif self.text.startswith("/*", self.at):
                depth, at = 1, self.at + 2
                while depth:
                    m = re.compile(r"/\*|\*/").search(self.text, at)
                    if not m:
                        raise self.fail("the end of a comment")
                    depth, at = depth + (1 if m[0] == "/*" else -1), m.end()
                self.at = at
            else:
                return

    def peek(self, token: str) -> bool:
        self.skip()
        if not self.text.startswith(token, self.at):
            return False
        end = self.at + len(token)
        return not (token[-1].isalnum() and end < len(self.text) and (self.text[end].isalnum() or self.text[end] == "_"))

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise self.fail(repr(token))

    def match(self, pattern: re.Pattern) -> str | None:
        self.skip()
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def name(self, pattern: re.Pattern, what: str) -> str:
        found = self.match(pattern)
        if found is None:
            raise self.fail(what)
        return found

    def many(self, end: str, item: Callable[[], Any]) -> tuple:
        """Items with commas between (one more may follow) up to ``end``."""
        out = []
        while not self.take(end):
            out.append(item())
            if not self.take(","):
                self.need(end)
                break
        return tuple(out)

    def attempt(self, rule: Callable[[], Any]) -> Any:
        at, wild = self.at, self.wild
        try:
            return rule()
        except A.ScriptError:
            self.at, self.wild = at, wild
            return None

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.text)

    # --- expressions ---------------------------------------------------------------

    def string(self) -> str | None:
        self.skip()
        if m := _RAW.match(self.text, self.at):
            if not m[1]:
                return self.quoted('"')
            end = self.text.find('"' + m[1], m.end())
            if end < 0:
                raise self.fail("the end of a string")
            self.at = end + 1 + len(m[1])
            return self.text[m.end() : end]
        return self.quoted("'") if self.text.startswith("'", self.at) else None

    def quoted(self, mark: str) -> str:
        self.at += 1
        out = []
        while True:
            if self.at >= len(self.text):
                raise self.fail("the end of a string")
            c = self.text[self.at]
            self.at += 1
            if c == mark:
                return "".join(out)
            if c == "\\":
                c = self.text[self.at : self.at + 1]
                self.at += 1
                if c == "u":
                    c = chr(int(self.text[self.at : self.at + 4], 16))
                    self.at += 4
                elif c in _ESCAPES:
                    c = _ESCAPES[c]
                elif c not in (mark, "\\", "/"):
                    raise self.fail("an escape")
            out.append(c)

    def expr(self, level: int = 0) -> Any:
        if level == len(LEVELS):
            return self.unary()
        left = self.expr(level + 1)
        while op := self.operator(LEVELS[level]):
            # exponents group to the right
            right = self.expr(level if op == "^" else level + 1)
            left = A.Call(LEVELS[level][op], (left, right))
        return left

    def operator(self, level: dict[str, str]) -> str | None:
        self.skip()
        for op in _OPS:
            if self.text.startswith(op, self.at):
                if op in level and not (op == "-" and self.text.startswith("->", self.at)):
                    self.at += len(op)
                    return op
                return None
        return None

    def unary(self) -> Any:
        if self.peek("-") and not self.peek("->"):
            self.need("-")
            inner = self.unary()
            if isinstance(inner, A.Lit) and isinstance(inner.value, int | float) and not isinstance(inner.value, bool):
                return A.Lit(-inner.value)
            return A.Call("minus", (inner,))
        if self.peek("!") and not self.peek("!="):
            self.need("!")
            return A.Call("negate", (self.unary(),))
        out = self.term()
        while self.take("->"):
            out = A.Call("maybe_get", (out, self.term()))
        return out

    def term(self) -> Any:
        self.skip()
        text = self.string()
        if text is not None:
            return A.Lit(text)
        if self.text.startswith("$", self.at):
            self.at += 1
            name = self.name(re.compile(r"[\w.]+"), "a parameter")
            if name not in self.params:
                raise A.ScriptError(f"parameter {name} is not given")
            return literal(self.params[name])
        if (number := self.match(_NUMBER)) is not None:
            return A.Lit(as_number(number))
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.take("["):
            return A.ListOf(self.many("]", self.expr))
        if self.take("{"):
            return A.ObjectOf(self.many("}", self.pair))
        for word, value in (("null", None), ("true", True), ("false", False)):
            if self.take(word):
                return A.Lit(value)
        name = self.name(_VAR, "an expression")
        if re.fullmatch(_IDENT, name) and self.take("("):
            return self.call(name, self.many(")", self.expr))
        return A.Var(self.fresh() if name == "_" else name)

    def pair(self) -> tuple:
        key = self.expr()
        self.need(":")
        return key, self.expr()

    def fresh(self) -> str:
        self.wild += 1
        return f"_{self.wild}_"

    def call(self, name: str, args: tuple) -> Any:
        if name == "if":
            if len(args) not in (2, 3):
                raise A.ScriptError("if takes two or three arguments")
            name, args = "cond", (*args[:2], A.Lit(True), args[2] if len(args) == 3 else A.Lit(None))
        if name == "cond":
            if len(args) % 2:
                args = (*args[:-1], A.Lit(True), args[-1])
            return A.Call("cond", args)
        return A.Call(name, args)

    # --- atoms ---------------------------------------------------------------------

    def body(self, ends: tuple[str, ...]) -> Any:
        out = []
        while not self.done() and not any(self.peek(e) for e in ends):
            out.append(self.disjunction())
            if not self.take(","):
                break
        return A.All(tuple(out))

    def disjunction(self) -> Any:
        branches = [self.atom()]
        while self.take("or"):
            branches.append(self.atom())
        return branches[0] if len(branches) == 1 else A.Any_(tuple(branches))

    def atom(self) -> Any:
        if self.take("not"):
            return A.Not(self.atom())
        if self.peek("*"):
            return self.stored()
        if self.peek("~"):
            return self.search()
        for rule in (self.rule_atom, self.unify, self.test):
            if (found := self.attempt(rule)) is not None:
                return found
        if self.take("("):
            inner = self.body((")",))
            self.need(")")
            return inner
        raise self.fail("a condition")

    def rule_atom(self) -> Any:
        name = self.name(_NAME, "a rule")
        self.need("[")
        return A.RuleAtom(name, self.many("]", self.expr))

    def validity(self) -> Any:
        return self.expr() if self.take("@") else None

    def with_validity(self, end: str, item: Callable[[], Any]) -> tuple[tuple, Any]:
        out = []
        while not self.peek(end) and not self.peek("@"):
            out.append(item())
            if not self.take(","):
                break
        at = self.validity()
        self.need(end)
        return tuple(out), at

    def named_pair(self) -> tuple:
        name = self.name(_NAME, "a column")
        return name, self.expr() if self.take(":") else A.Var(name)

    def stored(self) -> Any:
        self.need("*")
        name = self.name(_STORED, "a relation")
        if self.take("["):
            args, at = self.with_validity("]", self.expr)
            return A.StoredAtom(name, args, None, at)
        self.need("{")
        named, at = self.with_validity("}", self.named_pair)
        return A.StoredAtom(name, None, named, at)

    def search(self) -> Any:
        self.need("~")
        name = self.name(_STORED, "a search index")
        relation, _, index = name.partition(":")
        self.need("{")
        named = []
        while not self.take("|"):
            named.append(self.named_pair())
            if not self.take(","):
                self.need("|")
                break
        return A.SearchAtom(relation, index, tuple(named), self.many("}", self.option_pair))

    def option_pair(self) -> tuple:
        name = self.name(_IDENT, "an option")
        self.need(":")
        return name, self.expr()

    def unify(self) -> Any:
        var = self.name(_VAR, "a variable")
        if var == "_":
            var = self.fresh()
        if self.take("in"):
            return A.Unify(var, self.expr(), True)
        if self.peek("=="):
            raise self.fail("=")
        self.need("=")
        return A.Unify(var, self.expr())

    def test(self) -> Any:
        return A.Test(self.expr())

    # --- rules ---------------------------------------------------------------------

    def head(self) -> tuple[str, tuple]:
        name = "?" if self.take("?") else self.name(_IDENT, "a rule head")
        self.need("[")
        return name, self.many("]", self.head_arg)

    def head_arg(self) -> A.HeadArg:
        name = self.name(_VAR, "a head variable")
        if not self.take("("):
            return A.HeadArg(name)
        var = self.name(_VAR, "a variable")
        extra = self.many(")", self.expr) if self.take(",") else ()
        if not extra and self.text[self.at - 1] != ")":
            self.need(")")
        return A.HeadArg(var, name, extra)

    def rule(self) -> Any:
        name, head = self.head()
        if self.take(":="):
            out: Any = A.Rule(name, head, self.body((";", "}", ":=", ":limit")))
        elif self.take("<-"):
            out = A.ConstRule(name, head, self.expr())
        else:
            self.need("<~")
            algorithm = self.name(_DOTTED, "an algorithm")
            self.need("(")
            args = self.many(")", self.fixed_arg)
            inputs = tuple(a for a in args if isinstance(a, A.FixedInput))
            out = A.FixedRule(name, head, algorithm, inputs, tuple(a for a in args if not isinstance(a, A.FixedInput)))
        self.take(";")
        return out

    def binding(self) -> tuple:
        name = self.name(_IDENT, "a column")
        return name, self.name(_IDENT, "a variable") if self.take(":") else name

    def fixed_arg(self) -> Any:
        if self.take("*"):
            name = self.name(_STORED, "a relation")
            if self.take("["):
                args, at = self.with_validity("]", lambda: self.name(_VAR, "a variable"))
                return A.FixedInput(name, True, args, False, at)
            self.need("{")
            named, at = self.with_validity("}", self.binding)
            return A.FixedInput(name, True, named, True, at)
        name = self.name(_IDENT, "an input or an option")
        if self.take("["):
            return A.FixedInput(name, False, self.many("]", lambda: self.name(_VAR, "a variable")))
        self.need(":")
        return name, self.expr()

    # --- options -------------------------------------------------------------------

    def constant(self) -> Any:
        return fold(self.expr())

    def option(self, options: A.Options) -> None:
        self.need(":")
        word = self.name(_NAME, "an option")
        if word == "limit":
            options.limit = int(self.constant())
        elif word == "offset":
            options.offset = int(self.constant())
        elif word in ("order", "sort"):
            while True:
                down = self.take("-")
                if not down:
                    self.take("+")
                var = self.name(_VAR, "a sort key")
                if self.take("("):
                    var = f"{var}({self.name(_VAR, 'a variable')})"
                    self.need(")")
                options.order.append((var, down))
                if not self.take(","):
                    break
        elif word == "assert":
            options.assertion = "none" if self.take("none") else "some"
            if options.assertion == "some":
                self.need("some")
        elif word == "timeout":
            options.timeout = float(self.constant())
        elif word == "sleep":
            options.sleep = float(self.constant())
        elif word == "returning":
            options.returning = True
        elif word == "disable_magic_rewrite":
            options.magic = not self.constant()
        elif word in STORE_OPS:
            name = self.name(_STORED, "a relation")
            options.store = A.Store(word, name, self.schema() if self.take("{") else None)
        else:
            raise self.fail("a known option")
        self.take(";")

    def schema(self) -> A.Schema:
        groups: list[list[A.Column]] = [[]]
        while not self.take("}"):
            if self.take("=>"):
                groups.append([])
                continue
            groups[-1].append(self.column())
            self.take(",")
        if len(groups) > 2:
            raise self.fail("one => at most")
        return A.Schema(tuple(groups[0]), tuple(groups[1]) if len(groups) == 2 else ())

    def column(self) -> A.Column:
        name = self.name(_IDENT, "a column")
        kind = self.type() if self.take(":") else None
        if self.take("default"):
            return A.Column(name, kind, self.expr())
        if self.peek("=") and not self.peek("=>"):
            self.need("=")
            var = self.name(_VAR, "a variable")
            if self.take("("):
                var = f"{var}({self.name(_VAR, 'a variable')})"
                self.need(")")
            return A.Column(name, kind, None, var)
        return A.Column(name, kind)

    def type(self) -> tuple:
        """(kind, parameters, nullable)."""
        if self.take("["):
            inner, size = self.type(), None
            if self.take(";"):
                size = self.constant()
            self.need("]")
            kind: tuple = ("List", (inner, size))
        elif self.take("("):
            kind = ("Tuple", self.many(")", self.type))
        elif self.take("<"):
            element = self.name(_IDENT, "an element type")
            self.need(";")
            kind = ("Vec", ("F64" if element in ("F64", "Double") else "F32", int(self.name(_NUMBER, "a length"))))
            self.need(">")
        else:
            word = self.name(_IDENT, "a type")
            if word not in ("Any", "Bool", "Int", "Float", "String", "Bytes", "Uuid", "Json", "Validity"):
                raise self.fail("a known type")
            kind = (word, ())
        return (*kind, self.take("?"))

    # --- scripts -------------------------------------------------------------------

    def program(self, end: str | None = None) -> A.Program:
        out = A.Program([], A.Options())
        while not self.done() and not (end and self.peek(end)):
            if self.peek(":") and not self.peek("::"):
                self.option(out.options)
            else:
                out.rules.append(self.rule())
        return out

    def script(self) -> Any:
        if self.peek("::"):
            out: Any = self.sysop()
        elif self.peek("%") or self.peek("{"):
            out = self.statements(())
        else:
            out = self.program()
        if not self.done():
            raise self.fail("the end")
        return out

    def sysop(self) -> A.SysOp:
        self.need("::")
        op = self.name(_IDENT, "a system operation")
        stored = lambda: self.name(_STORED, "a relation")
        if op in ("relations", "running", "compact", "fixed_rules"):
            return A.SysOp(op)
        if op in ("columns", "indices", "show_triggers"):
            return A.SysOp(op, (stored(),))
        if op == "describe":
            return A.SysOp(op, (stored(), self.string()))
        if op == "kill":
            return A.SysOp(op, (self.constant(),))
        if op == "explain":
            self.need("{")
            inner = self.program("}")
            self.need("}")
            return A.SysOp(op, (inner,))
        if op == "remove":
            return A.SysOp(op, self.list_of(stored))
        if op == "rename":
            return A.SysOp(op, self.list_of(lambda: (stored(), self.need("->"), stored())[::2]))
        if op == "access_level":
            level = self.name(_IDENT, "an access level")
            return A.SysOp(op, (level, self.list_of(stored)))
        if op == "set_triggers":
            relation, triggers = stored(), []
            while self.take("on"):
                event = self.name(_IDENT, "an event")
                if event not in ("put", "rm", "replace"):
                    raise self.fail("put, rm or replace")
                self.need("{")
                start = self.at
                self.program("}")
                triggers.append((event, self.text[start : self.at]))
                self.need("}")
            return A.SysOp(op, (relation, tuple(triggers)))
        if op in ("index", "hnsw", "fts", "lsh"):
            create = self.take("create")
            if not create:
                self.need("drop")
            relation, _, index = stored().partition(":")
            if not create:
                return A.SysOp("drop_index", (relation, index))
            self.need("{")
            if op == "index":
                return A.SysOp("create_index", (relation, index, "normal", self.many("}", lambda: self.name(_IDENT, "a column"))))
            return A.SysOp("create_index", (relation, index, op, self.many("}", self.option_pair)))
        raise self.fail("a known system operation")

    def list_of(self, item: Callable[[], Any]) -> tuple:
        out = [item()]
        while self.take(","):
            out.append(item())
        return tuple(out)

    # --- imperative ----------------------------------------------------------------

    def statements(self, ends: tuple[str, ...]) -> tuple:
        out = []
        while not self.done() and not any(self.peek(e) for e in ends):
            out.append(self.statement())
        return tuple(out)

    def block(self) -> A.Run:
        self.need("{")
        inner: Any = self.sysop() if self.peek("::") else self.program("}")
        self.need("}")
        return A.Run(inner, self.name(_NAME, "a temporary relation") if self.take("as") else None)

    def condition(self) -> Any:
        return self.block() if self.peek("{") else self.name(_NAME, "a relation")

    def statement(self) -> Any:
        if self.peek("{"):
            return self.block()
        for word in ("%break", "%continue"):
            if self.take(word):
                return A.Jump(word[1:], self.match(_IDENT))
        if self.take("%return"):
            items: list = []
            while self.peek("{") or self.match_ahead(_NAME):
                items.append(self.condition())
                if not self.take(","):
                    break
            return A.Return(tuple(items))
        if self.take("%debug"):
            return A.Debug(self.name(_NAME, "a relation"))
        if self.take("%ignore_error"):
            run = self.block()
            return A.Run(run.program, run.into, True)
        if self.take("%swap"):
            return A.Swap(self.name(_NAME, "a relation"), self.name(_NAME, "a relation"))
        for word in ("%if_not", "%if"):
            if self.take(word):
                condition = self.condition()
                self.take("%then")
                then = self.statements(("%else", "%end"))
                otherwise = self.statements(("%end",)) if self.take("%else") else ()
                self.need("%end")
                return A.If(condition, word == "%if_not", then, otherwise)
        label = self.name(_IDENT, "a label") if self.take("%mark") else None
        self.need("%loop")
        inner = self.statements(("%end",))
        self.need("%end")
        return A.Loop(label, inner)

    def match_ahead(self, pattern: re.Pattern) -> bool:
        self.skip()
        return pattern.match(self.text, self.at) is not None


def as_number(text: str) -> int | float:
    plain = text.replace("_", "")
    if plain[:2] in ("0x", "0o", "0b"):
        return int(plain, 0)
    return float(plain) if re.search(r"[.eE]", plain) else int(plain)


def literal(value: Any) -> Any:
    """A Python value as an expression."""
    if isinstance(value, list | tuple):
        return A.ListOf(tuple(map(literal, value)))
    if isinstance(value, dict):
        return A.ObjectOf(tuple((A.Lit(k), literal(v)) for k, v in value.items()))
    return A.Lit(value)


def fold(e: Any) -> Any:
    """The Python value of a constant expression (an option or a literal row)."""
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.ListOf):
        return [fold(x) for x in e.items]
    if isinstance(e, A.ObjectOf):
        return {fold(k): fold(v) for k, v in e.pairs}
    from spindrel.functions.folding import evaluate

    if A.variables(e):
        raise A.ScriptError(f"{', '.join(sorted(A.variables(e)))} cannot be used in a constant")
    return evaluate(e)


def parse(text: str, params: dict[str, Any] | None = None) -> Any:
    return Parser(text, params).script()
