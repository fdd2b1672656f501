"""The imperative layer: blocks, loops and conditions over temporary relations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from spindrel.plans import ast as A
from spindrel.sources.durable import written

MAX_LOOPS = 100_000


class Leave(Exception):
    """A break, continue or return on its way out."""

    def __init__(self, kind: str, label: str | None = None, value: DataFrame | None = None):
        self.kind, self.label, self.value = kind, label, value


class Interpreter:
    def __init__(self, session: Any, immutable: bool):
        self.session, self.immutable = session, immutable
        self.temporary: dict[str, DataFrame] = {}
        self.last: DataFrame | None = None
        self.debugged: list[tuple[str, DataFrame]] = []

    def run(self, statements: tuple) -> DataFrame:
        try:
            self.block(statements)
        except Leave as leave:
            if leave.kind == "return":
                return leave.value if leave.value is not None else self.session.status("OK")
            raise A.ScriptError(f"{leave.kind} outside a loop") from leave
        return self.last if self.last is not None else self.session.status("OK")

    def block(self, statements: tuple) -> None:
        for s in statements:
            self.statement(s)

    def statement(self, s: Any) -> None:
        if isinstance(s, A.Run):
            try:
                self.last = self.execute(s)
            except Exception:
                if not s.ignore_error:
                    raise
        elif isinstance(s, A.If):
            self.block(s.then if self.truth(s.condition) != s.negated else s.otherwise)
        elif isinstance(s, A.Loop):
            self.loop(s)
        elif isinstance(s, A.Jump):
            raise Leave(s.kind, s.label)
        elif isinstance(s, A.Return):
            raise Leave("return", None, self.returned(s.items))
        elif isinstance(s, A.Swap):
            left, right = self.named(s.left), self.named(s.right)
            self.temporary[s.left], self.temporary[s.right] = right, left
        elif isinstance(s, A.Debug):
            self.debugged.append((s.name, self.named(s.name)))
            print(f"{s.name}:")
            self.named(s.name).show(truncate=False)

    def execute(self, s: A.Run) -> DataFrame:
        if isinstance(s.program, A.SysOp):
            from spindrel.sysops import run_sysop

            out = run_sysop(self.session, s.program, self.immutable)
        elif s.ignore_error:
            with self.session.transaction():
                out = self.session.program(s.program, self.temporary, self.immutable)
        else:
            out = self.session.program(s.program, self.temporary, self.immutable)
        # later statements may change what the rows depend on
        if s.into or not isinstance(s.program, A.SysOp):
            out, _ = written(out)
        if s.into:
            self.temporary[s.into] = out
        return out

    def named(self, name: str) -> DataFrame:
        if name in self.temporary:
            return self.temporary[name]
        return self.session.catalog.readable(name).frame()

    def truth(self, condition: Any) -> bool:
        """A relation is true if its first row's last value is, or it has rows without a truth value."""
        df = self.named(condition) if isinstance(condition, str) else self.execute(condition)
        row = df.first()
        if row is None:
            return False
        value = row[len(row) - 1]
        return bool(value) if value is None or isinstance(value, bool | int | float | str | list) else True

    def loop(self, s: A.Loop) -> None:
        for _ in range(MAX_LOOPS):
            try:
                self.block(s.body)
            except Leave as leave:
                if leave.kind == "return" or (leave.label is not None and leave.label != s.label):
                    raise
                if leave.kind == "break":
                    return
        raise A.ScriptError(f"a loop ran {MAX_LOOPS} times")

    def returned(self, items: tuple) -> DataFrame | None:
        frames = [self.named(i) if isinstance(i, str) else self.execute(i) for i in items]
        if not frames:
            return None
        self.session.last_results = frames
        return frames[0]
