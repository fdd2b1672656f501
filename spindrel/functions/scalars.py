"""The scalar functions: each builds a Spark column from typed arguments.

Everything that Spark's built-ins can express stays in the JVM; byte-wise logic, JSON
path edits and Unicode work use Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.functions import udfs as U
from spindrel.plans.ast import ScriptError

VALIDITY = T.StructType([T.StructField("ts", T.LongType()), T.StructField("is_assert", T.BooleanType())])


@dataclass
class Typed:
    """A column with its type; ``json`` marks text that holds a JSON value."""

    col: Column
    type: T.DataType
    json: bool = False
    constant: Any = None

    @property
    def int(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def num(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.type, T.StringType) and not self.json

    @property
    def bytes(self) -> bool:
        return isinstance(self.type, T.BinaryType)

    @property
    def list(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def vec(self) -> bool:
        return self.list and isinstance(self.type.elementType, T.FloatType)

    @property
    def tuple(self) -> bool:
        return isinstance(self.type, T.StructType) and self.type.fieldNames()[:1] == ["_0"]

    @property
    def validity(self) -> bool:
        return isinstance(self.type, T.StructType) and self.type.fieldNames() == ["ts", "is_assert"]


@dataclass
class Json:
    """Marks a result as JSON text."""

    col: Column


Builder = Callable[..., Column | Json]
REGISTRY: dict[str, tuple[int, int | None, Builder]] = {}


def function(name: str, least: int, most: int | None = -1):
    """Register a builder; ``most`` None is any number, -1 the same as ``least``."""

    def add(builder: Builder) -> Builder:
        REGISTRY[name] = (least, least if most == -1 else most, builder)
        return builder

    return add


#: Functions that users have added.
ADDED: set[str] = set()


def add_function(name: str, arity: int, builder: Callable[..., Column]) -> None:
    """A function of so many columns, from then on known to all sessions of this process."""
    if name in REGISTRY and name not in ADDED:
        raise ScriptError(f"function {name} exists already")
    REGISTRY[name] = (arity, arity, lambda *args: builder(*[a.col for a in args]))
    ADDED.add(name)


def drop_function(name: str) -> bool:
    if name not in ADDED:
        return False
    ADDED.remove(name)
    del REGISTRY[name]
    return True


def build(name: str, args: list[Typed]) -> Column | Json:
    if name not in REGISTRY:
        raise ScriptError(f"no function {name}")
    least, most, builder = REGISTRY[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise ScriptError(f"{name} does not take {len(args)} arguments")
    return builder(*args)


def fail(name: str, *args: Typed) -> ScriptError:
    return ScriptError(f"{name} cannot be applied to {', '.join(a.type.simpleString() for a in args)}")


def raised(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def dbl(a: Typed) -> Column:
    return a.col.cast("double")


def constant(a: Typed, what: str) -> Any:
    if a.constant is None:
        raise ScriptError(f"{what} must be a constant")
    return a.constant


NAN, INF = F.lit, F.lit


def nan() -> Column:
    return F.lit(float("nan"))


def inf(sign: int = 1) -> Column:
    return F.lit(sign * math.inf)


# --- comparison, boolean, null ------------------------------------------------------


def comparable(name: str, a: Typed, b: Typed) -> None:
    same = (a.num and b.num) or a.type.simpleString() == b.type.simpleString() or a.null or b.null
    if not same and not (isinstance(a.type, T.DatetimeType) or isinstance(b.type, T.DatetimeType)):
        raise fail(name, a, b)


def _equal(a: Typed, b: Typed) -> Column:
    if a.null or b.null or (a.num and b.num) or type(a.type) is type(b.type) or isinstance(a.type, T.DatetimeType) or isinstance(b.type, T.DatetimeType):
        return a.col.eqNullSafe(b.col)
    return F.lit(False)


@function("eq", 2)
def _eq(a, b):
    return _equal(a, b)


@function("neq", 2)
def _neq(a, b):
    return ~_equal(a, b)


def _order(name: str, compare: Callable[[Column, Column], Column]) -> None:
    @function(name, 2)
    def op(a, b):
        comparable(name, a, b)
        return compare(a.col, b.col)


_order("gt", lambda a, b: a > b)
_order("ge", lambda a, b: a >= b)
_order("lt", lambda a, b: a < b)
_order("le", lambda a, b: a <= b)


def _logic(name: str, empty: bool, join: Callable[[Column, Column], Column]) -> None:
    @function(name, 0, None)
    def op(*args):
        out = F.lit(empty)
        for i, a in enumerate(args):
            if not a.bool and not a.null:
                raise fail(name, a)
            out = a.col if i == 0 else join(out, a.col)
        return out


_logic("and", True, lambda a, b: a & b)
_logic("or", False, lambda a, b: a | b)


@function("negate", 1)
def _negate(a):
    if not a.bool:
        raise fail("negate", a)
    return ~a.col


@function("coalesce", 0, None)
def _coalesce(*args):
    real = [a for a in args if not a.null]
    if not real:
        return F.lit(None)
    out = F.coalesce(*[a.col for a in real])
    return Json(out) if any(a.json for a in real) else out


@function("is_in", 2)
def _is_in(a, b):
    if not b.list:
        raise fail("is_in", a, b)
    if isinstance(b.type.elementType, T.NullType):
        return F.when(F.size(b.col) > 0, a.col.isNull()).otherwise(False)
    if a.null:
        return F.exists(b.col, lambda x: x.isNull())
    return F.when(a.col.isNull(), F.exists(b.col, lambda x: x.isNull())).otherwise(F.exists(b.col, lambda x: x.eqNullSafe(a.col)))


@function("is_null", 1)
def _is_null(a):
    return a.col.isNull()


@function("assert", 1, None)
def _assert(a, *rest):
    return F.when(a.col, F.lit(True)).otherwise(raised("assertion failed", "boolean"))


@function("cond", 2, None)
def _cond(*args):
    # the clauses are pairs; without a true one the value is null
    out = None
    for test, value in zip(args[::2], args[1::2], strict=True):
        if not test.bool and not test.null:
            raise fail("cond", test)
        out = F.when(test.col, value.col) if out is None else out.when(test.col, value.col)
    return Json(out) if any(v.json for v in args[1::2]) else out


# --- arithmetic ---------------------------------------------------------------------


def _vector(name: str, a: Typed, b: Typed, op: Callable[[Column, Column], Column]) -> Column:
    if a.list and b.list:
        return F.zip_with(a.col, b.col, op)
    if a.list and b.num:
        return F.transform(a.col, lambda x: op(x, b.col.cast(a.type.elementType)))
    if b.list and a.num:
        return F.transform(b.col, lambda x: op(a.col.cast(b.type.elementType), x))
    raise fail(name, a, b)


def _arithmetic(name: str, empty: int, op: Callable[[Column, Column], Column]) -> None:
    @function(name, 0, None)
    def nary(*args):
        if not args:
            return F.lit(empty).cast("long")
        out = args[0]
        for b in args[1:]:
            if out.num and b.num:
                wide = T.LongType() if out.int and b.int else T.DoubleType()
                out = Typed(op(out.col.cast(wide), b.col.cast(wide)), wide)
            else:
                col = _vector(name, out, b, op)
                out = Typed(col, out.type if out.list else b.type)
        return out.col


_arithmetic("add", 0, lambda a, b: a + b)
_arithmetic("mul", 1, lambda a, b: a * b)


@function("sub", 2)
def _sub(a, b):
    if a.num and b.num:
        return a.col.cast("long") - b.col.cast("long") if a.int and b.int else dbl(a) - dbl(b)
    return _vector("sub", a, b, lambda x, y: x - y)


def _divide(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.when(y != 0, x / y).when(F.isnan(x) | (x == 0), nan()).when(x.isNull() | y.isNull(), None).when(x > 0, inf()).otherwise(inf(-1))


@function("div", 2)
def _div(a, b):
    if a.num and b.num:
        return _divide(a.col, b.col)
    return _vector("div", a, b, _divide)


@function("minus", 1)
def _minus(a):
    return F.transform(a.col, lambda x: -x) if a.list else -a.col


@function("abs", 1)
def _abs(a):
    return F.abs(a.col)


@function("signum", 1)
def _signum(a):
    if a.int:
        return F.signum(a.col).cast("long")
    # a negative zero counts as negative, and NaN stays
    negative = (a.col < 0) | ((a.col == 0) & F.startswith(a.col.cast("string"), F.lit("-")))
    return F.when(F.isnan(a.col), nan()).when(negative, -1.0).when(a.col == 0, 0.0).otherwise(1.0)


for _name, _f in (("floor", F.floor), ("ceil", F.ceil), ("round", lambda c: F.round(c, 0))):

    @function(_name, 1)
    def _rounded(a, f=_f):
        # beyond 2^53 doubles are whole already, and beyond 2^63 floor would overflow
        return a.col if a.int else F.when(F.abs(a.col) < 2.0**53, f(a.col).cast("double")).otherwise(a.col)


@function("mod", 2)
def _mod(a, b):
    if a.int and b.int:
        return a.col % b.col
    x, y = dbl(a), dbl(b)
    return F.when(y != 0, x % y).when(x.isNull() | y.isNull(), None).otherwise(nan())


for _name, _f in (("max", F.greatest), ("min", F.least)):

    @function(_name, 1, None)
    def _extreme(*args, f=_f, name=_name):
        if not all(a.num for a in args):
            raise fail(name, *args)
        if len(args) == 1:
            return args[0].col
        known = args[0].col.isNotNull()
        for a in args[1:]:
            known = known & a.col.isNotNull()
        return F.when(known, f(*[a.col for a in args])).otherwise(raised(f"{name} of null", "double"))


@function("pow", 2)
def _pow(a, b):
    if a.list and b.num:
        return F.transform(a.col, lambda x: F.pow(x, b.col).cast(a.type.elementType))
    return F.pow(dbl(a), dbl(b))


def _logarithm(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, f(x)).when(x == 0, inf(-1)).when(x.isNull(), None).otherwise(nan())


for _name, _f in {
    "sqrt": F.sqrt, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "ln": _logarithm(F.ln), "log2": _logarithm(F.log2),
    "log10": _logarithm(F.log10), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh,
    "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg_to_rad": F.radians, "rad_to_deg": F.degrees,
}.items():

    @function(_name, 1)
    def _math(a, f=_f):
        return F.transform(a.col, lambda x: f(x.cast("double")).cast(a.type.elementType)) if a.list else f(dbl(a))


@function("atan2", 2)
def _atan2(a, b):
    return F.atan2(dbl(a), dbl(b))


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(half))


@function("haversine", 4)
def _hav(a, b, c, d):
    return _haversine(*map(dbl, (a, b, c, d)))


@function("haversine_deg_input", 4)
def _hav_deg(a, b, c, d):
    return _haversine(*(F.radians(dbl(x)) for x in (a, b, c, d)))


# --- strings ------------------------------------------------------------------------

SPACE = r"\p{IsWhite_Space}"


@function("length", 1)
def _length(a):
    if a.tuple:
        return F.lit(len(a.type.fieldNames())).cast("long")
    if a.list:
        return F.size(a.col).cast("long")
    return (F.octet_length(a.col) if a.bytes else F.length(a.col)).cast("long")


@function("concat", 1, None)
def _concat(*args):
    if all(a.text for a in args) or all(a.list for a in args):
        return F.concat(*[a.col for a in args])
    if any(a.json for a in args):
        return Json(U.json_merge(*[as_json(a) for a in args]))
    raise fail("concat", *args)


@function("str_includes", 2)
def _includes(a, b):
    return F.contains(a.col, b.col)


for _name, _f in {
    "lowercase": F.lower, "uppercase": F.upper,
    "trim": lambda c: F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", ""),
    "trim_start": lambda c: F.regexp_replace(c, rf"\A{SPACE}+", ""),
    "trim_end": lambda c: F.regexp_replace(c, rf"{SPACE}+\z", ""),
}.items():

    @function(_name, 1)
    def _texted(a, f=_f, name=_name):
        if not a.text:
            raise fail(name, a)
        return f(a.col)


@function("starts_with", 2)
def _starts(a, b):
    return F.startswith(a.col, b.col)


@function("ends_with", 2)
def _ends(a, b):
    return F.endswith(a.col, b.col)


@function("chars", 1)
def _chars(a):
    return F.filter(F.split(a.col, ""), lambda c: c != "")


@function("slice_string", 3)
def _slice_string(a, b, c):
    return F.substr(a.col, (b.col + 1).cast("int"), (c.col - b.col).cast("int"))


@function("from_substrings", 1)
def _joined(a):
    return F.array_join(a.col, "")


@function("unicode_normalize", 2)
def _normalize(a, b):
    return U.normalize(constant(b, "a normal form"))(a.col)


@function("t2s", 1)
def _t2s(a):
    return F.translate(a.col, U.TRADITIONAL, U.SIMPLIFIED) if a.text else a.col


@function("regex_matches", 2)
def _matches(a, b):
    return F.rlike(a.col, b.col)


@function("regex_replace", 3)
def _replace_first(a, b, c):
    return U.replace_first(a.col, b.col, c.col)


@function("regex_replace_all", 3)
def _replace_all(a, b, c):
    return F.regexp_replace(a.col, b.col, F.regexp_replace(c.col, r"\$\{(\w+)\}", r"\$$1"))


@function("regex_extract", 2)
def _extract(a, b):
    return F.regexp_extract_all(a.col, b.col, F.lit(0))


@function("regex_extract_first", 2)
def _extract_first(a, b):
    return F.regexp_substr(a.col, b.col)


# --- bytes --------------------------------------------------------------------------

for _name in ("bit_and", "bit_or", "bit_xor"):

    @function(_name, 2)
    def _bits(a, b, name=_name):
        return U.bitwise(name)(a.col, b.col)


@function("bit_not", 1)
def _bit_not(a):
    return U.bit_not(a.col)


@function("pack_bits", 1)
def _pack(a):
    return U.pack_bits(a.col)


@function("unpack_bits", 1)
def _unpack(a):
    return U.unpack_bits(a.col)


@function("encode_base64", 1)
def _encode64(a):
    return F.translate(F.base64(a.col), "\r\n", "")


@function("decode_base64", 1)
def _decode64(a):
    return F.unbase64(a.col)


# --- lists --------------------------------------------------------------------------


@function("list", 0, None)
def _list(*args):
    if not args:
        return F.array()
    kinds = {a.type.simpleString() for a in args if not a.null}
    if len(kinds) <= 1 and not any(a.json for a in args):
        return F.array(*[a.col for a in args])
    if all(a.num or a.null for a in args):
        wide = "bigint" if all(a.int or a.null for a in args) else "double"
        return F.array(*[a.col.cast(wide) for a in args])
    if any(a.json for a in args):
        return Json(F.concat(F.lit("["), F.array_join(F.array(*[as_json(a) for a in args]), ","), F.lit("]")))
    # really mixed: a tuple, whose elements keep their types
    return F.struct(*[a.col.alias(f"_{i}") for i, a in enumerate(args)])


def element(t: Typed, i: int, strict: bool) -> Column:
    """Element i of a tuple."""
    names = t.type.fieldNames()
    if not -len(names) <= i < len(names):
        if strict:
            raise ScriptError("index out of range")
        return F.lit(None)
    return t.col[names[i]]


@function("append", 2)
def _append(a, b):
    return F.array_append(a.col, b.col)


@function("prepend", 2)
def _prepend(a, b):
    return F.array_prepend(a.col, b.col)


@function("first", 1)
def _first(a):
    if a.tuple:
        return element(a, 0, False)
    return F.get(a.col, F.lit(0))


@function("last", 1)
def _last(a):
    if a.tuple:
        return element(a, -1, False)
    return F.try_element_at(a.col, F.lit(-1))


def _at(a: Typed, i: Typed) -> Column:
    return F.get(a.col, F.when(i.col < 0, F.size(a.col) + i.col).otherwise(i.col).cast("int"))


@function("get", 2, 3)
def _get(a, b, default=None):
    if a.tuple:
        return element(a, int(constant(b, "an index into a tuple")), default is None)
    if a.json:
        found = U.json_get(a.col, as_json(b))
        return Json(F.coalesce(found, as_json(default)) if default else F.coalesce(found, raised("no such element", "string")))
    index = F.when(b.col < 0, F.size(a.col) + b.col).otherwise(b.col)
    held = (index >= 0) & (index < F.size(a.col))
    missing = default.col if default else raised("index out of range", a.type.elementType.simpleString())
    return F.when(held, _at(a, b)).otherwise(missing)


@function("maybe_get", 2)
def _maybe_get(a, b):
    if a.tuple:
        return element(a, int(constant(b, "an index into a tuple")), False)
    return Json(U.json_get(a.col, as_json(b))) if a.json else _at(a, b)


@function("slice", 3)
def _slice(a, b, c):
    n = F.size(a.col)
    m, k = (F.when(x.col < 0, n + x.col).otherwise(x.col) for x in (b, c))
    held = (m >= 0) & (k <= n) & (m <= k)
    return F.when(held, F.slice(a.col, (m + 1).cast("int"), F.greatest(k - m, F.lit(0)).cast("int"))).otherwise(raised("slice out of range", a.type.simpleString()))


@function("sorted", 1)
def _sorted(a):
    return F.sort_array(a.col)


@function("reverse", 1)
def _reverse(a):
    if not a.list:
        raise fail("reverse", a)
    return F.reverse(a.col)


def _runs(a: Typed, starts: Column, n: Column) -> Column:
    return F.transform(starts, lambda i: F.slice(a.col, (i + 1).cast("int"), n.cast("int")))


def _empty_lists(a: Typed) -> Column:
    return F.array().cast(T.ArrayType(a.type))


@function("chunks", 2)
def _chunks(a, b):
    return F.when(F.size(a.col) > 0, _runs(a, F.sequence(F.lit(0), F.size(a.col) - 1, b.col.cast("int")), b.col)).otherwise(_empty_lists(a))


@function("chunks_exact", 2)
def _chunks_exact(a, b):
    return F.filter(_chunks(a, b), lambda x: F.size(x) == b.col)


@function("windows", 2)
def _windows(a, b):
    last = F.size(a.col) - b.col.cast("int")
    return F.when(last >= 0, _runs(a, F.sequence(F.lit(0), last), b.col)).otherwise(_empty_lists(a))


@function("int_range", 1, 3)
def _int_range(a, b=None, c=None):
    start, end = (F.lit(0).cast("long"), a.col.cast("long")) if b is None else (a.col.cast("long"), b.col.cast("long"))
    step = c.col.cast("long") if c else F.lit(1).cast("long")
    last = end - F.signum(step).cast("long")
    some = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    return F.when(some, F.sequence(start, last, step)).otherwise(F.array().cast("array<long>"))


def _set(name: str, f: Callable[[Column, Column], Column], least: int) -> None:
    @function(name, least, None)
    def op(*args):
        out = F.array_distinct(args[0].col)
        for a in args[1:]:
            out = f(out, a.col)
        return F.sort_array(out)


_set("union", F.array_union, 1)
_set("intersection", F.array_intersect, 1)
_set("difference", F.array_except, 2)


# --- vectors ------------------------------------------------------------------------


def vector(a: Typed, element: str) -> Column:
    if a.text:
        return U.decode_vector(element)(a.col)
    if not a.list:
        raise fail("vec", a)
    return a.col.cast(f"array<{element}>")


def _element(kind: Typed | None) -> str:
    return "double" if kind is not None and str(constant(kind, "an element type")) in ("F64", "Double") else "float"


@function("vec", 1, 2)
def _vec(a, kind=None):
    return vector(a, _element(kind))


@function("rand_vec", 1, 2)
def _rand_vec(a, kind=None):
    n = int(constant(a, "a vector length"))
    return F.array(*[F.rand().cast(_element(kind)) for _ in range(n)])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


@function("l2_normalize", 1)
def _l2_normalize(a):
    # the length stands once beside the vector, not inside the loop over it
    both = F.array(F.struct(a.col.alias("v"), F.sqrt(dot(a.col, a.col)).alias("n")))
    each = F.transform(both, lambda b: F.transform(b["v"], lambda x: _divide(x, b["n"]).cast(a.type.elementType)))
    return F.when(a.col.isNotNull(), F.get(each, F.lit(0)))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


@function("l2_dist", 2)
def _l2_dist(a, b):
    return l2(a.col, b.col)


@function("ip_dist", 2)
def _ip_dist(a, b):
    return 1 - dot(a.col, b.col)


def cosine(a: Column, b: Column) -> Column:
    return 1 - _divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


@function("cos_dist", 2)
def _cos_dist(a, b):
    return cosine(a.col, b.col)


# --- type tests and conversion ------------------------------------------------------


def _test(name: str, test: Callable[[Typed], bool]) -> None:
    @function(name, 1)
    def op(a):
        return F.lit(False) if not test(a) else a.col.isNotNull()


_test("is_int", lambda a: a.int)
_test("is_float", lambda a: a.num and not a.int)
_test("is_num", lambda a: a.num)
_test("is_string", lambda a: a.text)
_test("is_list", lambda a: a.list and not a.vec)
_test("is_vec", lambda a: a.vec)
_test("is_bytes", lambda a: a.bytes)
_test("is_json", lambda a: a.json)


@function("is_uuid", 1)
def _is_uuid(a):
    return F.rlike(a.col, F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")) if a.text else F.lit(False)


@function("is_nan", 1)
def _is_nan(a):
    return F.isnan(a.col) if a.num else F.lit(False)


@function("is_infinite", 1)
def _is_infinite(a):
    return F.coalesce(F.abs(dbl(a)) == inf(), F.lit(False)) if a.num else F.lit(False)


@function("is_finite", 1)
def _is_finite(a):
    return F.coalesce(~F.isnan(dbl(a)) & (F.abs(dbl(a)) != inf()), F.lit(False)) if a.num else F.lit(False)


def _truth(a: Typed) -> Column:
    if a.null:
        return F.lit(False)
    if a.bool:
        held = a.col
    elif a.num:
        held = a.col != 0
    elif a.list:
        held = F.size(a.col) > 0
    elif a.validity:
        held = a.col["is_assert"]
    elif a.bytes:
        held = F.octet_length(a.col) > 0
    else:
        held = F.length(a.col) > 0
    return F.coalesce(held, F.lit(False))


@function("to_bool", 1)
def _to_bool(a):
    return _truth(a)


@function("to_unity", 1)
def _to_unity(a):
    return _truth(a).cast("long")


@function("to_int", 1)
def _to_int(a):
    if a.null:
        return F.lit(0).cast("long")
    if a.validity:
        return a.col["ts"]
    return F.coalesce(a.col.cast("long"), F.lit(0).cast("long"))


#: Names of numbers that a string may spell.
NAMED = {"PI": math.pi, "E": math.e, "NAN": math.nan, "INF": math.inf, "NEG_INF": -math.inf}


@function("to_float", 1)
def _to_float(a):
    if a.null:
        return F.lit(0.0)
    if a.text:
        out = F.when(a.col.isNull(), 0.0)
        for name, value in NAMED.items():
            out = out.when(a.col == name, value)
        return out.otherwise(a.col.cast("double"))
    return F.coalesce(a.col.cast("double"), F.lit(0.0))


@function("to_string", 1)
def _to_string(a):
    return a.col if a.text or a.json else as_json(a)


@function("to_uuid", 1)
def _to_uuid(a):
    text = F.lower(F.translate(a.col, "{}", ""))
    plain = F.regexp_replace(F.regexp_replace(text, "^urn:uuid:", ""), "-", "")
    shaped = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.rlike(plain, F.lit("^[0-9a-f]{32}$")), shaped).otherwise(raised("not a UUID", "string"))


# --- JSON ---------------------------------------------------------------------------


def as_json(a: Typed) -> Column:
    """The canonical JSON text of a value."""
    if a.json:
        return a.col
    if a.null:
        return F.lit("null")
    if a.text:
        return U.quote(a.col)
    if a.num or a.bool:
        return F.coalesce(a.col.cast("string"), F.lit("null"))
    if a.bytes:
        return U.quote(F.translate(F.base64(a.col), "\r\n", ""))
    if a.tuple:
        parts = [as_json(Typed(a.col[f.name], f.dataType)) for f in a.type]
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.coalesce(F.to_json(a.col, {"ignoreNullFields": "false"}), F.lit("null"))


@function("json", 1)
def _json(a):
    return Json(as_json(a))


@function("parse_json", 1)
def _parse_json(a):
    return Json(U.canonical(a.col))


@function("dump_json", 1)
def _dump_json(a):
    return as_json(a)


@function("json_object", 0, None)
def _json_object(*args):
    if len(args) % 2:
        raise ScriptError("json_object takes keys and values in pairs")
    if not args:
        return Json(F.lit("{}"))
    return Json(U.json_object(*[as_json(a) if i % 2 else a.col.cast("string") for i, a in enumerate(args)]))


@function("json_to_scalar", 1)
def _json_to_scalar(a):
    # as text: a column has one type, and what a JSON value holds differs from row to row
    return F.get_json_object(F.concat(F.lit('{"v":'), a.col, F.lit("}")), "$.v") if a.json else a.col


@function("set_json_path", 3)
def _set_path(a, b, c):
    return Json(U.json_set(as_json(a), as_json(b), as_json(c)))


@function("remove_json_path", 2)
def _remove_path(a, b):
    return Json(U.json_remove(as_json(a), as_json(b)))


# --- random -------------------------------------------------------------------------


@function("rand_float", 0)
def _rand_float():
    return F.rand()


@function("rand_bernoulli", 1)
def _rand_bernoulli(a):
    return F.rand() < dbl(a)


@function("rand_int", 2)
def _rand_int(a, b):
    return (F.floor(F.rand() * (b.col - a.col + 1)) + a.col).cast("long")


@function("rand_choose", 1)
def _rand_choose(a):
    return F.get(F.shuffle(a.col), F.lit(0))


@function("rand_uuid_v1", 0)
def _uuid1():
    return U.uuid1()


@function("rand_uuid_v4", 0)
def _uuid4():
    return F.uuid()


# --- time ---------------------------------------------------------------------------


@function("now", 0)
def _now():
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6)


@function("format_timestamp", 1, 2)
def _format_timestamp(a, zone=None):
    seconds = a.col["ts"] / F.lit(1e6) if a.validity else dbl(a)
    moment = F.timestamp_micros(F.round(seconds * 1e6).cast("long"))
    return U.rfc3339(constant(zone, "a time zone") if zone else "UTC")(F.unix_micros(moment))


@function("parse_timestamp", 1)
def _parse_timestamp(a):
    return F.unix_micros(F.to_timestamp(a.col)) / F.lit(1e6)


@function("uuid_timestamp", 1)
def _uuid_timestamp(a):
    return U.uuid_timestamp(a.col)


@function("validity", 1, 2)
def _validity(a, b=None):
    return F.struct(a.col.cast("long").alias("ts"), (b.col if b else F.lit(True)).alias("is_assert"))
