"""Arrow-batched pandas UDFs for what Spark's built-ins cannot express."""

from __future__ import annotations

import base64
import datetime
import json
import re
import unicodedata
import uuid
import zoneinfo
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Common traditional characters and their simplified forms, in one order.
TRADITIONAL = "國學語漢書車門見長東馬風飛魚鳥黃龍齒說話請謝讓試課讀寫買賣錢銀鐵時間開關電腦網絡機會實現體驗經濟發展歷史傳統愛歡樂觀點標準問題應該認識專業產品質量環境變化農業軍隊醫藥衛條約協議動員際務備戰爭勝敗獨韓劉陳張楊趙黨義無與為來從個們這邊還進過遠運達連對號處頭難響項預領類願顧"
SIMPLIFIED = "国学语汉书车门见长东马风飞鱼鸟黄龙齿说话请谢让试课读写买卖钱银铁时间开关电脑网络机会实现体验经济发展历史传统爱欢乐观点标准问题应该认识专业产品质量环境变化农业军队医药卫条约协议动员际务备战争胜败独韩刘陈张杨赵党义无与为来从个们这边还进过远运达连对号处头难响项预领类愿顾"


def _each(series: pd.Series, f):
    return series.map(lambda x: None if x is None or x is pd.NA else f(x))


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def normalize(form: str):
    if form.lower() not in ("nfc", "nfd", "nfkc", "nfkd"):
        raise ValueError(f"no normal form {form}")

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda x: unicodedata.normalize(form.upper(), x))

    return run


def _groups(replacement: str) -> str:
    """$1 and ${name} references in Python's spelling."""
    return re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", replacement.replace("\\", "\\\\"))


@F.pandas_udf(T.StringType())
def replace_first(s: pd.Series, p: pd.Series, r: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None or z is None else re.sub(y, _groups(z), x, count=1) for x, y, z in zip(s, p, r, strict=True)])


@lru_cache
def bitwise(name: str):
    op = {"bit_and": np.bitwise_and, "bit_or": np.bitwise_or, "bit_xor": np.bitwise_xor}[name]

    @F.pandas_udf(T.BinaryType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            if len(x) != len(y):
                raise ValueError("bytes of different lengths")
            return op(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).tobytes()

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run


@F.pandas_udf(T.BinaryType())
def bit_not(a: pd.Series) -> pd.Series:
    return _each(a, lambda x: (~np.frombuffer(x, np.uint8)).tobytes())


@F.pandas_udf(T.BinaryType())
def pack_bits(a: pd.Series) -> pd.Series:
    return _each(a, lambda x: np.packbits(np.asarray(x, bool)).tobytes())


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def unpack_bits(a: pd.Series) -> pd.Series:
    return _each(a, lambda x: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool).tolist())


@lru_cache
def decode_vector(element: str):
    @F.pandas_udf(T.ArrayType(T.FloatType() if element == "float" else T.DoubleType()))
    def run(a: pd.Series) -> pd.Series:
        kind = "<f4" if element == "float" else "<f8"
        return _each(a, lambda x: np.frombuffer(base64.b64decode(x), kind).tolist())

    return run


@F.pandas_udf(T.StringType())
def quote(a: pd.Series) -> pd.Series:
    return a.map(lambda x: dumps(x if x is not None and x is not pd.NA else None))


@F.pandas_udf(T.StringType())
def canonical(a: pd.Series) -> pd.Series:
    return _each(a, lambda x: dumps(json.loads(x)))


def _merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: _merge(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, list) and isinstance(b, list):
        return a + b
    return b


@F.pandas_udf(T.StringType())
def json_merge(*parts: pd.Series) -> pd.Series:
    def one(values):
        out = json.loads(values[0])
        for v in values[1:]:
            out = _merge(out, json.loads(v))
        return dumps(out)

    return pd.Series([one(values) for values in zip(*parts, strict=True)])


@F.pandas_udf(T.StringType())
def json_object(*parts: pd.Series) -> pd.Series:
    return pd.Series([dumps({k: json.loads(v) for k, v in zip(row[::2], row[1::2], strict=True)}) for row in zip(*parts, strict=True)])


def _steps(path):
    return path if isinstance(path, list) else [path]


def _step(value, key):
    if isinstance(value, dict):
        return value[str(key)]
    return value[int(key)]


@F.pandas_udf(T.StringType())
def json_get(a: pd.Series, path: pd.Series) -> pd.Series:
    def one(text, p):
        if text is None:
            return None
        value = json.loads(text)
        try:
            for key in _steps(json.loads(p)):
                value = _step(value, key)
        except (KeyError, IndexError, TypeError, ValueError):
            return None
        return dumps(value)

    return pd.Series([one(x, p) for x, p in zip(a, path, strict=True)])


def _set(value, path, new):
    if not path:
        return new
    key, rest = path[0], path[1:]
    if isinstance(key, str):
        value = value if isinstance(value, dict) else {}
        return value | {key: _set(value.get(key), rest, new)}
    value = list(value) if isinstance(value, list) else []
    value += [None] * (int(key) + 1 - len(value))
    value[int(key)] = _set(value[int(key)], rest, new)
    return value


@F.pandas_udf(T.StringType())
def json_set(a: pd.Series, path: pd.Series, new: pd.Series) -> pd.Series:
    rows = zip(a, path, new, strict=True)
    return pd.Series([None if x is None else dumps(_set(json.loads(x), _steps(json.loads(p)), json.loads(v))) for x, p, v in rows])


def _remove(value, path):
    key = path[0]
    if not isinstance(value, dict | list):
        raise ValueError("only objects and arrays have elements")
    if len(path) == 1:
        if isinstance(value, dict):
            return {k: v for k, v in value.items() if k != str(key)}
        return [v for i, v in enumerate(value) if i != int(key)]
    if isinstance(value, dict):
        return {k: _remove(v, path[1:]) if k == str(key) else v for k, v in value.items()}
    return [_remove(v, path[1:]) if i == int(key) else v for i, v in enumerate(value)]


@F.pandas_udf(T.StringType())
def json_remove(a: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else dumps(_remove(json.loads(x), _steps(json.loads(p)))) for x, p in zip(a, path, strict=True)])


def uuid1():
    @F.pandas_udf(T.StringType())
    def run(n: pd.Series) -> pd.Series:
        return n.map(lambda _: str(uuid.uuid1()))

    return run.asNondeterministic()(F.rand())


@F.pandas_udf(T.DoubleType())
def uuid_timestamp(a: pd.Series) -> pd.Series:
    def one(x):
        u = uuid.UUID(x)
        return (u.time - 0x01B21DD213814000) / 1e7 if u.version == 1 else None

    return _each(a, one).astype("float64")


@lru_cache
def rfc3339(zone: str):
    place = zoneinfo.ZoneInfo(zone)

    @F.pandas_udf(T.StringType())
    def run(micros: pd.Series) -> pd.Series:
        start = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)

        def one(m):
            moment = (start + datetime.timedelta(microseconds=int(m))).astimezone(place)
            text = moment.isoformat(timespec="microseconds" if moment.microsecond % 1000 else "milliseconds" if moment.microsecond else "seconds")
            return text

        return micros.map(lambda m: None if pd.isna(m) else one(m))

    return run
