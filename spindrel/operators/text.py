"""Tokenizers and token filters of text indices."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrel.plans import ast as A

#: Common words that an index may leave out, by language.
STOPWORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "de": "aber als am an auch auf aus bei bin bis da das dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so um und uns von vor war was wenn wer wie wir zu zum zur".split(),
    "fr": "à au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
    "es": "a al algo como con de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le les lo los más me mi mis muy no nos o para pero por que se ser sin sobre su sus también te tu un una uno y ya yo".split(),
}
Token = tuple[str, int, int]  # text, from, to


def simple(text: str) -> list[Token]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]


def whitespace(text: str) -> list[Token]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def ngrams(text: str, least: int = 1, most: int | None = None, prefix_only: bool = False) -> list[Token]:
    most = most or least
    starts = range(1) if prefix_only else range(len(text))
    return [(text[i : i + n], i, i + n) for i in starts for n in range(least, most + 1) if i + n <= len(text)]


VOWELS = "aeiou"


class Porter:
    """The Porter stemmer for English."""

    def consonant(self, w: str, i: int) -> bool:
        if w[i] in VOWELS:
            return False
        return w[i] != "y" or i == 0 or not self.consonant(w, i - 1)

    def measure(self, w: str) -> int:
        shape = "".join("c" if self.consonant(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", shape))

    def has_vowel(self, w: str) -> bool:
        return any(not self.consonant(w, i) for i in range(len(w)))

    def doubled(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self.consonant(w, len(w) - 1)

    def short(self, w: str) -> bool:
        n = len(w)
        return n > 2 and self.consonant(w, n - 1) and not self.consonant(w, n - 2) and self.consonant(w, n - 3) and w[-1] not in "wxy"

    STEP2 = (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
        ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
        ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    )
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

    def __call__(self, w: str) -> str:
        if len(w) < 3:
            return w
        for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(a):
                w = w[: len(w) - len(a)] + b
                break
        if w.endswith("eed"):
            if self.measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for a in ("ed", "ing"):
                if w.endswith(a) and self.has_vowel(w[: -len(a)]):
                    w = w[: -len(a)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self.doubled(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.short(w):
                        w += "e"
                    break
        if w.endswith("y") and self.has_vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (self.STEP2, self.STEP3):
            for a, b in table:
                if w.endswith(a):
                    if self.measure(w[: -len(a)]) > 0:
                        w = w[: -len(a)] + b
                    break
        for a in sorted((*self.STEP4, "ion"), key=len, reverse=True):
            if w.endswith(a):
                stem = w[: -len(a)]
                if self.measure(stem) > 1 and (a != "ion" or stem[-1:] in ("s", "t")):
                    w = stem
                break
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or (m == 1 and not self.short(w[:-1])):
                w = w[:-1]
        if self.measure(w) > 1 and self.doubled(w) and w.endswith("l"):
            w = w[:-1]
        return w


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def split_compound(word: str, parts: list[str]) -> list[str]:
    """A word made of listed parts only, in pieces; else the word."""
    if not word:
        return []
    for p in sorted(parts, key=len, reverse=True):
        if p and word.startswith(p):
            rest = split_compound(word[len(p) :], parts)
            if len(p) == len(word) or (rest and all(r in parts for r in rest)):
                return [p, *rest]
    return [word]


def named(spec: Any) -> tuple[str, list]:
    """A tokenizer or filter: a bare name or a call with constants."""
    from spindrel.plans.parser import fold

    if isinstance(spec, A.Var):
        return spec.name, []
    if isinstance(spec, A.Call):
        return spec.name, [fold(a) if not isinstance(a, A.Var) else a.name for a in spec.args]
    return str(fold(spec)), []


def tokenizer(name: str, args: list) -> Callable[[str], list[Token]]:
    if name == "Raw":
        return lambda text: [(text, 0, len(text))]
    if name == "Simple":
        return simple
    if name == "Whitespace":
        return whitespace
    if name == "NGram":
        return lambda text: ngrams(text, *args)
    raise A.ScriptError(f"no tokenizer {name}")


def token_filter(name: str, args: list) -> Callable[[list[Token]], list[Token]]:
    each = lambda f: lambda ts: [(f(t), a, b) for t, a, b in ts]
    only = lambda f: lambda ts: [x for x in ts if f(x[0])]
    if name in ("Lowercase", "LowerCase"):
        return each(str.lower)
    if name == "AsciiFolding":
        return each(folded)
    if name == "AlphaNumOnly":
        return only(str.isalnum)
    if name == "RemoveLong":
        return only(lambda t: len(t.encode()) < int(args[0]))
    if name == "Stopwords":
        words = set(args[0]) if args and isinstance(args[0], list) else set(STOPWORDS.get(str(args[0]) if args else "en", ()))
        if not words:
            raise A.ScriptError(f"no stop words for {args}")
        return only(lambda t: t not in words)
    if name == "SplitCompoundWords":
        return lambda ts: [(p, a, b) for t, a, b in ts for p in split_compound(t, list(args[0]))]
    if name == "Stemmer":
        if not args or str(args[0]).lower() not in ("en", "english"):
            raise A.ScriptError("only the English stemmer is built")
        return each(Porter())
    raise A.ScriptError(f"no token filter {name}")


class Analyzer:
    """A tokenizer and filters, by name, so that workers can rebuild them."""

    def __init__(self, options: dict[str, Any]):
        self.tokens = named(options.get("tokenizer", A.Var("Raw")))
        filters = options.get("filters", A.ListOf(()))
        self.filters = tuple((n, tuple(map(repr_free, a))) for n, a in map(named, filters.items))

    def key(self) -> tuple:
        return (self.tokens[0], tuple(self.tokens[1]), self.filters)

    def __call__(self, text: str) -> list[Token]:
        return analyzed(self.key(), text)

    def words(self, text: Column) -> Column | None:
        """array<string> of the tokens by Spark's own functions; None where they cannot express the chain."""
        split = {"Raw": F.array(text), "Simple": F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "Whitespace": F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))}
        out = split.get(self.tokens[0])
        for name, args in self.filters:
            if out is None:
                return None
            if name in ("Lowercase", "LowerCase"):
                out = F.transform(out, F.lower)
            elif name == "RemoveLong":
                out = F.filter(out, lambda t, n=int(args[0]): F.octet_length(t) < n)
            elif name == "Stopwords":
                stop = list(args[0]) if args and isinstance(args[0], tuple) else STOPWORDS.get(str(args[0]) if args else "en", [])
                out = F.filter(out, lambda t, stop=stop: ~t.isin(stop)) if stop else None
            else:
                return None
        return out


def repr_free(value: Any) -> Any:
    return tuple(value) if isinstance(value, list) else value


@lru_cache(maxsize=64)
def _chain(key: tuple) -> tuple:
    name, args, filters = key
    return tokenizer(name, list(args)), [token_filter(n, [list(x) if isinstance(x, tuple) else x for x in a]) for n, a in filters]


def analyzed(key: tuple, text: str) -> list[Token]:
    split, filters = _chain(key)
    out = split(text)
    for f in filters:
        out = f(out)
    return out
