"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled training text is built.  Parsing a
text against it greedily takes the longest match that starts at each phrase's first
symbol; the phrases needed per symbol, times the logarithm of the training length,
estimate the cross entropy of the text under that language.  The lowest estimate wins.

Every letter seen in any training text is a symbol of its own, in lower case; letters of
no training text match nowhere and cost a phrase each.  The transitions of all automata
lie in one double array: a state's row is shifted to a free place, and an entry names the
state that owns it, so memory is linear in the training text whatever the alphabet.  A
few gathers per symbol then parse many texts under all languages in lockstep.  Texts of more
than ``BLOCK`` symbols are parsed in parts of that length, which costs a phrase a part
at most; every symbol counts.

The training sample is bounded per language, whatever the corpus holds: ``sample_docs``
documents of the smallest keyed digest, and ``sample_symbols`` characters in all of them.
Every one of these documents gives one window at a keyed place in its text; windows are
equally long, but where a text is shorter it is taken whole and the others' share grows, to
``WIDEST`` times the equal share at most.  The automata are built on the driver; what it
and each worker hold grows with the number of languages alone.

Defined results: a null text or one without a letter is ``und`` with score 0, as is
every text when nothing is learned; equal entropies go to the language first by code
point; a very long text is judged whole, part by part; repeated rows are judged each, and
a repeated id gives one training text; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.llm.common import byte_slices, id_remainder, table

SAMPLE_DOCS = 200
SAMPLE_SYMBOLS = 32_000
WIDEST = 8
BLOCK = 2_048
BATCH_SYMBOLS = 500_000
LANES = 1 << 19
UNKNOWN = "und"
HELD_OUT = (4, 2)

#: Code points at and above this are no letters.
_LETTERS_END = 0x32400
_NONE, _UNSEEN = 0, 1  # symbols: a run of characters that are not letters, a letter of no training text


@lru_cache(maxsize=1)
def unicode_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, whether it is a letter or a mark, its lower case."""
    every = [chr(i) for i in range(_LETTERS_END)]
    letter = np.array([c.isalpha() for c in every])
    spelt = letter | np.array([unicodedata.category(c)[0] == "M" for c in every])
    low = np.array([ord(c.lower()[0]) for c in every], np.int32)
    return letter, spelt, low


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


class Judge:
    """Parses texts against all learned languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in samples]
        _, spelt, low = unicode_tables()
        folded = [low[p] for _, p in ((name, self._points(text)) for name, text in samples)]
        seen = np.unique(np.concatenate([p[spelt[p]] for p in folded])) if folded else np.zeros(0, np.int32)
        self.letters = seen
        self.size = len(seen) + 2
        # state 0 is where a phrase ends for sure: it has no transitions
        edges: list[dict[int, int]] = [{}]
        self.first = np.zeros((len(samples), self.size), np.int32)
        self.weight = []
        for k, (_, text) in enumerate(samples):
            s = self.encode(text)
            base = len(edges) - 1
            nexts = automaton(s.tolist())
            edges += [{c: to + base for c, to in out.items()} for out in nexts[1:]]
            for c, to in nexts[0].items():
                self.first[k, c] = to + base
            self.weight.append(float(np.log2(max(len(s), 2))))
        self.base, self.cells = placed(edges, self.size)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return np.where(points < _LETTERS_END, points, 0).astype(np.int32)

    @property
    def symbol(self) -> np.ndarray:
        """Symbols by code point; made once in a process, as it need not be sent."""
        if "_symbol" not in self.__dict__:
            _, spelt, low = unicode_tables()
            at = np.minimum(np.searchsorted(self.letters, low), max(len(self.letters) - 1, 0))
            known = self.letters[at] == low if len(self.letters) else np.zeros(len(low), bool)
            self._symbol = np.where(~spelt, _NONE, np.where(known, at + 2, _UNSEEN)).astype(np.int32)
        return self._symbol

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_symbol"}

    def encode(self, text: str) -> np.ndarray:
        return self._encoded(self._points(text))

    def _encoded(self, points: np.ndarray) -> np.ndarray:
        s = self.symbol[points]
        return s[(s != _NONE) | (np.append(1, s[:-1]) != _NONE)] if len(s) else s

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text falls into, texts by languages."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        lengths = np.array([len(s) for s in texts], np.int64)
        parts = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), parts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(lengths) - lengths)[owner] + within * BLOCK
        length = np.minimum(lengths[owner] - within * BLOCK, BLOCK)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        at_once = max(1, LANES // max(1, len(self.names)))
        order = np.argsort(-length, kind="stable")  # lanes that are over drop off at the end
        for a in range(0, len(order), at_once):
            lanes = order[a : a + at_once]
            counts = self._lockstep(flat, start[lanes], length[lanes])
            for k in range(len(self.names)):
                out[:, k] += np.bincount(owner[lanes], counts[k], len(texts)).astype(np.int64)
        return out

    def _lockstep(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        langs = len(self.names)
        state, count = np.zeros((langs, len(start)), np.int32), np.zeros((langs, len(start)), np.int32)
        live = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0), side="left")
        for t, n in enumerate(live.tolist()):
            symbol = flat[start[:n] + t]
            now = state[:, :n]
            cell = self.cells[self.base[now] + symbol]
            miss = (cell >> 32) != now
            count[:, :n] += miss
            state[:, :n] = np.where(miss, self.first[:, symbol], cell)  # the low half of a cell
        return count

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a symbol, texts by languages."""
        return self.phrases(texts) * np.array(self.weight) / np.maximum([len(s) for s in texts], 1)[:, None]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letter = unicode_tables()[0]
        points = [self._points(t or "") for t in texts]
        bits = self.entropies([self._encoded(p) for p in points]) if self.names else np.zeros((len(texts), 0))
        names, scores = [], []
        for p, b in zip(points, bits, strict=True):
            if not len(b) or not letter[p].any():
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(b))
            rest = np.delete(b, best)
            names.append(self.names[best])
            scores.append(float(rest.min() / (rest.min() + b[best])) if len(rest) else 1.0)
        return names, scores


def placed(edges: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(base by state, cells): the cell at base + symbol holds owner << 32 | next state."""
    total = sum(map(len, edges))
    room = max(64, 2 * total) + 2 * size
    used = bytearray(room + size)
    base, cells = np.zeros(len(edges), np.int32), np.full(room + size, -1 << 32, np.int64)
    draw, spread = 0, room - 2 * size
    many = sorted((s for s, out in enumerate(edges) if len(out) > 1), key=lambda s: (-len(edges[s]), s))
    for state in many:
        symbols = list(edges[state])
        while True:  # a place where the whole row falls on free cells
            draw = (draw + 0x9E3779B1) & 0xFFFFFFFF
            at = size + draw % spread
            if not any(used[at + c] for c in symbols):
                break
        base[state] = at
        for c, to in edges[state].items():
            used[at + c] = 1
            cells[at + c] = state << 32 | to
    one = [s for s, out in enumerate(edges) if len(out) == 1]
    free = np.flatnonzero(np.frombuffer(used, np.uint8)[size:room] == 0)[: len(one)] + size
    owner = np.array(one, np.int64)
    symbol = np.array([next(iter(edges[s])) for s in one], np.int64)
    base[owner] = free - symbol
    cells[free] = owner << 32 | np.array([next(iter(edges[s].values())) for s in one], np.int64)
    return base, cells


def learn(
    docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", sample_docs=SAMPLE_DOCS,
    sample_symbols=SAMPLE_SYMBOLS,
) -> tuple[tuple[str, str], ...]:
    """(language, training text) of every language in ``docs``, in code point order."""
    keyed = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.lit("language"), F.col(id_col)).alias("key")
    )
    first = keyed.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("key", "id"))).where(F.col("at") <= sample_docs)
    chosen = sorted({r["id"] for r in first.select("id").collect() if r["id"] is not None})
    texts: dict[str, list[tuple[int, str]]] = defaultdict(list)
    sample = docs.where(F.col(id_col).isin(chosen) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.lit("language"), F.col(id_col))
    found = sample.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"), F.xxhash64(F.lit("window"), F.col(id_col)).alias("place"))
    each = max(1, WIDEST * sample_symbols // max(1, sample_docs))
    place = (F.pmod("place", F.greatest(F.length("text") - each, F.lit(0)) + 1) + 1).cast("int")
    cut = found.select("lang", "id", "key", F.xxhash64("text").alias("print"), F.substr("text", place, F.lit(each)).alias("text"))
    one = cut.groupBy("lang", "id", "key").agg(F.min(F.struct("print", "text"))["text"].alias("text"))  # of a repeated id
    for lang, at, text in sorted((r[0], r[1], r[2]) for r in one.select("lang", "key", "text").collect()):
        texts[lang].append((at, text))
    return tuple((lang, "\n".join(windows(t, sample_symbols))) for lang, t in sorted(texts.items()))


def windows(texts: list[tuple[int, str]], most: int) -> list[str]:
    """A window of every (key, text), equally long where the texts allow it, of ``most`` characters in all."""
    left, level = most, 0
    for i, n in enumerate(sorted(len(t) for _, t in texts)):
        level = left // (len(texts) - i)
        if n > level:
            break
        left -= n
        level = n
    return [t[(at := key % (max(len(t) - level, 0) + 1)) : at + level] for key, t in texts]


def _judged(batch: pa.RecordBatch, text_at: int, judge: Judge) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """Parts of a batch with about BATCH_SYMBOLS bytes of text, their languages and scores."""
    for part in byte_slices(batch, text_at, BATCH_SYMBOLS):
        names, scores = judge.judge(part.column(text_at).to_pylist())
        yield part, pa.array(names, pa.string()), pa.array(scores, pa.float64())


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred and score for every row."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    judge = Judge(samples)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, names, scores in _judged(batch, 1, judge):
                yield pa.RecordBatch.from_arrays([part.column(0), names, scores], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([out.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return out.mapInArrow(rows, schema)


def accepted(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, text_col="text") -> DataFrame:
    """The rows whose text is in a learned language, with all their columns."""
    judge, text_at = Judge(samples), docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, names, _ in _judged(batch, text_at, judge):
                yield part.filter(pc.not_equal(names, UNKNOWN))

    return docs.mapInArrow(rows, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    modulus, held = HELD_OUT
    samples = learn(docs.where(id_remainder("doc_id", modulus) != held))
    found = identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", (id_remainder("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are ``und`` (no text, or no letter in it) go."""
    modulus, held = HELD_OUT
    return accepted(docs, learn(docs.where(id_remainder("doc_id", modulus) != held)))
