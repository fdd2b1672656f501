"""Search indices: nearest vectors, full text, near duplicates by MinHash.

A search atom joins the current bindings with the rows that its index finds.  Queries
come from constants or from bound variables; each distinct query is searched once.

The postings of a text index and the bands of a near-duplicate index over a relation that was
created here are durable tables, sorted by word or band, and follow each mutation by its
changed rows.  A registered table may change outside, so its index holds what its rows give
when they are searched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.functions.scalars import cosine, dot, l2, vector
from spindrel.operators.text import Analyzer, analyzed
from spindrel.plans import ast as A
from spindrel.plans.expressions import Scope
from spindrel.sources.durable import observed, written

#: Bytes of queries that are sent to every task at a time.
BROADCAST_BYTES = 32 << 20
#: Tokens of analyzed texts in an Arrow batch.
TOKENS_AT_ONCE = 50_000


def search_join(session: Any, atom: A.SearchAtom, body: Any) -> None:
    """Extend a body by the rows that an index finds for its query."""
    from spindrel.plans.parser import fold

    relation = session.catalog.readable(atom.relation)
    index = next((i for i in relation.indices if i.name == atom.index), None)
    if index is None or index.kind == "normal":
        raise A.ScriptError(f"{atom.relation} has no search index {atom.index}")
    options = dict(atom.options)
    if "query" not in options:
        raise A.ScriptError("a search needs the option query")
    scope = body.scope()
    query = scope.compile(options["query"])
    constant = lambda name, default=None: fold(options[name]) if name in options else default
    rows = relation.frame()
    if "filter" in options:
        rows_filter = Scope(rows, {c: c for c in rows.columns} | {e.name: c for c, e in atom.named if isinstance(e, A.Var)})
        condition = rows_filter.test(options["filter"])
    else:
        condition = F.lit(True)
    asked = (relation, index, rows, condition, body.frame().select(query.col.alias("_q")).distinct(), query, constant)
    if index.kind == "hnsw":
        found = nearest(*asked, {c for c, _ in atom.named} | ({"_vector"} if "bind_vector" in options else set()))
    else:
        found = {"fts": full_text, "lsh": near_duplicates}[index.kind](*asked)
    # the hits carry the query, so they join back to what asked for them
    asking = body.fresh()
    body.df = body.frame().select("*", query.col.alias(asking))
    pairs = [(c, e) for c, e in atom.named]
    for option, column in (("bind_distance", "_distance"), ("bind_score", "_score"), ("bind_vector", "_vector"), ("bind_field", "_field"), ("bind_field_idx", "_field_idx")):
        if option in options and column in found.columns:
            pairs.append((column, options[option]))
    body.columns["#q"] = asking
    body.join(found, [("_q", A.Var("#q")), *pairs], None)
    del body.columns["#q"]
    body.df = body.df.drop(asking)


def option_map(index: Any) -> dict[str, Any]:
    return dict(index.options)


# --- vectors ------------------------------------------------------------------------

DISTANCES = {"L2": l2, "IP": lambda a, b: 1 - dot(a, b), "Cosine": cosine}


def nearest(relation: Any, index: Any, rows: DataFrame, condition: Column, queries: DataFrame, query: Any, constant: Any, used: set[str]) -> DataFrame:
    """Exact nearest rows: every row against the distinct queries, then the k best each.

    Exact results are what an approximate graph is measured against, so the accuracy
    options of the index are accepted and not needed.  Queries are dealt in blocks of a
    checked size, each sent to all tasks.  Products of matrices leave out the pairs that
    cannot be among the best; what is left is measured by the formula itself.
    """
    options = option_map(index)
    k = int(constant("k", 0))
    if k < 1:
        raise A.ScriptError("a vector search needs a positive k")
    name = options["distance"].name if isinstance(options.get("distance"), A.Var) else "L2"
    fields = [f.name for f in options["fields"].items]
    element = "double" if str(getattr(options.get("dtype"), "name", "F32")) in ("F64", "Double") else "float"
    if "filter" in options:
        rows = rows.where(Scope(rows, {c: c for c in rows.columns}).test(options["filter"]))
    asked = queries.select("_q", vector(query.__class__(F.col("_q"), query.type), element).alias("_query")).where("_q is not null")
    asked = asked.withColumn("_qid", F.monotonically_increasing_id())
    kept = [c for c in rows.columns if c in used or c in relation.key_columns]
    bound = ["_vector"] if "_vector" in used else []
    out = None
    for i, f in enumerate(fields):
        part = rows.where(condition).select(*kept, F.col(f).alias("_vector"), F.lit(f).alias("_field"), F.lit(i).alias("_field_idx")).where("_vector is not null")
        out = part if out is None else out.union(part)
    asked, _, seen = observed(asked, n=F.count(F.lit(1)), size=F.sum(F.size("_query") * 16 + 64 + 16 * k), dim=F.max(F.size("_query")))
    dim = seen["dim"] or 0
    plain = lambda v: F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & F.abs(x).between(0, 1e100)) & dot(F.col(v), F.col(v)).between(1e-200 if name == "Cosine" else 0, 1e200), F.lit(False))
    asked = asked.withColumn("_plain", plain("_query"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if out.rdd.getNumPartitions() < cores:  # few rows may be much work
        out = out.repartition(cores)
    radius = constant("radius")
    columns = [*kept, "_field", "_field_idx", *bound, "_qid", "_distance"]

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("_distance", DISTANCES[name](F.col("_vector"), F.col("_query"))).select(*columns)

    def best(some: DataFrame) -> DataFrame:
        given = out.where(plain("_vector")).select(*kept, "_field", "_field_idx", *bound, F.col("_vector").cast("array<double>").alias("_v"))
        met = near_pairs(given, some.where("_plain"), name, k, dim, radius)
        # what is not an ordinary vector is measured pair by pair
        met = met.union(apart(out.where(~plain("_vector")).crossJoin(F.broadcast(some))))
        met = met.union(apart(out.where(plain("_vector")).crossJoin(F.broadcast(some.where("not _plain")))))
        if radius is not None:
            met = met.where(F.col("_distance") <= F.lit(float(radius)))
        # row_number <= k is applied to each task's rows before the shuffle as well
        place = F.row_number().over(W.partitionBy("_qid").orderBy("_distance", *relation.key_columns, "_field_idx"))
        met = met.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
        return met.join(some.select("_qid", "_q"), "_qid").drop("_qid")

    # every block of queries is small enough to be sent to all tasks
    blocks = max(1, -(-(seen["size"] or 0) // BROADCAST_BYTES))
    if blocks == 1:
        return best(asked)
    block = F.pmod(F.xxhash64("_query"), F.lit(blocks))
    found = [written(best(asked.where(block == i)))[0] for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


#: Bytes of products of rows and queries at a time, and pairs that are measured at a time.
PRODUCT_BYTES = 32 << 20
PAIRS_AT_ONCE = 50_000


def measured(name: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of pairs of vectors, their terms summed in order as by Spark's own expressions."""

    def summed(x: np.ndarray, y: np.ndarray, term: Any) -> np.ndarray:
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            out += term(x[:, j], y[:, j])
        return out

    if name == "L2":
        return summed(v, q, lambda x, y: (x - y) * (x - y))
    product = lambda x, y: x * y
    if name == "IP":
        return 1 - summed(v, q, product)
    return 1 - summed(v, q, product) / np.sqrt(summed(v, v, product) * summed(q, q, product))


class Best:
    """The pairs that may be among the k nearest of each query, given rows block after block."""

    def __init__(self, name: str, queries: np.ndarray, k: int, radius: float | None):
        self.name, self.queries, self.k = name, queries, k
        self.squares = np.einsum("ij,ij->i", queries, queries)
        self.scaled = queries / np.sqrt(self.squares)[:, None] if name == "Cosine" else queries
        #: no product or sum of squares is off by more than this share
        self.off = 8 * (queries.shape[1] + 8) * np.finfo(float).eps
        self.least = np.full((len(queries), k), np.inf)  # upper bounds of the k nearest so far
        self.radius = np.inf if radius is None else float(radius)

    def add(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows of ``v`` that may be near."""
        squares = np.einsum("ij,ij->i", v, v)
        if self.name == "Cosine":
            near, slack = 1 - self.scaled @ (v / np.sqrt(squares)[:, None]).T, np.full(len(self.queries), 2 * self.off)
        elif self.name == "IP":
            near, slack = 1 - self.scaled @ v.T, self.off * (1 + np.sqrt(self.squares * squares.max()))
        else:
            near = self.scaled @ v.T
            near *= -2
            near += self.squares[:, None]
            near += squares
            slack = 2 * self.off * (self.squares + squares.max())
        most = np.minimum(self.least.max(1), self.radius) + slack
        where = np.flatnonzero((near <= most[:, None]).any(1))
        if not len(where):
            return where, where
        some = near[where]
        merged = np.concatenate([self.least[where], some + slack[where, None]], axis=1)
        self.least[where] = np.partition(merged, self.k - 1, axis=1)[:, : self.k]
        most = np.minimum(self.least[where].max(1), self.radius) + slack[where]
        at, row = np.nonzero(some <= most[:, None])
        return where[at], row


def near_pairs(given: DataFrame, some: DataFrame, name: str, k: int, dim: int, radius: float | None) -> DataFrame:
    """The columns of ``given`` but its vector, with _qid and _distance of the pairs that each task may not leave out."""
    spark = given.sparkSession
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("_qid", T.LongType()), T.StructField("_distance", T.DoubleType())])
    table = some.select("_qid", F.col("_query").cast("array<double>").alias("_v")).toArrow().combine_chunks()
    if not table.num_rows:
        return spark.createDataFrame([], schema)
    matrix = lambda column: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    shared = spark.sparkContext.broadcast((table["_qid"].to_numpy(), matrix(table["_v"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = Best(name, queries, k, radius)
        step = max(1, PRODUCT_BYTES // (8 * len(ids)))
        for batch in batches:
            rows = matrix(batch.columns[-1])
            for at in range(0, len(rows), step):
                asked, row = best.add(rows[at : at + step])
                for first in range(0, len(row), PAIRS_AT_ONCE):
                    q, r = asked[first : first + PAIRS_AT_ONCE], row[first : first + PAIRS_AT_ONCE] + at
                    held = [c.take(pa.array(r)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(ids[q]), pa.array(measured(name, rows[r], queries[q]))], schema.names)

    return given.mapInArrow(run, schema)


# --- full text ----------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    op: str  # and, or, not, near
    parts: tuple
    distance: int = 10


def analyzed_rows(index: Any, rows: DataFrame) -> tuple[DataFrame, Any]:
    """Rows that the index covers, and their text."""
    options = option_map(index)
    scope = Scope(rows, {c: c for c in rows.columns})
    if "extract_filter" in options:
        rows = rows.where(scope.test(options["extract_filter"]))
    text = scope.compile(options["extractor"])
    if text.list:
        text = text.__class__(F.array_join(text.col, " "), rows.select(F.lit("").alias("x")).schema[0].dataType)
    return rows, text


def sought(relation: Any, index: Any, terms: list[Term]) -> DataFrame:
    """word, keys and positions of the words that a query names; nothing else is gathered."""
    exact = [t.text for t in terms if not t.prefix]
    wanted = F.col("word").isin(exact) if exact else F.lit(False)
    for t in terms:
        if t.prefix:
            wanted = wanted | F.startswith("word", F.lit(t.text))
    keys = relation.key_columns
    if index.name in dict(relation.stored):
        return entries(relation, index).where(wanted).select(*keys, "word", "position")
    rows, text = analyzed_rows(index, relation.frame())
    analyzer = Analyzer(option_map(index))
    words = analyzer.words(text.col)
    if words is None:
        spread = tokens(rows, keys, text, analyzer)
    else:
        spread = rows.select(*keys, words.alias("_words")).select(*keys, F.posexplode("_words").alias("position", "word"))
    return spread.where(wanted).groupBy(*keys, "word").agg(F.sort_array(F.collect_list("position")).alias("position"))


#: What is known of a token, beside its text's keys.
TOKEN = (("total_length", T.IntegerType(), pa.int32()), ("position", T.IntegerType(), pa.int32()), ("word", T.StringType(), pa.string()), ("from", T.IntegerType(), pa.int32()), ("to", T.IntegerType(), pa.int32()))


def token_batches(key: tuple, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of texts, the last column, each with the columns before it; a batch holds at most ``TOKENS_AT_ONCE``."""

    def packed(batch: pa.RecordBatch, at: list[int], cells: list[list]) -> pa.RecordBatch:
        held = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
        return pa.RecordBatch.from_arrays([*held, *[pa.array(v, t) for v, (_, _, t) in zip(cells, TOKEN, strict=True)]], names)

    for batch in batches:
        at: list[int] = []
        cells: list[list] = [[] for _ in TOKEN]
        for i, value in enumerate(batch.columns[-1]):
            found = analyzed(key, value.as_py()) if value.is_valid else []
            first = 0
            while first < len(found):
                some = found[first : first + TOKENS_AT_ONCE - len(at)]
                at += [i] * len(some)
                words, starts, ends = zip(*some, strict=True)
                for held, more in zip(cells, ([len(found)] * len(some), range(first, first + len(some)), words, starts, ends), strict=True):
                    held += more
                first += len(some)
                if len(at) == TOKENS_AT_ONCE:
                    yield packed(batch, at, cells)
                    at, cells = [], [[] for _ in TOKEN]
        if at:
            yield packed(batch, at, cells)


def tokens(rows: DataFrame, keys: list[str], text: Any, analyzer: Analyzer) -> DataFrame:
    """keys and total_length, position, word, from, to of each token; only one text's tokens are held at a time."""
    key = analyzer.key()
    given = rows.select(*keys, text.col.alias("_text"))
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(n, t) for n, t, _ in TOKEN]])
    return given.mapInArrow(lambda batches: token_batches(key, schema.names, batches), schema)


def postings(relation: Any, index: Any, rows: DataFrame) -> DataFrame:
    """word, keys, positions, offsets and the document's length in tokens."""
    rows, text = analyzed_rows(index, rows)
    keys = relation.key_columns
    return tokens(rows, keys, text, Analyzer(option_map(index))).groupBy(*keys, "total_length", "word").agg(
        F.sort_array(F.collect_list("position")).alias("position"),
        F.sort_array(F.collect_list("from")).alias("offset_from"),
        F.sort_array(F.collect_list("to")).alias("offset_to"),
    )


class QueryParser:
    """Terms, ``*`` prefixes, ``^`` boosts, AND, OR, NOT, NEAR/d(...), quotes and brackets."""

    TOKEN = re.compile(r"""\s*(?:(?P<q>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<near>NEAR(?:/\d+)?\()|(?P<p>[()*,;])|\^(?P<b>\d+(?:\.\d*)?)|(?P<w>[^\s()*,;^"']+))""")

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = self.TOKEN.match(text, at)
            if not m:
                raise A.ScriptError(f"cannot read the text query at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def parse(self) -> Any:
        out = self.sequence()
        if self.peek()[0] != "end":
            raise A.ScriptError("unexpected ) in the text query")
        return out

    def sequence(self) -> Any:
        parts = []
        while self.peek() != ("p", ")") and self.peek()[0] != "end":
            parts.append(self.either())
        return parts[0] if len(parts) == 1 else Group("and", tuple(parts))

    def either(self) -> Any:
        left = self.both()
        while self.peek() in (("w", "OR"), ("p", ","), ("p", ";")):
            self.at += 1
            left = Group("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.term()
        while self.peek() in (("w", "AND"), ("w", "NOT")):
            op = self.peek()[1].lower()
            self.at += 1
            left = Group(op, (left, self.term()))
        return left

    def term(self) -> Any:
        kind, text = self.peek()
        self.at += 1
        if kind == "near":
            parts = []
            while self.peek() != ("p", ")"):
                if self.peek()[0] == "end":
                    raise A.ScriptError("NEAR( is not closed")
                parts.append(self.term())
            self.at += 1
            return Group("near", tuple(parts), int(text[5:-1]) if "/" in text else 10)
        if (kind, text) == ("p", "("):
            inner = self.sequence()
            if self.peek() != ("p", ")"):
                raise A.ScriptError("( is not closed in the text query")
            self.at += 1
            return inner
        if kind not in ("w", "q"):
            raise A.ScriptError(f"unexpected {text!r} in the text query")
        text = re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "q" else text
        prefix, boost = False, 1.0
        if self.peek() == ("p", "*"):
            self.at += 1
            prefix = True
        if self.peek()[0] == "b":
            boost = float(self.peek()[1])
            self.at += 1
        return Term(text, prefix, boost)


def terms_of(node: Any) -> list[Term]:
    return [node] if isinstance(node, Term) else [t for p in node.parts for t in terms_of(p)]


def tokenized(node: Any, analyzer: Analyzer) -> Any:
    """Terms as the index's tokens; several tokens of one term must all be there."""
    if isinstance(node, Group):
        return Group(node.op, tuple(tokenized(p, analyzer) for p in node.parts), node.distance)
    words = [w for w, _, _ in analyzer(node.text)]
    parts = tuple(Term(w, node.prefix, node.boost) for w in words)
    return parts[0] if len(parts) == 1 else Group("and", parts)


class TextScores:
    """Scores of one parsed query over an index."""

    def __init__(self, words: DataFrame, keys: list[str], total: int, idf: bool):
        self.words, self.keys, self.total, self.idf = words, keys, total, idf

    def matching(self, t: Term) -> DataFrame:
        return self.words.where(F.startswith("word", F.lit(t.text)) if t.prefix else F.col("word") == t.text)

    def term(self, t: Term) -> DataFrame:
        hits = self.matching(t)
        score = F.size("position") * F.lit(t.boost)
        if self.idf:
            held = hits.groupBy(F.col("word").alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
            hits = hits.join(held, F.col("word") == F.col("_w"))
            score = score * F.ln(1 + (F.lit(self.total) - F.col("_n") + 0.5) / (F.col("_n") + 0.5))
        return hits.select(*self.keys, score.alias("_score")).groupBy(*self.keys).agg(F.sum("_score").alias("_score"))

    def near(self, g: Group) -> DataFrame:
        """Documents with all terms within the distance; the score counts close positions."""
        out = None
        for p in g.parts:
            if not isinstance(p, Term):
                raise A.ScriptError("NEAR takes terms")
            found = self.matching(p).groupBy(*self.keys).agg(F.flatten(F.collect_list("position")).alias("p"))
            if out is None:
                out = found
                continue
            met = out.join(found.withColumnRenamed("p", "r"), self.keys)
            close = F.filter("r", lambda x: F.exists("p", lambda y: F.abs(x - y) <= g.distance))
            out = met.select(*self.keys, close.alias("p")).where(F.size("p") > 0)
        boost = math.prod(p.boost for p in g.parts)
        return out.select(*self.keys, (F.size("p") * F.lit(boost)).cast("double").alias("_score"))

    def run(self, node: Any) -> DataFrame:
        if isinstance(node, Term):
            return self.term(node)
        if node.op == "near":
            return self.near(node)
        if not node.parts:
            return self.words.select(*self.keys, F.lit(0.0).alias("_score")).limit(0)
        out = self.run(node.parts[0])
        for p in node.parts[1:]:
            other = self.run(p).withColumnRenamed("_score", "_other")
            if node.op == "not":
                out = out.join(other, self.keys, "left_anti")
            elif node.op == "or":
                out = out.join(other, self.keys, "full_outer").select(*self.keys, F.greatest(F.coalesce("_score", F.lit(0.0)), F.coalesce("_other", F.lit(0.0))).alias("_score"))
            else:
                out = out.join(other, self.keys).select(*self.keys, (F.col("_score") + F.col("_other")).alias("_score"))
        return out


def full_text(relation: Any, index: Any, rows: DataFrame, condition: Column, queries: DataFrame, query: Any, constant: Any) -> DataFrame:
    k = int(constant("k") or 0)
    if k < 1:
        raise A.ScriptError("a text search needs a positive k")
    kind = constant("score_kind", "tf_idf")
    analyzer, keys = Analyzer(option_map(index)), relation.key_columns
    total = rows.count() if kind == "tf_idf" else 0
    texts = [r["_q"] for r in queries.limit(1001).collect() if r["_q"] is not None]
    if len(texts) > 1000:
        raise A.ScriptError("a text search takes at most 1000 different queries at once")
    nodes = {text: tokenized(QueryParser(text).parse(), analyzer) for text in texts}
    words, _ = written(sought(relation, index, [t for n in nodes.values() for t in terms_of(n)]))
    out = None
    for text, node in nodes.items():
        scores = TextScores(words, keys, total, kind == "tf_idf").run(node).select(F.lit(text).alias("_q"), *keys, "_score")
        out = scores if out is None else out.union(scores)
    if out is None:
        out = words.select(F.lit("").alias("_q"), *keys, F.lit(0.0).alias("_score")).limit(0)
    met = rows.where(condition).join(out, keys)
    place = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("_score"), *keys))
    return met.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


# --- near duplicates ----------------------------------------------------------------


@lru_cache
def bands_and_rows(threshold: float, n_perm: int, false_positive: float = 1.0, false_negative: float = 1.0) -> tuple[int, int]:
    """The bands and rows that keep the weighted false areas of the collision curve smallest."""
    steps = 200

    def area(f: Any, a: float, b: float) -> float:
        h = (b - a) / steps
        return h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(a + i * h) for i in range(steps + 1))

    best, least = (1, 1), math.inf
    for b in range(1, n_perm + 1):
        for r in range(1, n_perm // b + 1):
            hit = lambda s: 1 - (1 - s**r) ** b  # noqa: E731, B023
            error = false_positive * area(hit, 0.0, threshold) + false_negative * area(lambda s: 1 - hit(s), threshold, 1.0)  # noqa: B023
            if error < least:
                best, least = (b, r), error
    return best


#: n-grams that are hashed under all seeds at a time.
GRAMS_AT_ONCE = 8_192


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minhashes(grams: list[str], seeds: np.ndarray) -> np.ndarray:
    """The smallest hash of the n-grams under each seed."""
    least = np.full(len(seeds), np.uint64(2**64 - 1))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams))
    for at in range(0, len(hashes), GRAMS_AT_ONCE):
        least = np.minimum(least, _mixed(hashes[at : at + GRAMS_AT_ONCE] ^ seeds[:, None]).min(1))
    return least


def lsh_bands(source: Any, options: dict[str, Any]) -> Column:
    """array<bigint>: a hash for each band, over the smallest hashes of its rows' seeds."""
    from spindrel.plans.parser import fold

    n = int(fold(options["n_gram"])) if "n_gram" in options else 1
    b, r = lsh_shape(options)
    seeds = _mixed(np.arange(1, b * r + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key, lists = Analyzer(options).key(), source.list

    @F.pandas_udf("array<bigint>")
    def run(values: pd.Series) -> pd.Series:
        def bands(value: Any) -> list[int] | None:
            if value is None:
                return None
            if lists:
                grams = {str(x) for x in value if x is not None}
            else:
                words = [w for w, _, _ in analyzed(key, value)]
                grams = {"\u0001".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
            least = minhashes(list(grams), seeds).reshape(b, r)
            return [xxhash.xxh3_64_intdigest(least[i].tobytes(), i) - (1 << 63) for i in range(b)]

        return values.map(bands)

    return run(F.transform(source.col, lambda x: x.cast("string")) if lists else source.col)


def lsh_shape(options: dict[str, Any]) -> tuple[int, int]:
    from spindrel.plans.parser import fold

    number = lambda name, default: float(fold(options[name])) if name in options else default
    return bands_and_rows(number("target_threshold", 0.9), int(number("n_perm", 200)), number("false_positive_weight", 1.0), number("false_negative_weight", 1.0))


def lsh_entries(relation: Any, index: Any, rows: DataFrame) -> DataFrame:
    """band, hash and keys of ``rows`` of the relation."""
    options = option_map(index)
    scope = Scope(rows, {c: c for c in rows.columns})
    if "extract_filter" in options:
        rows = rows.where(scope.test(options["extract_filter"]))
    source = scope.compile(options["extractor"])
    made = rows.where(source.col.isNotNull()).select(lsh_bands(source, options).alias("_b"), *relation.key_columns)
    return made.select(F.posexplode("_b").alias("band", "hash"), *relation.key_columns)


def near_duplicates(relation: Any, index: Any, rows: DataFrame, condition: Column, queries: DataFrame, query: Any, constant: Any) -> DataFrame:
    """Rows that share a band with the query, by key where k limits them; a null query finds nothing."""
    options, keys = option_map(index), relation.key_columns
    table = entries(relation, index)
    asked = queries.where("_q is not null").select("_q", lsh_bands(query.__class__(F.col("_q"), query.type), options).alias("_b"))
    wanted = asked.select("_q", F.posexplode("_b").alias("_band", "_hash"))
    hits = wanted.join(table, (F.col("_band") == F.col("band")) & (F.col("_hash") == F.col("hash"))).select("_q", *keys).distinct()
    met = rows.where(condition).join(hits, keys)
    k = constant("k")
    if k is None:
        return met
    place = F.row_number().over(W.partitionBy("_q").orderBy(*keys))
    return met.withColumn("_place", place).where(F.col("_place") <= int(k)).drop("_place")


# --- indices as relations -----------------------------------------------------------


def entries_of(relation: Any, index: Any, rows: DataFrame) -> DataFrame | None:
    """What an index holds for ``rows``; None for an index that is not stored."""
    if index.kind == "fts":
        return postings(relation, index, rows)
    return lsh_entries(relation, index, rows) if index.kind == "lsh" else None


def entries(relation: Any, index: Any) -> DataFrame:
    """What an index holds: its stored table, or, over a registered table, what its rows give now."""
    stored = dict(relation.stored).get(index.name)
    return stored if stored is not None else entries_of(relation, index, relation.frame())


def stored_entries(made: DataFrame, index: Any) -> DataFrame:
    """Durable, sorted by what searches ask for, so that they read few row groups."""
    order = ["word"] if index.kind == "fts" else ["band", "hash"]
    return written(made.repartition(*order).sortWithinPartitions(*order))[0]


def index_frame(relation: Any, index: Any) -> tuple[DataFrame, list[str]]:
    if index.kind == "fts":
        df = entries(relation, index)
        return df.select("word", *relation.key_columns, "offset_from", "offset_to", "position", "total_length"), ["word", *relation.key_columns]
    if index.kind == "lsh":
        df = entries(relation, index)
        return df.select("band", "hash", *relation.key_columns), df.columns
    fields = [f.name for f in option_map(index)["fields"].items]
    return relation.frame().select(*relation.key_columns, *fields), relation.key_columns
