"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are normalised and dealt by hash into shards of about ``SHARD`` rows.  In a
shard a graph is built in growing batches: each new vector searches the graph so far
greedily from common entry points, and robust pruning chooses among all it met: the closest
is taken, and with it go the candidates that it is nearer to, by the factor ``ALPHA``,
than the vector is.  Edges back are added and pruned alike.  A second pass repeats this
over the whole graph.  Queries beam-search every shard, and the best of all shards are ranked by
exact cosines in double precision.

Equal vectors are one node holding its smallest rows, so a common vector neither fills a
graph with zero-length edges nor a shard with one row; as many rows are held as a result
can need.  A shard's graph is one row of a durable table.  Queries go to the shards in blocks, past
the graph that a task holds: a task has one shard, loaded once, and at most ``PART`` queries.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, as queries or candidates, nor do rows without an id; vectors of different lengths
are searched apart, as no angle lies between them; ties go to the smaller id; rows that
share an id are rows of their own, and a query leaves out its own row only; with fewer
candidates than asked all are returned; other columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrel.llm.common import materialize, small_batches, table

SHARD = 8_192
DEGREE = 40
BUILD_BEAM = 48
QUERY_BEAM = 192
ALPHA = 1.2
BLOCK = 512
PART = 1 << 16
ENTRIES = 64
SEED = 5


def _distances(points: np.ndarray, at: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared lengths between targets (q x d) and points[at] (q x k)."""
    return np.maximum(0, 2 - 2 * np.einsum("qkd,qd->qk", points[at], targets))


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Greedy searches in lockstep: (nodes, distances) sorted, q x beam, and what was expanded.

    ``edges`` is n x degree, padded with -1; missing results have node -1.
    """
    q, n = len(targets), len(points)
    nodes = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    entries = np.asarray(entries, np.int64)
    d = np.maximum(0, 2 - 2 * targets @ points[entries].T).astype(np.float32)
    first = np.argsort(d, 1, kind="stable")[:, :beam]
    nodes[:, : first.shape[1]], far[:, : first.shape[1]] = entries[first], np.take_along_axis(d, first, 1)
    open_[:, : first.shape[1]] = True
    seen[:, entries] = True
    expanded = []
    live = np.arange(q)
    while len(live):
        best = np.where(open_[live], far[live], np.inf).argmin(1)
        node = nodes[live, best]
        open_[live, best] = False
        expanded.append((live, node))
        near = edges[node]
        fresh = (near >= 0) & ~np.take_along_axis(seen[live], np.maximum(near, 0), 1)
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        d = np.where(fresh, _distances(points, np.maximum(near, 0), targets[live]), np.inf).astype(np.float32)
        all_nodes = np.concatenate((nodes[live], np.where(fresh, near, -1)), 1)
        all_far = np.concatenate((far[live], d), 1)
        all_open = np.concatenate((open_[live], fresh), 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :beam]
        nodes[live] = np.take_along_axis(all_nodes, order, 1)
        far[live] = np.take_along_axis(all_far, order, 1)
        open_[live] = np.take_along_axis(all_open, order, 1)
        live = live[open_[live].any(1)]
    return nodes, far, expanded


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse out-edges of nodes ``own`` among their candidates (m x c, -1 for none)."""
    m = len(own)
    chosen = np.full((m, degree), -1, np.int64)
    ordered = np.sort(candidates, 1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    ordered[ordered == own[:, None]] = -1
    d = np.where(ordered >= 0, _distances(points, np.maximum(ordered, 0), points[own]), np.inf)
    order = np.argsort(d, 1, kind="stable")
    ordered, d = np.take_along_axis(ordered, order, 1), np.take_along_axis(d, order, 1)
    width = int((ordered >= 0).sum(1).max()) if m else 0
    ordered, d = ordered[:, :width], d[:, :width]
    rows = np.arange(m)
    for k in range(degree):
        alive = np.isfinite(d)
        if not alive.any():
            break
        first = alive.argmax(1)
        any_ = alive[rows, first]
        pick = np.where(any_, ordered[rows, first], -1)
        chosen[:, k] = pick
        between = _distances(points, np.maximum(ordered, 0), points[np.maximum(pick, 0)])
        # squared lengths, so the factor counts squared
        d[(alpha * alpha * between <= d) & any_[:, None]] = np.inf
        d[rows[any_], first[any_]] = np.inf
    return chosen


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(edges n x degree, entry points) of the graph over unit vectors."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    entry = int((points @ points.mean(0)).argmax()) if n else 0
    random = np.random.default_rng(SEED)
    order = random.permutation(n)
    order = np.concatenate(([entry], order[order != entry])) if n else order
    entries = order[:ENTRIES]
    for relax in (1.0, alpha):
        at = 1 if relax == 1.0 else 0
        while at < n:
            batch = order[at : at + max(1, min(at or BLOCK, BLOCK))]
            at += len(batch)
            _, _, expanded = beam_search(points, edges, entries[: max(1, at - len(batch))] if relax == 1.0 else entries, points[batch], beam)
            met = np.full((len(batch), len(expanded)), -1, np.int64)
            for k, (live, node) in enumerate(expanded):
                met[live, k] = node
            edges[batch] = robust_prune(points, batch, np.concatenate((met, edges[batch]), 1), degree, relax)
            _add_back(points, edges, batch, relax)
    return edges, entries


def _add_back(points: np.ndarray, edges: np.ndarray, batch: np.ndarray, alpha: float) -> None:
    """Reverse edges of a batch; full nodes are pruned again."""
    degree = edges.shape[1]
    to = edges[batch].ravel()
    start = np.repeat(batch, degree)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, start = to[order], start[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    more = np.full((len(nodes), counts.max() if len(counts) else 0), -1, np.int64)
    more[np.repeat(np.arange(len(nodes)), counts), np.arange(len(to)) - np.repeat(first, counts)] = start
    both = np.concatenate((edges[nodes], more), 1)
    both.sort(1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    held = (both >= 0).sum(1)
    few = held <= degree
    edges[nodes[few]] = -np.sort(-both[few], 1)[:, :degree]
    if (~few).any():
        edges[nodes[~few]] = robust_prune(points, nodes[~few], both[~few], degree, alpha)


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that can take part, each with a number of its own."""
    whole = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    some = F.exists("vector", lambda x: x != 0)
    rows = vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(whole).where(some)
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector", "asked"))[0]


def nodes_of(rows: DataFrame, held: int) -> DataFrame:
    """vector, rows: the distinct vectors, each with its ``held`` smallest rows (id, row)."""
    rank = F.row_number().over(W.partitionBy("vector").orderBy("id", "row"))
    few = rows.withColumn("_at", rank).where(F.col("_at") <= held)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("rows"))


def _scaled(flat: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and no square overflows."""
    return np.ldexp(flat, -np.frexp(np.abs(flat).max(1, keepdims=True))[1])


def _unit(flat: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow."""
    scaled = _scaled(flat)
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


INDEX = "shard int, dim int, entries array<int>, vectors binary, edges binary, bounds binary, ids binary, numbers binary"


def _index(key: tuple, group: pa.Table) -> pa.Table:
    shard, dim = key[0].as_py(), key[1].as_py()
    group = group.combine_chunks()
    flat = np.asarray(group["vector"].chunk(0).flatten() if group["vector"].num_chunks else [], np.float64).reshape(-1, dim)
    held = [[(r["id"], r["row"]) for r in rows] for rows in group["rows"].to_pylist()]
    order = sorted(range(len(held)), key=lambda i: held[i][0])
    edges, entries = build(_unit(flat[order]))
    rows = np.array([r for i in order for r in held[i]], np.int64).reshape(-1, 2)
    bounds = np.cumsum([0, *(len(held[i]) for i in order)])
    as_bytes = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "entries": pa.array([entries.astype(np.int32)], pa.list_(pa.int32())),
            "vectors": as_bytes(flat[order], np.float64), "edges": as_bytes(edges, np.int32), "bounds": as_bytes(bounds, np.int64),
            "ids": as_bytes(rows[:, 0], np.int64), "numbers": as_bytes(rows[:, 1], np.int64),
        }
    )


class Shard:
    """A shard's graph, ready for queries."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.vectors = _scaled(read("vectors", np.float64).reshape(-1, row["dim"]))
        self.units = _unit(self.vectors)
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(1))
        self.edges = read("edges", np.int32).reshape(len(self.vectors), -1).astype(np.int64)
        self.entries, self.bounds, self.ids, self.numbers = row["entries"], read("bounds", np.int64), read("ids", np.int64), read("numbers", np.int64)

    def search(self, own: np.ndarray, targets: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, list[tuple[float, int, int]]]]:
        """Of each query (its row number, its vector) the k best: (-score, id, row)."""
        nodes, _, _ = beam_search(self.units, self.edges, self.entries, _unit(targets), min(beam, len(self.vectors)))
        targets = _scaled(targets)
        for q, (number, target) in enumerate(zip(own.tolist(), targets, strict=True)):
            found = nodes[q][nodes[q] >= 0]
            scores = (self.vectors[found] * target).sum(1) / (self.lengths[found] * np.sqrt((target * target).sum()))
            best: list[tuple[float, int, int]] = []
            # one node's only row may be the query's own, so k + 1 nodes and their ties hold the k best
            least = -np.partition(-scores, k)[k] if len(found) > k else -np.inf
            for at in np.flatnonzero(scores >= least).tolist():
                node = found[at]
                for r in range(self.bounds[node], self.bounds[node + 1]):
                    if self.numbers[r] != number:
                        best.append((-float(scores[at]), int(self.ids[r]), int(self.numbers[r])))
            yield number, sorted(best)[:k]


def _search(k: int, beam: int):
    """Streams over a shard's graph and the blocks of queries behind it, in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(name)[row] for name in batch.schema.names}
                here = (value["shard"].as_py(), value["dim"].as_py())
                if value["edges"].is_valid:
                    key, shard = here, None
                    shard = Shard({n: v.as_py() if n in ("shard", "dim", "entries") else v.as_buffer() for n, v in value.items() if n in INDEXED})
                elif here == key:  # else the shard has no vectors of this length
                    own = np.asarray(value["own"].values, np.int64)
                    targets = np.asarray(value["queries"].values.flatten(), np.float64).reshape(-1, here[1])
                    out: tuple[list, list, list, list] = ([], [], [], [])
                    for number, best in shard.search(own, targets, k, beam):
                        for s, i, r in best:
                            for column, x in zip(out, (number, i, r, -s), strict=True):
                                column.append(x)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["own", "vec_id", "vec_row", "score"])

    return run


INDEXED = tuple(c.split()[0] for c in INDEX.split(", "))


def nearest(vectors: DataFrame, asked: Column, k: int, *, shard_rows: int = SHARD, beam: int = QUERY_BEAM, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row that is ``asked``.

    ``vectors`` has columns id and vector (array of double).
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("id", "vector", F.coalesce(asked, F.lit(False)).alias("asked")))
    nodes = materialize(nodes_of(rows, k + 1).withColumn("dim", F.size("vector")))[0]
    shards = max(1, -(-nodes.count() // shard_rows))
    placed = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "dim", "vector", "rows")
    # by range, as hashes of the shards' numbers would leave some tasks with two shards and some with none
    index = materialize(placed.repartitionByRange(shards, "shard").groupBy("shard", "dim").applyInArrow(_index, INDEX))[0]
    queries = rows.where("asked")
    count = queries.count()
    blocks, parts = max(1, -(-count // block)), max(1, -(-count // PART))
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    grouped = (
        queries.select("row", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
        .groupBy("block", "dim")
        .agg(F.sort_array(F.collect_list(F.struct("row", "vector"))).alias("q"))
        .select("dim", F.pmod("block", F.lit(parts)).cast("int").alias("part"), F.col("q.row").alias("own"), F.col("q.vector").alias("queries"))
    )
    grouped = materialize(grouped)[0]
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = copies.unionByName(grouped.select("*", each), allowMissingColumns=True)
    dealt = met.repartitionByRange(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "dim", F.col("own").isNotNull())
    with small_batches(spark, 8):
        found = materialize(dealt.mapInArrow(_search(k, beam), "own long, vec_id long, vec_row long, score double"))[0]
    order = W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "vec_row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("own"), F.col("id").alias("query_id"))
    return best.join(named, "own").select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return nearest(rows, F.col("id") % 50 == 0, 5)
