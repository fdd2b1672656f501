"""Whole-graph algorithms as DataFrame loops.

Rounds are cut by durable tables.  The few algorithms that are sequential by nature, or
need the whole graph beside each source, take the edges to one place and refuse graphs
of more than ``SEQUENTIAL_EDGES``.
"""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrel.operators import numbered
from spindrel.operators.fixed import Context, algorithm
from spindrel.operators.numbered import Numbered, OnDisk, looked_up, nodes_by_number
from spindrel.plans import ast as A
from spindrel.sources.durable import bucketed, counted, delete, observed, written

SEQUENTIAL_EDGES = 2_000_000


class Rounds:
    """A table that is rewritten in every round; the last version but one is deleted.

    ``live`` counts the rows that meet a condition, gathered while they are written.
    """

    def __init__(self, df: DataFrame, live: str = "true"):
        self.spark = df.sparkSession
        self.condition = live
        self.df, self.path, self.live = None, None, 0
        self.advance(df)

    def advance(self, df: DataFrame, **metrics: Any) -> dict:
        held = F.count(F.when(F.expr(self.condition), 1))
        new, path, seen = observed(df, _live=held, **metrics)
        if self.path:
            delete(self.spark, self.path)
        self.df, self.path, self.live = new, path, seen["_live"]
        return seen


def collected(edges: DataFrame, what: str) -> list[Any]:
    """Edges on the driver, if they are few enough."""
    rows = edges.limit(SEQUENTIAL_EDGES + 1).collect()
    if len(rows) > SEQUENTIAL_EDGES:
        raise A.ScriptError(f"{what} is sequential and takes at most {SEQUENTIAL_EDGES} edges")
    return rows


def all_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def sort_key(value: Any) -> tuple:
    return (value is not None, value)


@algorithm("DegreeCentrality")
def degree(c: Context) -> DataFrame:
    """node, total, out, in; nodes of the second relation appear with zeros."""
    e = c.input(0).edges()
    end = lambda column, o, i: F.struct(F.col(column).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = e.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    if c.has(1):
        ends = ends.union(c.input(1).nodes().select("node", F.lit(0), F.lit(0)))
    sums = ends.groupBy("node").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))
    return sums.select("node", (F.col("out") + F.col("in")).alias("total"), "out", "in")


def merged_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: nodes merge into the neighbour of smallest keyed hash until no link is left."""
    edges = Rounds(links.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    every = written(nodes.distinct())[0]
    merges: list[DataFrame] = []
    while edges.live:
        key = lambda col: F.xxhash64(F.lit(len(merges)), F.col(col))  # noqa: E731, B023
        way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        both = edges.df.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
        near = both.groupBy("a").agg(F.min_by("b", key("b")).alias("other"))
        into = F.when(key("other") < key("a"), F.col("other")).otherwise(F.col("a"))
        merge, _ = written(near.select(F.col("a").alias("node"), into.alias("into")))
        half = edges.df.join(merge.toDF("a", "x"), "a").select("x", "b")
        edges.advance(half.join(merge.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        merges.append(merge)
    roots = None
    for merge in reversed(merges):
        if roots is None:
            roots = merge.toDF("node", "root")
        else:
            roots = merge.join(roots.toDF("into", "last"), "into", "left").select("node", F.coalesce("last", "into").alias("root"))
        roots, _ = written(roots)
    if roots is None:
        return every.select("node", F.col("node").alias("component"))
    placed = every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("node").alias("component"))
    return placed.join(smallest, "root").select("node", "component")


def group_numbers(labels: DataFrame) -> DataFrame:
    """node and a group number: groups counted from 0 by their smallest node."""
    from spindrel.sources.readers import indexed

    groups, _ = written(labels.select("component").distinct().orderBy("component"))
    ids = indexed(groups.orderBy("component"), True).toDF("grp", "component")
    return labels.join(ids, "component").select("node", "grp")


@algorithm("ConnectedComponents")
def connected_components(c: Context) -> DataFrame:
    e = written(c.input(0).edges())[0]
    nodes = all_nodes(e)
    if c.has(1):
        nodes = nodes.union(c.input(1).nodes()).distinct()
    table, n = nodes_by_number(nodes)
    if n > numbered.MOST_NODES:
        return group_numbers(merged_components(e, nodes))
    groups = np.unique(smallest_reaching(Numbered.of(e, table, n, both=True)), return_inverse=True)[1]
    return looked_up(table, groups, "grp").select("node", "grp")


def smallest_reaching(graph: Numbered) -> np.ndarray:
    """The smallest node of each node's component: trees hang themselves below the smallest neighbour, and are flattened."""
    labels = np.arange(graph.n, dtype=graph.kind)
    while True:
        at, least = graph.round(smaller_neighbour, (labels,))
        if not len(at):
            return labels
        np.minimum.at(labels, labels[at], least.astype(labels.dtype))
        while ((higher := labels[labels]) != labels).any():
            labels = higher


def smaller_neighbour(nodes: np.ndarray, counts: np.ndarray, others: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> tuple:
    """Nodes of a blob with a neighbour of a smaller label, and the smallest such label."""
    least = np.minimum.reduceat(labels[others], np.cumsum(counts) - counts)
    under = least < labels[nodes]
    return nodes[under], least[under]


def spread_min(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest label reaching each node along the edges (labels: node, label)."""
    state = Rounds(labels.select("node", "label", F.lit(True).alias("moved")), "moved")
    while True:
        live = state.df.where("moved").select(F.col("node").alias("src"), F.col("label").alias("offer"))
        best = edges.join(live, "src").groupBy(F.col("dst").alias("node")).agg(F.min("offer").alias("offer"))
        after = state.df.join(best, "node", "left").select(
            "node", F.least("label", "offer").alias("label"), F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("moved")
        )
        state.advance(after)
        if not state.live:
            return state.df.select("node", "label")


@algorithm("StronglyConnectedComponents", "SCC")
def strongly_connected(c: Context) -> DataFrame:
    """Colouring: the smallest node that reaches a node forward is its colour; what reaches
    back to the colour within it is one component."""
    e = written(c.input(0).edges().select("src", "dst").where("src <> dst").distinct())[0]
    nodes = all_nodes(e.select("src", "dst"))
    if c.has(1):
        nodes = nodes.union(c.input(1).nodes()).distinct()
    nodes, _ = written(nodes)
    left_edges, left = Rounds(e), Rounds(nodes)
    found: list[DataFrame] = []
    while left.live:
        colour, _ = written(spread_min(left_edges.df, left.df.select("node", F.col("node").alias("label"))))
        mine = colour.toDF("src", "cs")
        within = left_edges.df.join(mine, "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        back = spread_min_from(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour)
        part, _ = written(back)
        found.append(part)
        left.advance(left.df.join(part.select("node"), "node", "left_anti"))
        kept = left.df.select(F.col("node").alias("src"))
        left_edges.advance(left_edges.df.join(kept, "src", "left_semi").join(left.df.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    out = found[0] if found else nodes.select("node", F.col("node").alias("component"))
    for part in found[1:]:
        out = out.union(part)
    return group_numbers(out)


def spread_min_from(reverse: DataFrame, colour: DataFrame) -> DataFrame:
    """Nodes that reach the root of their colour: node, component."""
    reached = Rounds(colour.where("node = label").select("node", F.col("label").alias("component"), F.lit(True).alias("new")), "new")
    while True:
        live = reached.df.where("new").select(F.col("node").alias("src"), "component")
        more = reverse.join(live, "src").select(F.col("dst").alias("node"), "component").distinct()
        fresh = more.join(reached.df.select("node"), "node", "left_anti").select("node", "component", F.lit(True).alias("new"))
        old = reached.df.select("node", "component", F.lit(False).alias("new"))
        reached.advance(old.unionByName(fresh))
        if not reached.live:
            return reached.df.select("node", "component")


#: Iterations of a ranking that are one query, where none of them has to be looked at.
CHAIN = 5


@algorithm("PageRank")
def pagerank(c: Context) -> DataFrame:
    """node, rank: power iteration; what dangling nodes hold is shared by all.

    Where nodes are too many for an array of them in every task, edges lie in buckets by source, so
    that only ranks move to them.  An iteration is one shuffle then: shares of edges and one row of each
    node, summed by node.
    """
    theta, epsilon, iterations = float(c.option("theta", 0.85)), float(c.option("epsilon", 1e-4)), int(c.option("iterations", 10))
    both = bool(c.option("undirected", False))
    e = written(c.input(0).edges())[0]
    nodes, n = nodes_by_number(all_nodes(e))
    if n <= numbered.MOST_NODES:
        # what a node gets is summed where the edges that lead to it lie
        graph = Numbered.of(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight")), nodes, n, both)
        return looked_up(nodes, power_iteration(graph, theta, epsilon, iterations), "rank").select("node", "rank")
    e = e.union(e.select("dst", "src", "weight")) if both else e
    e = e.select("src", "dst")
    end = lambda column, out: F.struct(F.col(column).alias("node"), F.lit(out).alias("out"))
    ends = e.select(F.inline(F.array(end("src", 1), end("dst", 0))))
    sums = ends.groupBy("node").agg(F.sum("out").alias("outs")).withColumn("id", F.monotonically_increasing_id())
    nodes, _, seen = observed(sums, n=F.count(F.lit(1)), loose=F.count(F.when(F.col("outs") == 0, 1)), edges=F.sum("outs"))
    n, loose, size = seen["n"], seen["loose"], seen["edges"]
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    # numbers instead of names from here on
    ids = nodes.select("node", "id")
    edges = bucketed(e.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").select("s", "d"), "s", size)
    still = nodes.select("id", "outs", F.lit(0.0).alias("got"), F.lit(0.0).alias("before"))
    # each iteration is looked at where a small change may end them, or dangling nodes pass on what they hold
    watched = epsilon > 0 or loose > 0

    def step(ranks: DataFrame, held: float) -> DataFrame:
        """The next ranks; ``held`` is the share of rank on nodes without edges."""
        sent = edges.join(ranks.where("outs > 0").select(F.col("id").alias("s"), (F.col("rank") / F.col("outs")).alias("got")), "s")
        own = ranks.select("id", "outs", F.lit(0.0).alias("got"), F.col("rank").alias("before")) if watched else still
        sums = own.union(sent.select("d", F.lit(0).cast("long"), "got", F.lit(0.0))).groupBy("id")
        sums = sums.agg(F.max("outs").alias("outs"), F.sum("got").alias("got"), F.max("before").alias("before"))
        return sums.select("id", "outs", (F.lit((1 - theta) / n + theta * held / n) + theta * F.col("got")).alias("rank"), "before")

    state = Rounds(nodes.select("id", "outs", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("before")))
    held, done = loose / n, 0
    while done < iterations:
        chain = 1 if watched else min(CHAIN, iterations - done)
        ranks = state.df
        for _ in range(chain):
            ranks = step(ranks, held)
        done += chain
        seen = state.advance(ranks, moved=F.sum(F.abs(F.col("rank") - F.col("before"))), held=F.sum(F.when(F.col("outs") == 0, F.col("rank"))))
        held = seen["held"] or 0.0
        if watched and seen["moved"] < epsilon:
            break
    return ids.join(state.df.select("id", "rank"), "id").select("node", "rank")


def power_iteration(graph: Numbered, theta: float, epsilon: float, iterations: int) -> np.ndarray:
    n, outs = graph.n, np.zeros(graph.n)
    ways = graph.each(lambda nodes, counts, others, weights: np.unique(others, return_counts=True), (), f"node {'int' if graph.kind == '<i4' else 'long'}, k long")
    table = ways.groupBy("node").agg(F.sum("k").alias("k")).toArrow()
    outs[table["node"].to_numpy()] = table["k"].to_numpy()
    ranks, loose = np.full(n, 1.0 / max(n, 1)), outs == 0
    for _ in range(iterations):
        held = ranks[loose].sum()
        at, got = graph.round(received, (np.divide(ranks, outs, out=np.zeros(n), where=~loose),))
        after = np.full(n, (1 - theta) / n + theta * held / n)
        after[at] += theta * got
        moved, ranks = np.abs(after - ranks).sum(), after
        if moved < epsilon:
            break
    return ranks


def received(nodes: np.ndarray, counts: np.ndarray, others: np.ndarray, weights: np.ndarray, shares: np.ndarray) -> tuple:
    return nodes, np.add.reduceat(shares[others], np.cumsum(counts) - counts)


@algorithm("ClusteringCoefficients")
def clustering(c: Context) -> DataFrame:
    """node, coefficient, triangles, degree; each triangle is found once, from its least-degree edge order."""
    e = written(c.input(0).edges(True).select("src", "dst"))[0]
    degrees, _ = written(e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    pairs = e.where("src <> dst").distinct()
    ranked = pairs.join(degrees.toDF("src", "ds"), "src").join(degrees.toDF("dst", "dd"), "dst")
    # from the end with fewer neighbours to the other: wedges stay few even at hubs
    forward, _ = written(ranked.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"))
    wedges = forward.toDF("a", "b").join(forward.toDF("a", "c"), "a").where("b <> c")
    triangles = wedges.join(forward.toDF("b", "c"), ["b", "c"])
    corners = triangles.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = degrees.join(corners, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"), "degree")
    coefficient = F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / F.greatest(F.col("degree") * (F.col("degree") - 1), F.lit(1)))
    return out.select("node", coefficient.alias("coefficient"), "triangles", "degree")


def adjacency(rows: list[Any]) -> dict[Any, list[tuple[Any, float]]]:
    out: dict[Any, list[tuple[Any, float]]] = defaultdict(list)
    for r in rows:
        out[r["src"]].append((r["dst"], r["weight"]))
        out.setdefault(r["dst"], [])
    return dict(out)


def per_source(c: Context, run, schema: str) -> DataFrame:
    """``run(graph, source) -> rows`` for every node, sources in parallel beside a copy of the graph."""
    rows = collected(c.edges(), c.name)
    shared = c.spark.sparkContext.broadcast(adjacency(rows))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    nodes = all_nodes(c.edges()).repartition(c.spark.sparkContext.defaultParallelism)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for batch in batches:
            out = [row for source in batch["node"].tolist() for row in run(graph, source)]
            yield pd.DataFrame(out, columns=names)

    return nodes.mapInPandas(each, schema)


def distances(graph: dict, source: Any) -> dict[Any, float]:
    done: dict[Any, float] = {}
    heap: list[tuple[float, int, Any]] = [(0.0, 0, source)]
    pushed = 0
    while heap:
        d, _, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = d
        for to, w in graph.get(node, ()):
            if to not in done:
                pushed += 1
                heapq.heappush(heap, (d + w, pushed, to))
    return done


def node_type(c: Context) -> str:
    return c.input(0).edges().schema["src"].dataType.simpleString()


@algorithm("ClosenessCentrality")
def closeness(c: Context) -> DataFrame:
    """node, nc^2 / total distance / (n - 1), where nc nodes are reached, itself included."""
    n = all_nodes(c.edges()).count()

    def run(graph: dict, source: Any) -> list[tuple]:
        found = distances(graph, source)
        total = sum(found.values())
        return [(source, len(found) ** 2 / total / (n - 1) if total and n > 1 else 0.0)]

    return per_source(c, run, f"node {node_type(c)}, centrality double")


@algorithm("BetweennessCentrality")
def betweenness(c: Context) -> DataFrame:
    """node, the shares of shortest paths that it lies inside, over all ordered pairs."""

    def run(graph: dict, source: Any) -> list[tuple]:
        order, before, paths, at = [], defaultdict(list), defaultdict(float), {source: 0.0}
        paths[source] = 1.0
        done: set = set()
        heap: list[tuple[float, int, Any]] = [(0.0, 0, source)]
        pushed = 0
        while heap:
            d, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            order.append(node)
            for to, w in graph.get(node, ()):
                if to == node:
                    continue
                far = d + w
                if to not in at or far < at[to]:
                    at[to], paths[to], before[to] = far, paths[node], [node]
                    pushed += 1
                    heapq.heappush(heap, (far, pushed, to))
                elif far == at[to] and to not in done:
                    paths[to] += paths[node]
                    before[to].append(node)
        share: dict[Any, float] = defaultdict(float)
        for node in reversed(order):
            for b in before[node]:
                share[b] += paths[b] / paths[node] * (1 + share[node])
        return [(node, share[node] if node != source else 0.0) for node in done]

    parts = per_source(c, run, f"node {node_type(c)}, part double")
    return parts.groupBy("node").agg(F.sum("part").alias("centrality"))


@algorithm("MinimumSpanningForestKruskal")
def kruskal(c: Context) -> DataFrame:
    """src, dst, cost of a minimum forest, by Boruvka rounds: each component takes its cheapest edge out."""
    e = c.input(0).edges(negative=True).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    e, _ = written(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    labels = written(all_nodes(e).select("node", F.col("node").alias("component")))[0]
    chosen: list[DataFrame] = []
    while True:
        named = e.join(labels.toDF("src", "x"), "src").join(labels.toDF("dst", "y"), "dst").where("x <> y")
        named, _, left = counted(named)
        if not left:
            break
        edge = F.struct("weight", "src", "dst")
        best = named.select(F.col("x").alias("own"), edge.alias("edge")).union(named.select("y", edge)).groupBy("own").agg(F.min("edge").alias("edge"))
        taken, _ = written(best.select("edge.src", "edge.dst", "edge.weight").distinct())
        chosen.append(taken)
        hops = taken.join(labels.toDF("src", "x"), "src").join(labels.toDF("dst", "y"), "dst").select(F.col("x").alias("src"), F.col("y").alias("dst"))
        joined = merged_components(hops, hops.select(F.col("src").alias("node")).union(hops.select("dst")))
        moved = labels.join(joined.toDF("component", "into"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        labels = written(moved)[0]
    if not chosen:
        return e.select("src", "dst", F.col("weight").alias("cost"))
    out = chosen[0]
    for more in chosen[1:]:
        out = out.union(more)
    return out.select("src", "dst", F.col("weight").alias("cost"))


@algorithm("MinimumSpanningTreePrim")
def prim(c: Context) -> DataFrame:
    """src, dst, cost of the minimum tree of the start's component (the smallest node's without a start)."""
    rows = collected(c.input(0).edges(True), c.name)
    graph = adjacency(rows)
    starts = c.input(1).nodes().limit(1).collect() if c.has(1) else []
    schema = f"src {node_type(c)}, dst {node_type(c)}, cost double"
    if not graph:
        return c.spark.createDataFrame([], schema)
    start = starts[0]["node"] if starts else min(graph, key=sort_key)
    if start not in graph:
        raise A.ScriptError("the start is not in the graph")
    done, out, pushed = {start}, [], 0
    heap = [(w, i, start, to) for i, (to, w) in enumerate(graph[start])]
    heapq.heapify(heap)
    pushed = len(heap)
    while heap:
        w, _, a, b = heapq.heappop(heap)
        if b in done:
            continue
        done.add(b)
        out.append((a, b, w))
        for to, cost in graph[b]:
            if to not in done:
                pushed += 1
                heapq.heappush(heap, (cost, pushed, b, to))
    return c.spark.createDataFrame(out, schema)


@algorithm("TopSort")
def top_sort(c: Context) -> DataFrame:
    """index, node in an order that no edge goes against; nodes on or behind cycles are left out."""
    from spindrel.sources.readers import indexed

    e = written(c.input(0).edges().select("src", "dst").distinct())[0]
    left_edges, nodes = Rounds(e), Rounds(all_nodes(e))
    layers: list[DataFrame] = []
    while True:
        free, _, count = counted(nodes.df.join(left_edges.df.select(F.col("dst").alias("node")), "node", "left_anti"))
        if not count:
            break
        layers.append(free.select(F.lit(len(layers)).alias("layer"), "node"))
        nodes.advance(nodes.df.join(free, "node", "left_anti"))
        left_edges.advance(left_edges.df.join(free.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"))
    if not layers:
        return nodes.df.limit(0).select(F.lit(0).cast("long").alias("index"), "node")
    out = layers[0]
    for layer in layers[1:]:
        out = out.union(layer)
    placed = written(out.orderBy("layer", "node"))[0]
    return indexed(placed.orderBy("layer", "node"), True).toDF("index", "layer", "node").select("index", "node")


@algorithm("LabelPropagation")
def label_propagation(c: Context) -> DataFrame:
    """label, node: nodes take the label that weighs most among their neighbours, smallest first in a tie."""
    steps, undirected = int(c.option("max_iter", 10)), bool(c.option("undirected", False))
    e = written(c.input(0).edges())[0]
    nodes, n = nodes_by_number(all_nodes(e))
    if n > numbered.MOST_NODES:
        return shuffled_labels(e.union(e.select("dst", "src", "weight")) if undirected else e, steps)
    graph = Numbered.of(e, nodes, n, both=undirected)
    table = nodes.select("id", F.xxhash64("node").alias("h")).toArrow()
    hashes, labels = np.empty(n, np.int64), np.arange(n, dtype=graph.kind)
    hashes[table["id"].to_numpy()] = table["h"].to_numpy()
    for step in range(steps):
        # half of the nodes move in a round, so that two neighbours do not swap for ever
        at, best = graph.round(heaviest_label, (labels, (hashes >> (step % 60)) % 2 == 0))
        labels[at] = best
        if not len(at) and step:
            break
    names = nodes.select(F.col("id").alias("l"), F.col("node").alias("label"))
    return looked_up(nodes, labels, "l").join(names, "l").select("label", "node")


def heaviest_label(nodes: np.ndarray, counts: np.ndarray, others: np.ndarray, weights: np.ndarray, labels: np.ndarray, turn: np.ndarray) -> tuple:
    """Nodes of a blob whose turn it is and that change, and their labels."""
    moves = turn[nodes]
    on = np.repeat(moves, counts)
    place = np.repeat(np.arange(len(nodes)), counts)[on]
    pairs, at = np.unique(place * len(labels) + labels[others[on]], return_inverse=True)
    sums = np.bincount(at, weights[on], len(pairs))
    place, label = pairs // len(labels), pairs % len(labels)
    order = np.lexsort((label, -sums, place))
    where, first = np.unique(place[order], return_index=True)
    best, at = label[order][first], nodes[where]
    changed = best != labels[at]
    return at[changed], best[changed]


def shuffled_labels(e: DataFrame, steps: int) -> DataFrame:
    """Label propagation where nodes are too many for an array of them in every task."""
    e = written(e)[0]
    nodes = all_nodes(e)
    state = Rounds(nodes.select("node", F.xxhash64("node").alias("h"), F.col("node").alias("label")))
    for step in range(steps):
        seen = e.join(state.df.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = seen.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("best"))
        # half of the nodes move in a round, so that two neighbours do not swap for ever
        turn = F.pmod(F.shiftright("h", step % 60), F.lit(2)) == 0
        after = state.df.join(best, "node", "left").select("node", "h", F.col("label").alias("before"), F.when(turn, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"))
        changed = state.advance(after, changed=F.count(F.when(F.col("before") != F.col("label"), 1)))["changed"]
        if not changed and step:
            break
    return state.df.select("label", "node")


@algorithm("CommunityDetectionLouvain")
def louvain(c: Context) -> DataFrame:
    """labels (coarsest first, at most ``keep_depth``), node.

    Moves of single nodes are sequential: they read neighbours from a file of the driver and hold numbers of
    nodes only.  Communities are merged by tasks.
    """
    undirected = bool(c.option("undirected", False))
    delta, most, depth = float(c.option("delta", 1e-4)), int(c.option("max_iter", 10)), c.option("keep_depth", None)
    # both ways in any case; a directed edge counts half each way
    share = F.col("weight") if undirected else F.col("weight") / 2
    e = written(c.input(0).edges().select("src", "dst", share.alias("weight")))[0]
    nodes, n = nodes_by_number(all_nodes(e))
    graph = Numbered.of(e, nodes, n, both=True)
    levels: list[np.ndarray] = []
    for _ in range(most):
        labels, gain = local_moves(OnDisk(graph), graph.n, most)
        groups, labels = np.unique(labels, return_inverse=True)
        levels.append(labels if not levels else labels[levels[-1]])
        if gain <= delta or len(groups) == graph.n:
            break
        met = graph.each(merged_links, (labels,), "s long, d long, w double")
        graph = Numbered(met.groupBy("s", "d").agg(F.sum("w").alias("w")), len(groups))
    out = nodes
    kept = levels[::-1][: int(depth)] if depth else levels[::-1]
    for i, labels in enumerate(kept):
        out = looked_up(out, labels, f"l{i}")
    return out.select(F.array(*[f"l{i}" for i in range(len(kept))]).cast("array<bigint>").alias("labels"), "node")


def merged_links(nodes: np.ndarray, counts: np.ndarray, others: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> tuple:
    """The links of a blob between communities, each pair once."""
    size = int(labels.max()) + 1
    pairs, at = np.unique(np.repeat(labels[nodes], counts) * size + labels[others], return_inverse=True)
    return pairs // size, pairs % size, np.bincount(at, weights, len(pairs))


def local_moves(graph: OnDisk, n: int, most: int) -> tuple[np.ndarray, float]:
    """Labels after moving single nodes while modularity grows, and by how much it grew."""
    strength = array("d", bytes(8 * n))
    for i in range(n):
        strength[i] = sum(graph.weighed(i)[1])
    total = sum(strength) or 1.0
    labels, held = array("q", range(n)), array("d", strength)
    gained = 0.0
    for _ in range(most):
        moved = 0.0
        for i in range(n):
            around: dict[int, float] = defaultdict(float)
            for j, w in zip(*graph.weighed(i), strict=True):
                if j != i:
                    around[labels[j]] += w
            own, mine = labels[i], strength[i]
            held[own] -= mine
            stay = around.get(own, 0.0) - mine * held[own] / total
            best, most_gain = own, stay
            for label in sorted(around):
                value = around[label] - mine * held[label] / total
                if value > most_gain + 1e-12:
                    best, most_gain = label, value
            held[best] += mine
            labels[i] = best
            moved += most_gain - stay
        gained += 2 * moved / total
        if moved <= 1e-12:
            break
    return np.array(labels, np.int64), gained


@algorithm("RandomWalk")
def random_walk(c: Context) -> DataFrame:
    """walk, start, path: from every start ``iterations`` walks of up to ``steps`` edges."""
    steps, iterations = int(c.option("steps")), int(c.option("iterations", 1))
    source = c.input(0)
    weight = source.scope().compile(c.expression("weight")).col.cast("double") if c.expression("weight") is not None else F.lit(1.0)
    e = written(source.df.select(source.column(0).alias("src"), source.column(1).alias("dst"), weight.alias("w")).where("w > 0"))[0]
    starts = c.input(2 if c.has(2) else 1).nodes().distinct()
    first = starts.select("node", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("turn"))
    state = Rounds(first.select(F.monotonically_increasing_id().alias("walk"), F.col("node").alias("start"), F.array("node").alias("path"), F.col("node").alias("at"), F.lit(True).alias("live")), "live")
    for _ in range(steps):
        options = state.df.where("live").join(e, F.col("at") == F.col("src")).withColumn("draw", F.ln(1 - F.rand()) / F.col("w"))
        # the largest u^(1/w) is a draw in proportion to the weights
        drawn = options.groupBy("walk").agg(F.max_by("dst", "draw").alias("next"))
        drawn = drawn.withColumnRenamed("walk", "w_")
        after = state.df.join(drawn, F.col("walk") == F.col("w_"), "left").select(
            "walk", "start", F.when(F.col("next").isNotNull(), F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"),
            F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("live"),
        )
        state.advance(after)
        if not state.live:
            break
    return state.df.select("walk", "start", "path")
