"""Searches and shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.operators.fixed import Context, algorithm
from spindrel.operators.graph import Rounds, adjacency, all_nodes, collected, node_type
from spindrel.operators.numbered import Numbered, OnDisk, by_number, nodes_by_number
from spindrel.plans import ast as A
from spindrel.sources.durable import counted, written


def tested(c: Context) -> DataFrame:
    """Nodes that meet the condition option."""
    nodes = c.input(1)
    condition = c.expression("condition")
    if condition is None:
        raise A.ScriptError(f"{c.name} needs the option condition")
    return nodes.df.where(nodes.scope().test(condition)).select(nodes.column(0).alias("node"))


@algorithm("BreadthFirstSearch", "BFS")
def bfs(c: Context) -> DataFrame:
    """start, found, path; nodes are visited once over all starts, and a start is not tested."""
    e = written(c.input(0).edges().select("src", "dst").distinct())[0]
    wanted = written(tested(c).distinct())[0]
    limit = int(c.option("limit", 1))
    starts = c.input(2 if c.has(2) else 1).nodes().distinct()
    seen = Rounds(starts.select("node"))
    front = Rounds(starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")))
    found: list[DataFrame] = []
    count = 0
    while count < limit and front.live:
        step = front.df.withColumnRenamed("node", "src").join(e, "src").join(seen.df.select(F.col("node").alias("dst")), "dst", "left_anti")
        best = step.groupBy(F.col("dst").alias("node")).agg(F.min_by(F.struct("start", "path"), F.struct("start", "path")).alias("b"))
        front.advance(best.select("b.start", "node", F.array_append("b.path", F.col("node")).alias("path")))
        seen.advance(seen.df.union(front.df.select("node")))
        hits, _, more = counted(front.df.join(wanted, "node", "left_semi").select("start", F.col("node").alias("found"), "path"))
        found.append(hits)
        count += more
    if not found:
        return front.df.select("start", F.col("node").alias("found"), "path").limit(0)
    out = found[0]
    for hits in found[1:]:
        out = out.union(hits)
    return out.orderBy(F.size("path"), "start", "path").limit(limit)


@algorithm("DepthFirstSearch", "DFS")
def dfs(c: Context) -> DataFrame:
    """start, found, path; the start is tested too.

    The search is sequential: it reads neighbours from a file of the driver, smallest first, and
    holds numbers of nodes only.  Paths are put together by tasks, from the node that each one came from.
    """
    e = written(c.input(0).edges().where("weight >= 0"))[0]
    starts = c.input(2 if c.has(2) else 1).nodes().distinct()
    # what is sought counts only where the search can come to it
    flags = all_nodes(e).select("node", F.lit(0).alias("s")).union(starts.select("node", F.lit(1))).groupBy("node").agg(F.max("s").alias("s"))
    wanted = tested(c).distinct().select(F.col("node").alias("x"), F.lit(1).alias("w"))
    nodes, n = nodes_by_number(flags.join(wanted, F.col("node").eqNullSafe(F.col("x")), "left").select("node", "s", F.coalesce("w", F.lit(0)).alias("w")))
    marked = nodes.where("s = 1 or w = 1").select("id", "s", "w").toArrow()
    ids, first, sought = (marked[x].to_numpy() for x in ("id", "s", "w"))
    came, found = depth_first(OnDisk(Numbered.of(e, nodes, n)), n, np.sort(ids[first == 1]), ids[sought == 1], int(c.option("limit", 1)))
    kind = node_type(c)
    schema = f"start {kind}, found {kind}, path array<{kind}>"
    if not len(found):
        return c.spark.createDataFrame([], schema)
    shared = c.spark.sparkContext.broadcast((came, found, by_number(nodes, "node", n)))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came, found, names = shared.value

        def packed(some: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in some])
            steps = names.take(pa.array(np.concatenate(some)))
            whole = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), steps)
            return pa.RecordBatch.from_arrays([steps.take(pa.array(ends - [len(x) for x in some])), steps.take(pa.array(ends - 1)), whole], ["start", "found", "path"])

        for batch in batches:
            some: list[np.ndarray] = []
            size = 0
            for i in batch.column(0).to_pylist():
                path = [int(found[i])]
                while (before := int(came[path[-1]])) != path[-1]:
                    path.append(before)
                some.append(np.array(path[::-1]))
                size += len(path)
                if size >= STEPS_AT_ONCE:
                    yield packed(some)
                    some, size = [], 0
            if some:
                yield packed(some)

    return written(c.spark.range(0, len(found), 1, min(len(found), 4 * c.spark.sparkContext.defaultParallelism)).mapInArrow(paths, schema))[0]


#: Steps of paths in an Arrow batch, unless one path has more.
STEPS_AT_ONCE = 250_000


def depth_first(graph: OnDisk, n: int, starts: np.ndarray, sought: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The node that each visited node was entered from (a start: itself), and the sought nodes in the order of their visit."""
    came, wanted, at = np.full(n, -1, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    wanted[sought] = True
    found: list[int] = []
    for start in starts.tolist():
        if came[start] >= 0 or len(found) >= limit:
            continue
        came[start] = start
        found += [start] * bool(wanted[start])
        node = start
        while len(found) < limit:
            # the smallest neighbour that is not visited yet; those before ``at`` are
            rest = graph.neighbours(node)[at[node] :]
            to, first, width = -1, 0, 16
            while to < 0 and first < len(rest):
                some = rest[first : first + width]
                open_ = came[some] < 0
                i = int(open_.argmax())
                if open_[i]:
                    to = int(some[i])
                    at[node] += first + i + 1
                first, width = first + width, width * 4
            if to < 0:
                at[node] += len(rest)
                if came[node] == node:
                    break
                node = int(came[node])
                continue
            came[to] = node
            found += [to] * bool(wanted[to])
            node = to
    return came, np.array(found, np.int64)


@algorithm("ShortestPathBFS")
def shortest_bfs(c: Context) -> DataFrame:
    """start, end, path with the fewest edges, or null; a start is not reached from itself."""
    e = written(c.input(0).edges().select("src", "dst").distinct())[0]
    starts, ends = c.input(1).nodes().distinct(), written(c.input(2).nodes().distinct())[0]
    seen = Rounds(starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path"), F.lit(0).alias("hops")))
    hops = 0
    while True:
        live = seen.df.where(F.col("hops") == hops).select("start", F.col("node").alias("src"), "path")
        step = live.join(e, "src").groupBy("start", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        fresh = step.join(seen.df.select("start", "node"), ["start", "node"], "left_anti")
        hops += 1
        fresh = fresh.select("start", "node", F.array_append("path", F.col("node")).alias("path"), F.lit(hops).alias("hops"))
        if not seen.advance(seen.df.unionByName(fresh), fresh=F.count(F.when(F.col("hops") == hops, 1)))["fresh"]:
            break
    pairs = starts.select(F.col("node").alias("start")).crossJoin(ends.select(F.col("node").alias("end")))
    known = seen.df.where("hops > 0").select(F.col("start").alias("s"), F.col("node").alias("n"), "path")
    return pairs.join(known, (F.col("start") == F.col("s")) & (F.col("end") == F.col("n")), "left").select("start", "end", "path")


def cheapest(e: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, cost, path: all cheapest paths, rounds of relaxing what moved last."""
    state = Rounds(starts.select(F.col("node").alias("start"), "node", F.lit(0.0).alias("cost"), F.array("node").alias("path"), F.lit(True).alias("moved")), "moved")
    while True:
        live = state.df.where("moved").select("start", F.col("node").alias("src"), "cost", "path")
        offers = live.join(e, "src").select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), "path")
        rank = F.struct("cost", F.size("path").alias("n"), "path")
        best = offers.groupBy("start", "node").agg(F.min(rank).alias("o"))
        both = state.df.join(best, ["start", "node"], "full_outer")
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.cost") < F.col("cost")))
        after = both.select(
            "start", "node", F.when(better, F.col("o.cost")).otherwise(F.col("cost")).alias("cost"),
            F.when(better, F.array_append("o.path", F.col("node"))).otherwise(F.col("path")).alias("path"), better.alias("moved"),
        )
        state.advance(after)
        if not state.live:
            return state.df.select("start", "node", "cost", "path")


def between(c: Context, e: DataFrame, starts: DataFrame, ends: DataFrame | None) -> DataFrame:
    """start, end, cost, path; unreachable ends cost infinity."""
    known = cheapest(e, starts)
    if ends is None:
        return known.select("start", F.col("node").alias("end"), "cost", "path")
    pairs = starts.select(F.col("node").alias("start")).crossJoin(ends.select(F.col("node").alias("end")))
    found = known.select(F.col("start").alias("s"), F.col("node").alias("n"), "cost", "path")
    out = pairs.join(found, (F.col("start") == F.col("s")) & (F.col("end") == F.col("n")), "left")
    empty = F.array().cast(known.schema["path"].dataType)
    return out.select("start", "end", F.coalesce("cost", F.lit(float("inf"))).alias("cost"), F.coalesce("path", empty).alias("path"))


@algorithm("ShortestPathDijkstra")
def dijkstra(c: Context) -> DataFrame:
    e = written(c.edges().groupBy("src", "dst").agg(F.min("weight").alias("weight")))[0]
    starts = c.input(1).nodes().distinct()
    ends = c.input(2).nodes().distinct() if c.has(2) else None
    out = between(c, e, starts, ends)
    return tied(e, out) if c.option("keep_ties", False) else out


def tied(e: DataFrame, best: DataFrame) -> DataFrame:
    """All cheapest paths of each pair: walked back along edges that lie on some cheapest path."""
    best = written(best)[0]
    starts = best.select(F.col("start").alias("node")).distinct()
    costs = written(cheapest(e, starts).select("start", "node", "cost"))[0]
    on = e.join(costs.toDF("start", "src", "cs"), "src").join(costs.toDF("start", "dst", "cd"), ["start", "dst"])
    tight = written(on.where(F.abs(F.col("cs") + F.col("weight") - F.col("cd")) <= 1e-9 * (1 + F.abs("cd"))).select("start", "src", "dst"))[0]
    reached = best.where(F.col("cost") < float("inf"))
    open_ = Rounds(reached.select("start", "end", "cost", F.array("end").alias("path"), F.col("end").alias("at")))
    done: list[DataFrame] = []
    while open_.live:
        done.append(written(open_.df.where("at = start").select("start", "end", "cost", "path"))[0])
        back = open_.df.where("at <> start").join(tight.toDF("start", "src", "at"), ["start", "at"])
        open_.advance(back.where(~F.array_contains("path", F.col("src"))).select("start", "end", "cost", F.array_prepend("path", F.col("src")).alias("path"), F.col("src").alias("at")))
    out = best.where(F.col("cost") == float("inf"))
    for part in done:
        out = out.union(part)
    return out


@algorithm("ShortestPathAStar")
def a_star(c: Context) -> DataFrame:
    """start, goal, cost, path.  With an admissible heuristic A* finds the cheapest path, which
    is what the relaxing rounds find for all pairs at once; the heuristic only steers a
    search that visits one node at a time, so it is checked to compile and not used."""
    nodes, goals = c.input(1), c.input(3)
    heuristic = c.expression("heuristic")
    if heuristic is None:
        raise A.ScriptError("ShortestPathAStar needs the option heuristic")
    known = {*nodes.bindings, *goals.bindings}
    if missing := A.variables(heuristic) - known:
        raise A.ScriptError(f"the heuristic uses {', '.join(sorted(missing))}, which no relation binds")
    e = written(c.edges().groupBy("src", "dst").agg(F.min("weight").alias("weight")))[0]
    return between(c, e, c.input(2).nodes().distinct(), goals.nodes().distinct())


def one_path(graph: dict, start: Any, end: Any, off: set, gone: set) -> tuple[float, list] | None:
    """The cheapest path that avoids edges ``off`` and nodes ``gone``."""
    heap: list[tuple] = [(0.0, 1, [start])]
    done: set = set()
    while heap:
        cost, n, path = heapq.heappop(heap)
        node = path[-1]
        if node == end:
            return cost, path
        if node in done:
            continue
        done.add(node)
        for to, w in graph.get(node, ()):
            if to not in done and to not in gone and (node, to) not in off:
                heapq.heappush(heap, (cost + w, n + 1, [*path, to]))
    return None


def k_paths(graph: dict, start: Any, end: Any, k: int) -> list[tuple[float, list]]:
    """The k cheapest loopless paths: each next one leaves a known one at some node."""
    costs = {(a, b): w for a, out in graph.items() for b, w in sorted(out, key=lambda x: -x[1])}
    first = one_path(graph, start, end, set(), set())
    if first is None:
        return []
    known, candidates, listed = [first], [], {tuple(first[1])}
    while len(known) < k:
        path = known[-1][1]
        for i in range(len(path) - 1):
            root = path[: i + 1]
            off = {(p[i], p[i + 1]) for _, p in known if p[: i + 1] == root and len(p) > i + 1}
            found = one_path(graph, path[i], end, off, set(root[:-1]))
            if found is not None:
                whole = root[:-1] + found[1]
                if tuple(whole) not in listed:
                    listed.add(tuple(whole))
                    cost = sum(costs[x] for x in zip(root, root[1:], strict=False)) + found[0]
                    heapq.heappush(candidates, (cost, len(whole), whole))
        if not candidates:
            break
        cost, _, path = heapq.heappop(candidates)
        known.append((cost, path))
    return known


@algorithm("KShortestPathYen")
def yen(c: Context) -> DataFrame:
    """start, end, cost, path of the k cheapest loopless paths, pairs in parallel beside a copy of the graph."""
    k = int(c.option("k"))
    shared = c.spark.sparkContext.broadcast(adjacency(collected(c.edges(), c.name)))
    kind = node_type(c)
    pairs = c.input(1).nodes().distinct().select(F.col("node").alias("start")).crossJoin(c.input(2).nodes().distinct().select(F.col("node").alias("end")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, b, cost, path) for a, b in zip(batch["start"].tolist(), batch["end"].tolist(), strict=True) for cost, path in k_paths(shared.value, a, b, k)]
            yield pd.DataFrame(rows, columns=["start", "end", "cost", "path"])

    return pairs.mapInPandas(run, f"start {kind}, end {kind}, cost double, path array<{kind}>")
