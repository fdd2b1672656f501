"""MinHash near-duplicate detection: components of the documents linked by similarity.

Shingles are distinct runs of five words, hashed to 64 bits; the similarity of two
documents is the Jaccard similarity of their whole shingle sets, and two are linked when
``100 * intersection >= 75 * union``.

1. One-permutation hashing: a set's smallest value in each of ``BANDS * ROWS`` ranges,
   empty ranges filled by optimal densification (each borrows the first non-empty range
   of its own random sequence).  ``ROWS`` values make a band, a band hash a bucket.
   A pair at 0.75 shares no bucket with a chance of (1 - 0.75^5)^50, about one in 10^6.
2. Documents of equal sets collapse into their smallest id before banding.
3. A bucket proposes star-shaped edges from one centre to its members, so a bucket of
   m members gives m - 1 pairs; centres differ from bucket to bucket.
4. Candidates are confirmed on their full sets, and components found by merging nodes
   into neighbours until no link is left between different nodes.
5. A star can miss a link between two members that are not linked to its centre.  In
   every bucket that still spans several components, all members outside the largest
   become centres: any pair of different components has one of them, so no pair in a
   bucket is left undecided.  Bounded blocks of centres meet bounded slices of members,
   and only links that join components leave them.

Defined results: no words or a null text: size 0, linked with nothing; fewer than five
words: the whole sequence is the one shingle; equal texts are linked; rows that share a
doc_id are one document with the links of each, whatever their texts; a null doc_id stays
alone and is kept; a very long text is hashed piece by piece and keeps its whole set;
other columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrel.llm.common import discard, materialize, small_batches, table

WORDS = 5
PERCENT = 75
BANDS, ROWS = 50, 5
SEED = 20
CHUNK_BYTES = 1 << 19
LONG_WORD = 512
BATCH_ROWS = 1_000
GROUP_SHINGLES = 1 << 17

U = np.uint64
_random = np.random.default_rng(SEED)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=U)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP = _random.integers(0, 1 << 63, 8, dtype=U) * U(2) + U(1)
_ATTEMPTS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES), base, U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _long_word(word: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(word.tobytes().lower())


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and the words in each text."""
    if len(bounds) == 2 and len(data) > 2 * CHUNK_BYTES:
        whole = np.concatenate([*_pieces(data)])
        return whole, np.array([len(whole)])
    return _hashed(data, bounds)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of one long text, a bounded piece that ends between words at a time."""
    at = 0
    while at < len(data):
        to = min(len(data), at + CHUNK_BYTES)
        blank = np.flatnonzero(~_IN_WORD[data[at:to]])
        start = at + int(blank[-1]) + 1 if len(blank) else at
        while to < len(data) and _IN_WORD[data[to]]:  # to the end of the word that the cut would fall into
            more = np.flatnonzero(~_IN_WORD[data[to : to + CHUNK_BYTES]])
            to = to + int(more[0]) if len(more) else min(len(data), to + CHUNK_BYTES)
        if to - start <= LONG_WORD:
            start = to
        if start > at:
            yield _hashed(data[at:start], np.array([0, start - at]))[0]
        if to > start:
            yield np.array([_long_word(data[start:to])], U)
        at = to


def _hashed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(bounds) - 1, np.int64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]  # a text's end is a word's end
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _STEP[0])
    for i in np.flatnonzero(end - start > LONG_WORD):  # long words can be made to agree in any such sum
        hashes[i] = _long_word(data[start[i] : end[i]])
    return hashes, np.diff(np.searchsorted(start, bounds))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(data, bounds)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(hashes) - words + 1), U)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _STEP[1 + k % 6] * U(2 * k + 1)
    rolled = mix(rolled)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[end - n : end - words + 1]))
        elif n:
            whole = hashes[end - n : end] * (np.arange(1, n + 1, dtype=U) * U(2) + U(1)) * _STEP[7]
            out.append(mix(np.add.reduce(whole, keepdims=True) + U(n)))
        else:
            out.append(hashes[:0])
    return out


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.size = bands, rows, bands * rows
        random = np.random.default_rng(SEED + 1)
        self.borrow = random.integers(0, self.size, (_ATTEMPTS, self.size), dtype=np.int32)
        self.coefficient = random.integers(0, 1 << 63, rows, dtype=U) * U(2) + U(1)
        self.offset = random.integers(0, 1 << 64, bands, dtype=U)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """sets (none empty) by bands."""
        lengths = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), lengths)
        slot = owner * self.size + ((values >> U(32)) * U(self.size) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))  # sorted, so the first of a range is its smallest
        signature = np.zeros(len(sets) * self.size, U)
        filled = np.zeros(len(sets) * self.size, bool)
        signature[slot[first]] = values[first]
        filled[slot[first]] = True
        empty = np.flatnonzero(~filled)
        row, column = empty // self.size, empty % self.size
        for attempt in self.borrow:
            if not len(empty):
                break
            source = row * self.size + attempt[column]
            found = filled[source]
            signature[empty[found]] = signature[source[found]]
            empty, row, column = empty[~found], row[~found], column[~found]
        while len(empty):  # after so many attempts: the next non-empty range
            column = (column + 1) % self.size
            source = row * self.size + column
            found = filled[source]
            signature[empty[found]] = signature[source[found]]
            empty, row, column = empty[~found], row[~found], column[~found]
        bands = signature.reshape(len(sets), self.bands, self.rows)
        return mix((bands * self.coefficient).sum(2, dtype=U) + self.offset)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string array of about CHUNK_BYTES: from, to, bytes, bounds."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        bounds = offsets[at : to + 1]
        yield at, to, data[bounds[0] : bounds[-1]], bounds - bounds[0]
        at = to


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands, rows)
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                sets = shingle_sets(data, bounds, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = sign([sets[i] for i in full]) if full else np.zeros((0, bands), U)
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[1:] = np.cumsum([bands if len(s) else 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([np.add.reduce(mix(s)) for s in sets], U).view(np.int64)),
                        pa.array(np.array([np.add.reduce(mix(s + _STEP[0])) for s in sets], U).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                sets = shingle_sets(data, bounds, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set"]
                )

    return run


def _confirm(percent: int):
    """Keeps the pairs whose sets are similar enough; sorted pairs repeat their first set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = np.concatenate((x, y))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            where = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(where), batch.column(1).filter(where)], names=["a", "b"])

    return run


def _joining(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of one group (columns centre, rank, component, rep, set) that join its components."""
    centre = np.asarray(group["centre"])
    rank, component, rep = (np.asarray(group[c]) for c in ("rank", "component", "rep"))
    sets = [np.frombuffer(x.as_buffer(), U) for x in group["set"]]
    of = np.flatnonzero(~centre)
    if not len(of) or not centre.any() or component.min() == component.max():
        return []
    sizes = np.array([len(sets[i]) for i in of])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    vocabulary, ids = np.unique(np.concatenate([sets[i] for i in of]), return_inverse=True)
    label = {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    out = []
    for i in np.flatnonzero(centre):
        own = sets[i]
        rest = (rank[of] > rank[i]) & (component[of] != component[i]) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
        if not rest.any():
            continue
        at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
        mark = np.zeros(len(vocabulary), np.int32)
        mark[at[vocabulary[at] == own]] = 1
        shared = np.add.reduceat(mark[ids], starts)
        for j in of[rest & (100 * shared >= percent * (sizes + len(own) - shared))]:
            x, y = root(int(component[i])), root(int(component[j]))
            if x != y:
                label[x] = y
                out.append((int(rep[i]), int(rep[j])))
    return out


def _block_links(percent: int):
    """Streams over rows sorted by (bucket, block, slice), a group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def finish() -> pa.RecordBatch:
            links = _joining(pa.concat_tables(held), percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

        last = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                key = tuple(keys[a])
                if held and key != last:
                    yield finish()
                last = key
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield finish()

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b).

    Each round a node is merged into the neighbour (or itself) of the smallest keyed
    hash, with another key every time, and the links between merged nodes go; a constant
    share of the nodes is expected to vanish per round, whatever the shape.  The rounds'
    small merge tables are then composed from the last to the first.
    """
    spark = links.sparkSession
    edges, path = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = materialize(links.select(F.col("a").alias("node")).union(links.select("b")).distinct())[0]
    merges: list[DataFrame] = []
    while not edges.isEmpty():
        key = lambda c: F.xxhash64(F.lit(len(merges)), F.col(c))  # noqa: E731, B023
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min_by("b", key("b")).alias("other"))
        merge, _ = materialize(near.select(F.col("a").alias("node"), F.when(key("other") < key("a"), F.col("other")).otherwise(F.col("a")).alias("into")))
        first = edges.join(merge.toDF("a", "x"), "a").select("x", "b")
        moved = first.join(merge.toDF("b", "y"), "b").where("x != y")
        after, after_path = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(spark, path)
        edges, path = after, after_path
        merges.append(merge)
    discard(spark, path)
    roots = None
    for merge in reversed(merges):
        if roots is None:
            roots = merge.toDF("node", "root")
        else:
            final = roots.toDF("into", "last")
            roots = merge.join(final, "into", "left").select("node", F.coalesce("last", "into").alias("root"))
        roots, _ = materialize(roots)
    if roots is None:
        return nodes.select("node", F.col("node").alias("component"))
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(placed.join(smallest, "root").select("node", "component"))[0]


class NearDuplicates:
    """The stages of the operator; ``run`` puts them together."""

    def __init__(self, docs: DataFrame, *, id_col="doc_id", text_col="text", words=WORDS, percent=PERCENT, bands=BANDS, rows=ROWS):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.spark, self.words, self.percent, self.bands, self.rows = docs.sparkSession, words, percent, bands, rows

    def signatures(self) -> DataFrame:
        schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
        return materialize(self.docs.mapInArrow(_signatures(self.words, self.bands, self.rows), schema))[0]

    def members(self, signed: DataFrame, classes: DataFrame) -> DataFrame:
        """bucket, rep, size, c of the class representatives in buckets with company."""
        keys = ["doc_id", "f1", "f2", "n_shingles"]
        rows = signed.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n_shingles"), keys, "left_semi")
        reps = rows.groupBy(*keys).agg(F.first("bands").alias("bands"))  # a row of each, should rows repeat
        spread = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"))
        # the smallest id after flipping the bucket's bits: another centre in each bucket
        star = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.col("rep").bitwiseXOR(F.col("bucket"))).alias("least"))
        crowd = star.where("c > 1").select("bucket", "c", F.col("least").bitwiseXOR(F.col("bucket")).alias("centre"))
        return materialize(spread.join(crowd, "bucket"))[0]

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
        met = pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
        return met.mapInArrow(_confirm(self.percent), "a long, b long").distinct()

    def _close(self, pairs: DataFrame) -> DataFrame:
        """Sets of too different sizes cannot be similar; a document with several sets has a range of sizes."""
        most, least = F.least("most_a", "most_b"), F.greatest("least_a", "least_b")
        return pairs.where(100 * most >= self.percent * least).select("a", "b").distinct()

    def stars(self, members: DataFrame, sizes: DataFrame) -> DataFrame:
        """The first centre of each bucket with every other member: pairs (a, b), a < b."""
        proposed = members.where("rep != centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        known = sizes.select(F.col("rep").alias("a"), F.col("least").alias("least_a"), F.col("most").alias("most_a"))
        return self._close(proposed.join(known, "a").join(known.toDF("b", "least_b", "most_b"), "b"))

    def undecided(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members, numbered, of buckets that hold several components; those outside the bucket's largest first."""
        own = labels.select(F.col("node").alias("rep"), "component")
        labelled = members.where("c > 2").join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
        crowd = parts.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("total").alias("total")
        )
        crowd = crowd.where("parts > 1").select("bucket", "largest", F.ceil(F.col("total") / GROUP_SHINGLES).alias("slices"))
        minor = F.col("component") != F.col("largest")
        order = W.partitionBy("bucket").orderBy(F.desc("minor"), F.col("rep").bitwiseXOR(F.col("bucket")))
        before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
        numbered = labelled.join(crowd, "bucket").withColumn("minor", minor)
        return materialize(
            numbered.select(
                "bucket", "rep", "component", "slices", "minor", F.row_number().over(order).alias("rank"), F.floor(before / GROUP_SHINGLES).alias("block")
            )
        )[0]

    def further(self, numbered: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between the minor members of each bucket and the members after them.

        A group is one block of centres and one slice of members, both of bounded size;
        it yields only links that join components within it.
        """
        centres = numbered.where("minor")
        blocks = centres.select("bucket", "block").distinct()
        slices = F.explode(F.sequence(F.lit(0), F.col("slices").cast("int") - 1)).alias("slice")
        held = centres.select("bucket", "block", slices, F.lit(True).alias("centre"), "rank", "component", "rep")
        probe = numbered.drop("block").join(blocks, "bucket").select(
            "bucket", "block", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("centre"), "rank", "component", "rep"
        )
        rows = held.union(probe).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        keys = ["bucket", "block", "slice"]
        dealt = rows.select(*keys, "centre", "rank", "component", "rep", "set").repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(_block_links(self.percent), "a long, b long").distinct()

    def merged(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after more links, which are followed between components only."""
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        between = named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct()
        onto = components(between).toDF("old", "new")
        fresh = onto.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        moved = labels.join(onto, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        return materialize(moved.union(fresh))[0]

    def repeated(self, signed: DataFrame, classes: DataFrame) -> DataFrame | None:
        """doc_id, rep: the classes of documents with several rows, where there are such documents."""
        rows = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
        rows = materialize(rows)[0]
        if rows.isEmpty():
            return None
        own = signed.join(rows, "doc_id", "left_semi").select("doc_id", "f1", "f2", "n_shingles").distinct()
        return materialize(own.join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "rep").distinct())[0]

    def sets(self, sizes: DataFrame, several: DataFrame | None) -> DataFrame:
        """doc_id, set: the distinct sets of every document that is sought."""
        wanted = sizes.select(F.col("rep").alias("doc_id"))
        made = self.docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(self.words), "doc_id long, set binary")
        if several is None:
            return materialize(made)[0]
        ids = several.select("doc_id").distinct()
        return materialize(made.join(ids, "doc_id", "left_anti").union(made.join(ids, "doc_id", "left_semi").distinct()))[0]

    def classes(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
        """(signatures, class representatives, their labels, documents in several classes).

        labels: node, component of the representatives that any link touches.
        """
        with small_batches(self.spark, BATCH_ROWS):
            return self._classes()

    def _classes(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
        signed = self.signatures()
        some = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        classes = materialize(some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")))[0]
        members = self.members(signed, classes)
        sizes = members.groupBy("rep").agg(F.min("size").alias("least"), F.max("size").alias("most"))
        several = self.repeated(signed, classes)
        sets = self.sets(sizes, several)
        tried = materialize(self.stars(members, sizes))[0]
        links = self.confirmed(tried, sets)
        if several is not None:  # the classes of one document belong together
            first = F.min("rep").over(W.partitionBy("doc_id"))
            links = links.union(several.select(first.alias("a"), F.col("rep").alias("b")).where("a <> b")).distinct()
        links = materialize(links)[0]
        labels = components(links)
        numbered = self.undecided(members, labels)
        if not numbered.isEmpty():
            labels = self.merged(labels, materialize(self.further(numbered, sets))[0])
        return signed, classes, labels, several

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row."""
        signed, classes, labels, several = self.classes()
        named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
            "f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component")
        )
        placed = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
        if several is not None:  # rows without words follow the others of their document
            whole = several.join(labels, F.col("rep") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("own"))
            placed = placed.join(whole, "doc_id", "left").withColumn("component", F.coalesce("component", "own"))
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).run()


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, with one of its rows."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select("doc_id", F.struct("*").alias("_row"))
    # rows without an id are different documents; those that share one are the same
    alone = rows.where("doc_id is null").select("_row")
    stay = rows.join(kept, rows["doc_id"] == kept["_id"])
    first = stay.withColumn("_at", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("_row"))))
    return first.where("_at = 1").select("_row").union(alone).select("_row.*")


#: DuckDB text of ``op1_near_duplicates``: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
t AS (SELECT a AS doc_id, a AS r FROM u UNION SELECT u.b, t.r FROM t JOIN u ON u.a = t.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
