"""Search indices, text analysis and change feeds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spindrel import Session
from spindrel.operators.search import bands_and_rows, entries_of
from spindrel.operators.text import Porter, analyzed, ngrams, split_compound
from spindrel.streaming.changes import follow, publish


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.run("?[k, v] <- [['a', 'hello world!'], ['b', 'the world is round'], ['c', 'see you at the end of the world!'], ['d', 'the world is the world and makes the world go around']] :create t {k: String => v: String}")
    s.run("?[k, v] <- [['a', [1.0, 2.0]], ['b', [2.0, 3.0]], ['c', [10.0, 10.0]], ['z', null]] :create p {k: String => v: <F32; 2>?}")
    return s


def run(session, script):
    return [tuple(r) for r in session.run(script).collect()]


def test_vectors(session):
    for metric, first in (("L2", "a"), ("Cosine", "a"), ("IP", "c")):
        session.run(f"::hnsw create p:{metric} {{dim: 2, m: 8, ef_construction: 20, fields: [v], distance: {metric}}}")
        found = run(session, f"?[k, d] := ~p:{metric}{{k | query: q, k: 2, ef: 20, bind_distance: d}}, q = vec([1, 2]) :order d")
        assert len(found) == 2 and found[0][0] == first
    assert run(session, "?[k] := ~p:L2{k | query: vec([1, 2]), k: 3, ef: 20, radius: 5.0, filter: k != 'a'}") == [("b",)]
    joined = run(session, "?[a, b] := *p{k: a, v}, !is_null(v), ~p:L2{k: b | query: v, k: 1, ef: 20}")
    assert sorted(joined) == [("a", "a"), ("b", "b"), ("c", "c")]


def test_vector_queries_in_blocks(session, monkeypatch):
    from spindrel.operators import search

    session.run("::hnsw create p:x {dim: 2, m: 8, ef_construction: 20, fields: [v], distance: Cosine}")
    script = "?[a, b, d] := *p{k: a, v}, !is_null(v), ~p:x{k: b | query: v, k: 2, ef: 20, bind_distance: d}"
    whole = sorted(run(session, script))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 150)
    assert sorted(run(session, script)) == whole and len(whole) == 6


@pytest.mark.parametrize("name", ["L2", "IP", "Cosine"])
def test_no_near_pair_is_left_out(name):
    """Blocks of rows with ties and far vectors: the pairs that stay hold the k nearest, equal ones included."""
    from spindrel.operators.search import Best, measured

    draw = np.random.default_rng(5)
    rows, queries = np.repeat(draw.normal(size=(200, 6)), 3, 0) + 1, draw.normal(size=(17, 6)) + 1
    rows[100] *= 1e6
    rows, best, pairs = draw.permutation(rows), Best(name, queries, 4, None), set()
    for at in range(0, len(rows), 50):
        q, r = best.add(rows[at : at + 50])
        pairs |= set(zip(q.tolist(), (r + at).tolist(), strict=True))
    far = np.array([measured(name, rows, np.repeat(q[None], len(rows), 0)) for q in queries])
    for i, d in enumerate(far):
        assert {(i, int(j)) for j in np.flatnonzero(d <= np.sort(d)[3])} <= pairs
    assert len(pairs) < far.size / 4  # most pairs are never measured one by one
    plain = sum((a - b) * (a - b) for a, b in zip(rows[0], queries[0], strict=True)) if name == "L2" else 1 - sum(a * b for a, b in zip(rows[0], queries[0], strict=True))
    assert name == "Cosine" or far[0][0] == plain


def test_vectors_that_are_not_ordinary(session, spark):
    """Zero, short and infinite vectors are measured as by the distance functions."""
    held = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("inf"), 1.0]), (5, [2.0, 4.5]), (6, [float("nan"), 1.0]), (7, None)]
    session.register("o", spark.createDataFrame(held, "k long, v array<double>"), ["k"])
    for name, function in (("L2", "l2_dist"), ("IP", "ip_dist"), ("Cosine", "cos_dist")):
        session.run(f"::hnsw create o:{name} {{dim: 2, m: 8, ef_construction: 20, dtype: F64, fields: [v], distance: {name}}}")
        found = run(session, f"?[a, b, d] := *o{{k: a, v: q}}, ~o:{name}{{k: b | query: q, k: 9, ef: 20, bind_distance: d}}")
        want = run(session, f"?[a, b, d] := *o{{k: a, v: q}}, !is_null(q), *o{{k: b, v: w}}, !is_null(w), d = {function}(w, q)")
        assert sorted(map(repr, found)) == sorted(map(repr, want)) and len(want) == 36


def test_full_text(session):
    session.run("::fts create t:f {extractor: v, tokenizer: Simple, filters: [Lowercase, Stemmer('English')]}")
    q = lambda text, more="": sorted(r[0] for r in run(session, f"?[k] := ~t:f{{k | query: '{text}', k: 9{more}}}"))
    assert q("world") == ["a", "b", "c", "d"]
    assert q("world round") == ["b"]
    assert q("hello OR round") == ["a", "b"]
    assert q("world NOT hello") == ["b", "c", "d"]
    assert q("rou*") == ["b"]
    assert q("NEAR/2(see at)") == ["c"]
    assert q("NEAR/1(see end)") == []
    assert q("(hello, round) AND world") == ["a", "b"]
    best = run(session, "?[k, s] := ~t:f{k | query: 'world', k: 1, score_kind: 'tf', bind_score: s}")
    assert best == [("d", 3.0)]
    assert ("hello", "a") in run(session, "?[w, k] := *t:f{word: w, k}")


def test_texts_are_analyzed_in_bounded_batches(session, spark, monkeypatch):
    """A batch never holds more than so many tokens, and none is lost at its edges."""
    from spindrel.operators import search

    monkeypatch.setattr(search, "TOKENS_AT_ONCE", 7)
    texts = {i: " ".join(f"w{(i * j) % 5}" for j in range(i % 23)) for i in range(60)} | {60: None, 61: ""}
    chain = ("Simple", (), (("Stemmer", ("English",)),))
    given = pa.RecordBatch.from_pydict({"k": list(texts), "t": list(texts.values())})
    parts = list(search.token_batches(chain, ["k", *[n for n, _, _ in search.TOKEN]], iter([given])))
    total = sum(len((t or "").split()) for t in texts.values())
    assert [p.num_rows for p in parts] == [7] * (total // 7) + [total % 7] * (total % 7 > 0)
    session.register("d", spark.createDataFrame(list(texts.items()), "k long, v string"), ["k"])
    session.run("::fts create d:f {extractor: v, tokenizer: Simple, filters: [Stemmer('English')]}")
    found = run(session, "?[k, w, p, a, z, n] := *d:f{word: w, k, position: p, offset_from: a, offset_to: z, total_length: n}")
    want = []
    for k, t in texts.items():
        spread = analyzed(chain, t or "")
        for w in {w for w, _, _ in spread}:
            mine = [(i, a, z) for i, (x, a, z) in enumerate(spread) if x == w]
            want.append((k, w, *map(list, zip(*mine, strict=True)), len(spread)))
    assert sorted(found) == sorted(want)


def test_near_duplicates(session):
    session.run("::lsh create t:l {extractor: v, tokenizer: Simple, n_gram: 3, target_threshold: 0.3}")
    assert run(session, "?[k] := ~t:l{k | query: 'see him at the end of the world', k: 2}") == [("c",)]
    assert run(session, "?[k] := ~t:l{k | query: q}, q = null") == []


def test_stored_entries_follow_every_change(session):
    """What an index holds after puts, updates and removals is what its rows give."""
    session.run("::fts create t:f {extractor: v, tokenizer: Simple, filters: [Lowercase]}")
    session.run("::lsh create t:l {extractor: v, tokenizer: Simple, n_gram: 2, target_threshold: 0.5}")
    for i in range(12):
        session.run(f"?[k, v] <- [['a', 'hello number {i}'], ['n{i}', 'a new text {i}']] :put t")
    session.run("?[k, v] <- [['b', 'updated text']] :update t")
    session.run("?[k] <- [['c'], ['n3']] :rm t {k}")
    relation = session.catalog.relations["t"]
    assert {n for n, _ in relation.stored} == {"f", "l"} and relation.data.count() == 14
    for index in relation.indices:
        held = dict(relation.stored)[index.name]
        made = entries_of(relation, index, relation.frame()).select(*held.columns)
        assert sorted(map(repr, held.collect())) == sorted(map(repr, made.collect())) and made.count() > 20
    assert run(session, "?[k] := ~t:f{k | query: 'updated', k: 9}") == [("b",)]
    assert run(session, "?[k] := ~t:f{k | query: 'round OR see', k: 9}") == []


def test_near_duplicates_against_brute_force(session, spark):
    """Similar pairs are found, far ones are not, at the rates that the bands promise."""
    draw = random.Random(1)
    texts = {}
    for i in range(60):
        base = [f"w{draw.randrange(500)}" for _ in range(120)]
        texts[2 * i] = " ".join(base)
        texts[2 * i + 1] = " ".join(w if draw.random() > 0.02 else "x" for w in base)
    session.register("d", spark.createDataFrame(sorted(texts.items()), "k long, v string"), ["k"])
    session.run("::lsh create d:l {extractor: v, tokenizer: Simple, n_gram: 5, n_perm: 128, target_threshold: 0.75}")
    found = {(a, b) for a, b in run(session, "?[a, b] := *d{k: a, v: t}, ~d:l{k: b | query: t}") if a < b}
    grams = {k: {tuple(t.split()[i : i + 5]) for i in range(116)} for k, t in texts.items()}
    similarity = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in texts for b in texts if a < b}
    near, far = {p for p, s in similarity.items() if s >= 0.85}, {p for p, s in similarity.items() if s < 0.4}
    assert len(near) > 20 and len(found & near) >= 0.9 * len(near) and len(found & far) <= 2


def test_band_choice():
    b, r = bands_and_rows(0.5, 64)
    assert b * r <= 64 and abs((1 / b) ** (1 / r) - 0.5) < 0.15


def test_text_tools():
    stem = Porter()
    for word, root in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("happy", "happi"), ("controlling", "control")):
        assert stem(word) == root
    assert [t for t, _, _ in ngrams("abc", 2)] == ["ab", "bc"]
    assert split_compound("dampfschiff", ["dampf", "schiff"]) == ["dampf", "schiff"]
    assert split_compound("dampfer", ["dampf"]) == ["dampfer"]
    chain = ("Simple", (), (("Lowercase", ()), ("Stopwords", (("the",),)), ("RemoveLong", (6,)), ("AsciiFolding", ())))
    assert analyzed(chain, "The Café, enormous") == [("cafe", 4, 8)]


def test_streams_in_and_changes_out(session, spark, tmp_path):
    session.run("?[k, v] <- [[1, 'a']] :create r {k: Int => v: String}")
    publish(session, "r", f"file://{tmp_path}/feed")
    spark.createDataFrame([(1, "z"), (2, "b")], "k long, v string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, v string").parquet(f"file://{tmp_path}/in")
    query = follow(session, stream, "r", f"file://{tmp_path}/check")
    query.awaitTermination(60)
    assert sorted(run(session, "?[k, v] := *r{k, v}")) == [(1, "z"), (2, "b")]
    feed = spark.read.parquet(f"file://{tmp_path}/feed")
    assert feed.where("_side = 'new'").count() == 2 and feed.where("_side = 'old'").count() == 1
