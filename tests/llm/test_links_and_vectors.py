"""URL filters, nearest neighbours, the registered queries and the pipeline."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrel.llm import ann, queries, urls

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


# --- URLs ---------------------------------------------------------------------------

CASES = [
    (1, "http://a.b.COM/x?q#f", "a.b.com", "/x", "com/", "allow"),
    (2, "https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (3, "https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    (4, "https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    (7, "http://x.com", "x.com", "", None, None),
    (8, "nothing", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "http://h?x://y/z", "h", "", None, None),
    (11, "a://B.Org#t/es/", "b.org", "", None, None),
    (12, "http://net/fr/\nx", "net", "/fr/\nx", "net/fr/", "block"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "junk", "z") for i, u, *_ in CASES], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, _, host, path, rule, verdict in CASES:
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block"))


def test_the_model_follows_the_labels(spark):
    rows = [(f"http://s{i}.com/good/page/{i}", None) for i in range(150)] + [(f"http://s{i}.net/es/spam-spam-{i}", None) for i in range(150)]
    open_ = [(f"http://t{i}.org/good/page/{i}", "allow") for i in range(20)] + [(f"http://t{i}.org/es/spam-spam-{i}", "block") for i in range(20)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows + open_)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert sum(got[len(rows) + i] == want for i, (_, want) in enumerate(open_)) >= 38


def plain_verdicts(pages):
    """The models by dictionaries, one character at a time."""
    rules = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    label = {}
    for _, u in pages:
        if u is not None:
            rest = u.partition("://")[2] if "://" in u else ""
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            low = "".join(c.lower() if c.isascii() else c for c in host)
            label[u] = next((v for v, h, p in rules if (low == h or low.endswith("." + h)) and path.startswith(p)), None) if "://" in u else None
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in urls.HOLD for u in label}

    def model(known):
        count, after = Counter(), defaultdict(set)
        for u in known:
            whole = urls.PAD * urls.ORDER + u
            for i in range(urls.ORDER, len(whole)):
                for k in range(urls.ORDER + 1):
                    count[whole[i - k : i], whole[i]] += 1
                    after[whole[i - k : i]].add(whole[i])
        total = Counter()
        for (context, _), n in count.items():
            total[context] += n

        def log(context, c):
            p = 1 / urls.SYMBOLS
            for k in range(urls.ORDER + 1):
                at = context[len(context) - k :]
                if total[at]:
                    p = (count[at, c] + len(after[at]) * p) / (total[at] + len(after[at]))
            return math.log(p)

        return log

    def scorer(known):
        good, bad = (model([u for u in known if label[u] == v]) for v in ("allow", "block"))

        def score(u):
            whole = urls.PAD * urls.ORDER + u
            d = [good(whole[i - urls.ORDER : i], whole[i]) - bad(whole[i - urls.ORDER : i], whole[i]) for i in range(urls.ORDER, len(whole))]
            return sum(d) / len(d) if d else None

        return score

    ruled = [u for u in label if label[u]]
    fit, every = scorer([u for u in ruled if not held[u]]), scorer(ruled)
    s = {v: [fit(u) for u in ruled if held[u] and label[u] == v] for v in ("allow", "block")}
    mean, spread = ({v: f(x) for v, x in s.items()} for f in (np.mean, np.std))
    t = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
    out = {}
    for i, u in pages:
        score = every(u) if u and not label[u] else None
        out[i] = label.get(u) or ("allow" if (score if score is not None else 0 if not u else score) >= t else "block") if u else ("allow" if t <= 0 else "block")
    return out


def test_verdicts_equal_plain_models(spark):
    draw = random.Random(5)
    tail = lambda: "".join(draw.choice("abcé😀/-?=#%") for _ in range(draw.randrange(12)))
    pages = [(i, draw.choice(("http://a.com/", "https://B.net/es/", "http://c.net/fr/", "http://d.org/", "d.org/", "x", "")) + tail()) for i in range(300)]
    pages += [(400, None), (401, "http://d.org/" + "ab" * 20_000), (402, "http://d.org/q"), (403, "http://d.org/q")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == plain_verdicts(pages) and len(got) == len(pages)


def test_equal_rules_go_by_code_point(spark):
    rules = (("allow", "b.c", "/x"), ("block", "b.c", "/x"), ("block", "a.b.c", "/"), ("allow", "b.c", "/"))
    pages = spark.createDataFrame([(1, "http://a.b.c/x"), (1, "http://a.b.c/x"), (2, "http://q.b.c/x/y")], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules=rules).collect())
    assert got == [(1, "a.b.c/", "block"), (1, "a.b.c/", "block"), (2, "b.c/x", "allow")]


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- nearest neighbours -------------------------------------------------------------


def vectors(spark, data):
    return spark.createDataFrame(data, "id long, vector array<double>")


def brute(data, asked, k):
    """By row: the k nearest other rows, as (score, id)."""
    good = [(n, i, np.array(v)) for n, (i, v) in enumerate(data) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = lambda v: v / np.abs(v).max() / np.sqrt(((v / np.abs(v).max()) ** 2).sum())
    out = {}
    for n, i, v in good:
        if asked(i):
            scored = sorted((-float((unit(w) * unit(v)).sum()), j) for m, j, w in good if m != n and len(w) == len(v))
            out[n] = [(-s, j) for s, j in scored[:k]]
    return out


def ranked(found):
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(rows) for q, rows in by.items()}


@pytest.mark.parametrize("dense", [False, True])
def test_recall_over_shards(spark, dense):
    """Shards of some thousand rows, without structure, or a third of the rows in one dense cluster."""
    draw = np.random.default_rng(1)
    base = draw.normal(size=32)
    data = [(i, (base + 0.05 * draw.normal(size=32) if dense and i % 3 == 0 else draw.normal(size=32)).tolist()) for i in range(9_000)]
    found = ranked(ann.nearest(vectors(spark, data), F.col("id") % 100 == 0, 5, shard_rows=3_000).collect())
    want = brute(data, lambda i: i % 100 == 0, 5)
    assert all([rank for rank, _, _ in rows] == [1, 2, 3, 4, 5] for rows in found.values()) and set(found) == set(want)
    hits = sum(i in {j for _, j in want[q]} for q, rows in found.items() for _, _, i in rows)
    assert hits >= 0.95 * 450
    exact = {q: dict((j, s) for s, j in rows) for q, rows in want.items()}
    assert all(s == pytest.approx(exact[q][i], abs=1e-12) for q, rows in found.items() for _, s, i in rows if i in exact[q])


def test_equal_vectors_and_unusable_ones(spark):
    data = [(i, [1.0, 2.0]) for i in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [None, 1.0]), (54, [2.0, -1.0]), (55, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    got = ranked(ann.nearest(vectors(spark, data), F.col("id").isin(0, 3, 50, 51, 54), 5).collect())
    assert [i for _, _, i in got[3]] == [0, 1, 2, 4, 5] and got[0][0][1] == pytest.approx(1)
    assert [i for _, _, i in got[54]] == [0, 1, 2, 3, 4] and set(got) == {0, 3, 54}


def test_rows_of_one_id_are_rows_of_their_own(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (0, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 1.0])]
    found = ann.nearest(vectors(spark, data), F.col("id") % 2 == 0, 2).collect()
    want = brute(data, lambda i: i % 2 == 0, 2)
    mine = sorted((r["query_id"], round(r["score"], 9), r["vec_id"]) for r in found)
    assert mine == sorted((data[n][0], round(s, 9), j) for n, rows in want.items() for s, j in rows) and len(mine) == 7


def test_very_long_and_very_short_vectors(spark):
    data = [(0, [1e200, 2e200]), (1, [3e-200, 1e-200]), (2, [-1e300, 1.0]), (3, [5e-324, 0.0])]
    got = ranked(ann.nearest(vectors(spark, data), F.lit(True), 3).collect())
    want = brute(data, lambda i: True, 3)
    assert {q: [i for _, _, i in rows] for q, rows in got.items()} == {q: [i for _, i in rows] for q, rows in want.items()}


def test_few_or_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], "x", True, 7), (1, [0.0, 1.0], "y", None, 8)], "id long, vector array<double>, row string, asked boolean, shard int")
    assert [tuple(r) for r in ann.nearest(one, F.col("id") == 0, 5).collect()] == [(0, 1, 1, 0.0)]
    none = vectors(spark, [])
    assert ann.nearest(none, F.lit(True), 5).count() == 0


# --- queries and pipeline -----------------------------------------------------------

COLUMNS = {
    "op1_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op4_": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op8_": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_": {"doc_id": "bigint", "text": "string"},
    "op10_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@here
@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_query_shapes(spark, prefix):
    name = next(n for n in queries.queries() if n.startswith(prefix))
    df = queries.queries()[name](spark, DATA)
    assert COLUMNS[prefix].items() <= dict(df.dtypes).items()
    assert df.count() > 0


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert mine == theirs


@here
def test_pipeline_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == first.columns, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.count() > 0
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}
    assert whole == {r["doc_id"] for r in pieces.select("doc_id").collect()}
