"""The whole pipeline against a plain version of its stages."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from spindrel.llm import mixing, pii
from tests.llm.test_text_operators import brute_components, edited, filled


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice(("ba", "lo", "mi", "tu", "ren", "sko")) for _ in range(draw.randrange(1, 4)))
    docs = []
    for _ in range(40):
        base = [word() for _ in range(draw.choice((8, 60, 300)))]
        if draw.random() < 0.3:
            base[3] = f"u{len(docs)}.x@mail.example.com"
        for _ in range(draw.choice((1, 1, 3))):
            docs.append(" ".join(edited(draw, base, draw.choice((0, 0.01)))))
    docs += ["", "!!! 12 ???", "\n", None, docs[0], docs[5]]
    return [(i, t, "en" if i % 2 else None, draw.choice(("a", "b", None)), len(t or "")) for i, t in enumerate(docs)]


def test_the_pipeline_equals_its_plain_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(pii.SECRET, "tests")
    try:
        pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
        key = pii.key_of(spark)
    finally:
        spark.conf.unset(pii.SECRET)

    lettered = [(i, t, s) for i, t, _, s, _ in rows if t and any(c.isalpha() for c in t)]
    component = brute_components([(i, t) for i, t, _ in lettered])
    kept = {i: (pii.surrogates(t, key)[0], s) for i, t, s in lettered if component[i][1] == i}
    assert any("@" in t for t, _ in kept.values()) and not any("mail.example.com" in t for t, _ in kept.values())

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    copies = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    held, fill = defaultdict(Counter), defaultdict(list)
    for p in pieces:
        for k, token in enumerate(np.frombuffer(p["ids"], "<u4").tolist()):
            held[p["doc_id"]][p["start"] + k, token] += 1
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(held) <= set(kept)
    for i, found in held.items():
        want = tokenizer.encode(kept[i][0], add_special_tokens=False).ids + [1]
        assert found == Counter({(k, token): copies[i] for k, token in enumerate(want)})
    for spans in fill.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist()

    sources = sorted({s for _, s in kept.values() if s is not None}) + [None]
    words = {s: sum(len(t.split()) for t, x in kept.values() if x == s) for s in sources}
    for s, target in zip(sources, filled([words[s] for s in sources], mixing.WEIGHTS, mixing.SHARE, mixing.MOST), strict=True):
        taken = sum(copies[i] * len(t.split()) for i, (t, x) in kept.items() if x == s)
        assert taken == pytest.approx(target, abs=310)  # a document at each end of the run, to the nearest whole
    assert all(n <= 2 for n in copies.values())
