"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A sequence's cost is estimated as linear plus quadratic attention over its pieces,
``a * sum(len) + b * sum(len^2)``.  Documents longer than a sequence give off full
sequences first; the rest, longest first, go to the lowest-cost sequence with enough
remaining capacity, and what fits nowhere is cut along the remaining gaps.  Sequences
are opened for exactly the tokens at hand: full ones, and for what is left one for each
power of two in it, as such lengths need no padding.

Packing runs where the documents are read, over windows of a bounded number of tokens:
no shuffle, no group larger than a window, and a lost task is simply run again on the
same split.  A sequence id holds the partition above its number there.

Defined results: a null text is empty; an empty text is the end token alone; a very long text is
encoded whole and gives off full sequences; documents of equal length go in the order in which
they are read; repeated rows are packed each; a null id stays null; other columns are ignored;
no rows give none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm.common import table

CAPACITY = 2048
END_ID = 1
WINDOW_TOKENS = 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHE_BYTES = 80 << 20
ENTRY_BYTES = 220  # of a cached word besides its characters and ids

#: The normalizer and pre-tokenizer that plain words are cut by without the tokenizer.
RULES = (
    {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Plain: characters that NFC leaves alone in any order and whose classes and lower case are the same
#: everywhere.  No bar, as it is part of the added tokens.
PLAIN = re.compile(r"[!-{}~¡¿À-ÖØ-öø-ÿ]+").fullmatch
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder(dict):
    """Whole texts to ids, by way of blank-separated words; the dictionary holds the ids of words seen before.

    The vocabulary's pre-tokenizer never crosses white space, so a text's ids are those
    of its words in order.  Only the four plain blanks are cut at; any other white space
    stays inside a word and is left to the tokenizer.

    A new plain word is lower-cased and cut here into the parts that the vocabulary's rules make of
    it, and only parts not seen before are merged.  A part's parts are itself, so words and parts
    are held together.  Words of other characters, and all words of a vocabulary of other rules,
    go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        added = [token["content"] for token in rules.get("added_tokens") or []]
        self.plain = (rules.get("normalizer"), rules.get("pre_tokenizer")) == RULES and not any(map(PLAIN, added))
        # the pre-tokenizer's spelling of the bytes of a character
        pre = self.tokenizer.pre_tokenizer
        self.spelt = {c: "".join(part for part, _ in pre.pre_tokenize_str(chr(c))) for c in range(256)} if self.plain else {}
        self.held = 0
        self.odd: list[str] = []

    def keep(self, word: str, ids: bytes) -> None:
        size = ENTRY_BYTES + len(word) + len(ids)
        if self.held + size <= CACHE_BYTES:  # once full: frequent words are in by now
            self.held += size
            self[word] = ids

    def __missing__(self, word: str) -> bytes | None:
        """The ids of a plain word; others are noted, for ``learn``."""
        if not (self.plain and PLAIN(word)):
            self.odd.append(word)
            return None
        parts = PARTS(word.lower())
        if parts[0] == word:
            spelt = word if word.isascii() else word.translate(self.spelt)
            ids = b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(spelt)])
        else:
            ids = b"".join(map(self.__getitem__, parts))
        self.keep(word, ids)
        return ids

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """One call for all new words; a token belongs to the word in which it starts."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        bounds = np.cumsum([len(w) + 1 for w in words])
        ends = np.searchsorted(starts, bounds)
        data, at, out = ids.tobytes(), 0, {}
        for word, end in zip(words, ends.tolist(), strict=True):
            out[word] = data[at * 4 : end * 4]
            self.keep(word, out[word])
            at = end
        return out

    def __call__(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = list(map(self.__getitem__, words))
        if self.odd:
            rare = self.learn(list(set(self.odd)))
            self.odd = []
            found = [rare[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process: its word cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def capacities(tokens: int, capacity: int = CAPACITY) -> np.ndarray:
    """Lengths of the sequences that hold ``tokens`` exactly."""
    rest = tokens % capacity
    return np.array([capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], dtype=np.int64)


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these lengths."""
    pieces, sequence = [], 0
    rest = []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room = capacities(sum(x[0] for x in rest), capacity)
    used, cost = np.zeros_like(room), np.zeros(len(room))

    def put(d: int, start: int, n: int, b: int) -> None:
        pieces.append((d, start, n, sequence + b, int(used[b])))
        used[b] += n
        room[b] -= n
        cost[b] += linear * n + quadratic * n * n

    late = []
    for n, d, start in rest:
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(d, start, n, int(fits[np.argmin(cost[fits])]))
        else:
            late.append((n, d, start))
    for n, d, start in late:  # cut along the widest gaps
        while n:
            b = int(np.argmax(room))
            take = min(n, int(room[b]))
            put(d, start, take, b)
            start, n = start + take, n - take
    return pieces


def _packer(vocabulary: str, capacity: int, end_id: int, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId() << 40
        made, held, ids, tokens = 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, ids, tokens
            pieces = pack([len(x) for x in ids], capacity)
            for at in range(0, len(pieces), 2000):
                some = pieces[at : at + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[p[0]] for p in some], pa.int64()),
                        pa.array([p[1] for p in some], pa.int64()),
                        pa.array([p[2] for p in some], pa.int64()),
                        pa.array([len(ids[p[0]]) for p in some], pa.int64()),
                        pa.array([part + made + p[3] for p in some], pa.int64()),
                        pa.array([p[4] for p in some], pa.int64()),
                        pa.array([ids[p[0]][p[1] : p[1] + p[2]].tobytes() for p in some], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            made += max((p[3] + 1 for p in pieces), default=0)
            held, ids, tokens = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append(doc_id.as_py())
                ids.append(np.frombuffer(encode(text.as_py() or "") + end, dtype="<u4"))
                tokens += len(ids[-1])
                if tokens >= window:
                    yield from flush()
        yield from flush()

    return rows


def pack_documents(
    docs: DataFrame, *, vocabulary: str | None = None, id_col="doc_id", text_col="text", capacity=CAPACITY, end_id=END_ID,
    window=WINDOW_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids.

    ``ids`` holds little-endian unsigned 32-bit numbers.  ``vocabulary`` is a tokenizers
    file that every worker can read; by default the installed public one.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _packer(str(vocabulary), capacity, end_id, window), PIECES
    )


def _digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pack_documents(table(spark, sf_dir, "documents")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces, ids included."""
    return pack_documents(docs).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", F.crc32("ids").alias("ids_crc32"))
