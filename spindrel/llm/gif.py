"""GIF media columns: decoding to timed frames, colour histograms, lossless storage of bytes.

``decode`` reads any GIF: the block structure, LZW code streams of growing width, local
and global palettes, interlacing, transparency and the disposal rules, and composes each
frame on the canvas, one frame at a time.  How wide a code is follows from its place since
the last clear code alone, so codes are cut out of a stream many at once; the code table
then turns them into samples.

``encode`` stores a payload as 8-bit samples, 64 to a row, in frames of at most
``FRAME_ROWS`` rows over a grey palette, by LZW with codes of 9 to 12 bits and a clear code
whenever the table is full.

Defined results: a null or empty text is 64 zero bytes; a very long text is many frames,
each read and freed in turn; repeated rows are stored each; media that is null or not a
GIF has no frames; a frame that is cut short, or whose codes are damaged, is padded with
colour index 0, and reading ends at the first block that is no block; a screen or frame of
more than ``MAX_PIXELS`` is no picture and ends the reading; other columns are ignored; no
rows give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm.common import byte_slices, table

WIDTH = 64
FRAME_ROWS = 16_384
DELAY = 10
CODES = 4096
MAX_PIXELS = 1 << 26
BATCH_BYTES = 4 << 20
BINS = 16


@dataclass
class Frame:
    """One composed frame: samples as stored, the canvas after it, and its time."""

    start_cs: int
    delay_cs: int
    samples: np.ndarray  # height x width colour indices of the frame's own rectangle
    canvas: np.ndarray  # screen height x width x RGBA

    def histogram(self, bins: int = BINS) -> np.ndarray:
        """Visible pixels by red, green and blue level: 3 x bins."""
        seen = self.canvas[self.canvas[..., 3] > 0][:, :3]
        return np.stack([np.bincount(seen[:, c] * bins >> 8, minlength=bins) for c in range(3)])


@lru_cache(maxsize=16)
def _widths(minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first CODES codes after a clear code: widths, and the bits before each and all."""
    held = (1 << minimum) + 2 + np.maximum(np.arange(CODES) - 1, 0)  # table entries when a code is read
    bits = np.ceil(np.log2(held + 1)).astype(np.int64)
    width = np.minimum(12, np.maximum(minimum + 1, bits))
    return width, np.concatenate(([0], np.cumsum(width)))


def _compressed(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    clear, over, size = 256, 257, 258
    codes, starts = [clear], [0, 1]  # starts: where the widths begin anew
    table: dict[int, int] = {}
    find, emit = table.get, codes.append
    at = data[0]
    for sample in data[1:]:
        key = at << 8 | sample
        longer = find(key)
        if longer is not None:
            at = longer
            continue
        emit(at)
        at = sample
        table[key] = size
        size += 1
        if size == CODES:
            emit(clear)
            starts.append(len(codes))
            table.clear()
            size = 258
    emit(at)
    emit(over)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
    width = _widths(8)[0][place]
    bit = np.cumsum(width) - width
    value = np.array(codes, np.int64) << (bit & 7)
    length = int(bit[-1] + width[-1] + 7) >> 3
    # no two codes share a bit, so sums are unions
    whole = sum(np.bincount((bit >> 3) + k, value >> 8 * k & 255, length + 2) for k in range(3))
    return whole[:length].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    """Data sub-blocks with their lengths and the terminator."""
    whole = len(data) // 255
    head = np.empty((whole, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


_HEAD = b"GIF89a"
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode(payload: bytes) -> bytes:
    """A GIF whose samples are the bytes of ``payload`` (a positive multiple of WIDTH)."""
    rows = len(payload) // WIDTH
    out = [_HEAD, WIDTH.to_bytes(2, "little"), min(rows, FRAME_ROWS).to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for top in range(0, rows, FRAME_ROWS):
        height = min(FRAME_ROWS, rows - top)
        out += [b"\x21\xf9\x04\x04", DELAY.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0"]
        out += [WIDTH.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\0\x08", _blocks(_compressed(payload[top * WIDTH : (top + height) * WIDTH]))]
    return b"".join(out) + b"\x3b"


def _join(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The bytes of the sub-blocks from ``at`` on, as far as there are any, and where they end."""
    parts = []
    while at < len(data) and data[at]:
        if data[at] == 255:  # a run of full blocks at once
            first = at
            while at < len(data) and data[at] == 255:
                at += 256
            whole = np.frombuffer(data, np.uint8, min(at, len(data)) - first, first)
            parts.append(whole.reshape(-1, 256)[:, 1:].ravel() if len(whole) % 256 == 0 else whole[np.arange(len(whole)) % 256 > 0])
        else:
            parts.append(np.frombuffer(data, np.uint8, min(data[at], len(data) - at - 1), at + 1))
            at += data[at] + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), at + 1


def lzw(data: np.ndarray, minimum: int, most: int | None = None) -> np.ndarray:
    """The samples of a GIF code stream, up to its end, its first damage, or ``most``."""
    if not 1 <= minimum <= 11:
        return np.zeros(0, np.uint8)
    clear = 1 << minimum
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    bits, at, place = len(data) * 8, 0, 0
    fresh = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    entries, full = list(fresh), False
    out: list[bytes] = []
    made = 0
    while True:
        if full:  # the table no longer grows: 12 bits each
            width, before = np.full(CODES, 12), np.arange(CODES + 1) * 12
        else:
            width, before = (x[place:] for x in _widths(minimum))
        begin = at + before[:-1] - before[0]
        begin = begin[: int(np.searchsorted(begin + width, bits, side="right"))]
        if not len(begin):
            break
        byte = begin >> 3
        codes = (padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16) >> (begin & 7) & (1 << width[: len(begin)]) - 1
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(marks[0]) if len(marks) else len(codes)
        first = len(out)
        whole = _looked_up(codes[:n].tolist(), entries, out, place == 0)
        made += sum(map(len, out[first:]))
        if not whole or most is not None and made >= most:
            break
        if len(marks):
            if codes[n] == clear + 1:
                break
            at = int(begin[n] + width[n])
            entries, full, place = list(fresh), False, 0
        else:
            at, place = int(begin[-1] + width[len(begin) - 1]), place + len(codes)
            full = full or place >= CODES
    return np.frombuffer(b"".join(out), np.uint8)[:most]


def _looked_up(codes: list[int], entries: list[bytes], out: list[bytes], first: bool) -> bool:
    """Add the samples of codes to ``out`` while the table grows; whether all codes were sound."""
    put, grow = out.append, entries.append
    if first and codes:
        if codes[0] >= len(entries):
            return False
        put(entries[codes[0]])
        codes = codes[1:]
    last, room = out[-1] if out else b"", CODES - len(entries)
    for code in codes[:room]:
        try:
            entry = entries[code]
        except IndexError:
            if code > len(entries):  # a damaged stream ends here
                return False
            entry = last + last[:1]
        put(entry)
        grow(last + entry[:1])
        last = entry
    for code in codes[room:]:
        put(entries[code])
    return True


def _rows(height: int, interlaced: bool) -> np.ndarray:
    """Row numbers in the order in which they are stored."""
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes | None) -> Iterator[Frame]:
    """All frames of a GIF, composed one upon the other."""
    if not media or media[:3] != b"GIF" or len(media) < 13:
        return
    byte = lambda at: media[at] if at < len(media) else 0
    short = lambda at: byte(at) | byte(at + 1) << 8
    width, height, packed, at = short(6), short(8), media[10], 13
    if width * height > MAX_PIXELS:
        return

    def palette(packed: int) -> np.ndarray | None:
        nonlocal at
        if not packed & 128:
            return None
        size = 3 << (packed & 7) + 1
        colours = np.zeros((256, 4), np.uint8)
        got = np.frombuffer(media[at : at + size], np.uint8)
        colours[: len(got) // 3, :3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        colours[:, 3] = 255
        at += size
        return colours

    shared = palette(packed)
    canvas = np.zeros((height, width, 4), np.uint8)
    start, delay, disposal, clear_index = 0, 0, 0, None
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            if byte(at + 1) == 0xF9 and byte(at + 2) >= 4:
                flags, delay = byte(at + 3), short(at + 4)
                disposal, clear_index = flags >> 2 & 7, byte(at + 6) if flags & 1 else None
            at = _join(media, at + 2)[1]
        elif media[at] == 0x2C and at + 10 < len(media):
            left, top, w, h, flags = short(at + 1), short(at + 3), short(at + 5), short(at + 7), media[at + 9]
            if w * h > MAX_PIXELS:
                return
            at += 10
            own = palette(flags)
            colours = own if own is not None else shared if shared is not None else np.full((256, 4), 255, np.uint8)
            minimum = byte(at)
            data, at = _join(media, at + 1)
            stored = lzw(data, minimum, w * h)
            if len(stored) < w * h:
                stored = np.append(stored, np.zeros(w * h - len(stored), np.uint8))
            samples = np.empty((h, w), np.uint8)
            samples[_rows(h, bool(flags & 64))] = stored.reshape(h, w)
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            visible = samples[: area.shape[0], : area.shape[1]]
            if clear_index is None:
                area[...] = colours[visible]
            else:
                drawn = visible != clear_index
                area[drawn] = colours[visible[drawn]]
            yield Frame(start, delay, samples, canvas.copy())
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
            start, delay, disposal, clear_index = start + delay, 0, 0, None
        else:
            return


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def to_gif(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, media: every text stored as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in byte_slices(b, 1, BATCH_BYTES)):
            made = [payload_of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAMES = (
    "doc_id long, frame int, start_cs long, delay_cs long, width int, height int, samples binary, "
    "red array<long>, green array<long>, blue array<long>"
)


def frames(media: DataFrame, *, id_col="doc_id", media_col="media") -> DataFrame:
    """One row per frame of every GIF: its time, samples and colour histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary())]
            + [(c, pa.list_(pa.int64())) for c in ("red", "green", "blue")]
        )
        for batch in (part for b in batches for part in byte_slices(b, 1, BATCH_BYTES)):
            rows = []
            for doc_id, gif in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, f in enumerate(decode(gif.as_py())):
                    rows.append((doc_id, i, f.start_cs, f.delay_cs, f.samples.shape[1], f.samples.shape[0], f.samples.tobytes(), *f.histogram().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, FRAMES)


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def digests(media: DataFrame) -> DataFrame:
    """Per row of ``to_gif``: digests of what its frames hold, and their colour histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in byte_slices(b, 2, BATCH_BYTES)):
            out: list[tuple] = []
            for gif in batch.column(2):
                data = gif.as_py()
                payload, bins, seconds, n = bytearray(), np.zeros(BINS, np.int64), 0, 0
                for f in decode(data):
                    payload += f.samples.tobytes()
                    bins += f.histogram()[0]
                    seconds, n = f.start_cs + f.delay_cs, n + 1
                feature = f"frames={n};cs={seconds};hist=" + ",".join(map(str, bins.tolist()))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(to_gif(table(spark, sf_dir, "documents")))
