"""Routing of shared windows: which windows of a document also start in a document with a smaller id.

A window is ``window`` consecutive symbols (bytes or words). Every window has an anchor, the run of ``anchor`` symbols in
it with the smallest hash, and neighbouring windows mostly share it; the stretch that they cover together is a fragment.
Equal windows have equal anchors, so it is enough to compare fragments that share one. Documents are dealt once into
chunks by their id, and three passes read that one shuffle:

1. Every chunk sends the hashes of its anchors, four bytes each, to the buckets of the hashes. A bucket answers each chunk
   with one bit per hash: does another chunk have it too? Most fragments end here.
2. Every chunk sends the others' bytes to their buckets. Copies inside a batch are settled at once (a fragment that a
   smaller document of the batch has too is wholly covered and not sent), so a passage in a third of all documents
   reaches its bucket once a batch. Buckets compare bytes (``match``).
3. What was found comes back to its chunk, where the intervals of each document are united.

No text is compared with another that does not share an anchor, and no bucket, chunk or document is cut short.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.batches import give_back, small_batches

#: symbols that are told apart from each other, and those of them hashed at once: a few hundred KB a column
BATCH_SYMBOLS = 1 << 21
SLICE_SYMBOLS = 1 << 16
#: bytes of fragments held before they are packed
HELD_BYTES = 24 << 20
#: fragments whose bytes are looked up at once
SLICE_ROWS = 1 << 11
#: bytes of text in a chunk, and behind the anchors of a bucket of the first pass
CHUNK_BYTES = 4 << 20
ANCHOR_BYTES = 64 << 20
LEAST_CHUNKS = 256
LEAST_BUCKETS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POSITION_BITS = np.uint64(22)


@dataclass(frozen=True)
class Kind:
    """What windows are made of."""

    window: int
    anchor: int
    words: bool


BYTES = Kind(50, 16, False)
WORDS = Kind(13, 4, True)


_blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_byte_hashes = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], np.uint64)


def _finish(h: np.ndarray) -> np.ndarray:
    z = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _runs(h: np.ndarray, length: int, joined: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """``joined`` over all runs of ``length``, by doubling; shorter than the input by length - 1."""
    out, have, size = None, 0, 1
    while True:
        if length & size:
            if out is None:
                out, have = h, size
            else:
                n = min(len(out), len(h) - have)
                out, have = joined(out[:n], h[have : have + n], have), have + size
        size *= 2
        if size > length:
            return out[: max(0, len(out))]
        half = size // 2
        h = joined(h[: len(h) - half], h[half:], half)


@dataclass
class Batch:
    """Symbols of some documents, one after the other."""

    data: np.ndarray  # bytes
    ends: np.ndarray  # of documents, in symbols
    offsets: np.ndarray | None = None  # of words in data, one more than words; bytes stand where they are
    hashes: np.ndarray | None = None  # of words

    def hashes_of(self, begin: int, end: int) -> np.ndarray:
        return _byte_hashes[self.data[begin:end]] if self.hashes is None else self.hashes[begin:end]

    def places(self, symbols: np.ndarray) -> np.ndarray:
        """Where symbols begin in data."""
        return symbols if self.offsets is None else self.offsets[symbols]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, of slices of words at once. It routes words; what is equal is told by bytes."""
    out, at = np.zeros(len(offsets) - 1, np.uint64), 0
    while at < len(out):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_SYMBOLS, "right")) - 1)
        own, places = data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        if len(own) > SLICE_SYMBOLS:  # a single word
            out[at] = xxhash.xxh64_intdigest(own.tobytes(), 9)
        else:
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_byte_hashes[own] * _powers(int(_BASE), SLICE_SYMBOLS)[: len(own)], out=sums[1:])
            out[at:stop] = (sums[places[1:]] - sums[places[:-1]]) * _powers(int(_INVERSE), SLICE_SYMBOLS)[places[:-1]]
        at = stop
    return _finish(out)


def read_batch(texts: list[bytes], kind: Kind) -> Batch:
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    if not kind.words:
        return Batch(np.frombuffer(b"".join(texts), np.uint8), ends)
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = _blank[raw]
    last = blank.copy()  # the first white space behind each word
    last[:1] = False
    last[1:] &= ~blank[:-1]
    data = np.where(blank, np.uint8(32), raw)[~blank | last]
    offsets = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    ends = np.searchsorted(np.flatnonzero(last), ends + np.arange(len(texts)), "right")
    return Batch(data, ends, offsets, word_hashes(data, offsets))


def cut(batch: Batch, kind: Kind) -> tuple[np.ndarray, ...]:
    """Fragments of a batch: document, begin and end (in symbols of the batch), place and hash of the anchor, hash of all."""
    windows = (int(batch.ends[-1]) if len(batch.ends) else 0) - kind.window + 1
    parts, at = [tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))], 0
    while at < windows:
        part, at = _cut_slice(batch, kind, at, min(windows, at + SLICE_SYMBOLS), windows)
        parts.append(part)
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _cut_slice(batch: Batch, kind: Kind, low: int, high: int, windows: int) -> tuple[tuple[np.ndarray, ...], int]:
    """Fragments that begin and end in the windows [low, high), and the first window that they leave over."""
    hashes = batch.hashes_of(low, high + kind.window - 1)
    anchors = _runs(hashes, kind.anchor, lambda a, b, k: a + b * np.uint64(pow(int(_BASE), k, 1 << 64)))
    order = ((_finish(anchors) >> _POSITION_BITS) << _POSITION_BITS) | np.arange(len(anchors), dtype=np.uint64)
    least = _runs(order, kind.window - kind.anchor + 1, lambda a, b, _: np.minimum(a, b))
    at = (least & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    # a window is whole unless a document ends inside it
    n = high - low
    ends = batch.ends[np.searchsorted(batch.ends, low, "right") : np.searchsorted(batch.ends, high + kind.window - 1)] - low
    crossed = np.bincount(np.clip(ends - kind.window + 1, 0, n), minlength=n + 1) - np.bincount(np.minimum(ends, n), minlength=n + 1)
    whole = np.cumsum(crossed[:n]) == 0
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    first = np.flatnonzero(fresh & whole)
    stop = np.flatnonzero(np.concatenate([fresh[1:] | ~whole[1:], [True]]) & whole)
    left = high
    if high < windows and len(first) and stop[-1] == n - 1:  # may go on; a fragment has few windows, so this is not the first
        left, first, stop = low + int(first[-1]), first[:-1], stop[:-1]
    end = stop + kind.window
    size = SLICE_SYMBOLS + kind.window
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(int(_BASE), size)[: len(hashes)], out=sums[1:])
    content = _finish((sums[end] - sums[first]) * _powers(int(_INVERSE), size)[first] + (end - first).astype(np.uint64))
    doc = np.searchsorted(batch.ends, first + low, "right")
    return (doc, first + low, end + low, at[first] + low, anchors[at[first]], content), left


def stretches(text: bytes, kind: Kind) -> Iterator[tuple[int, bytes]]:
    """(symbols before, text): the text itself, or overlapping stretches of a very long one that hold each window once."""
    lap = kind.window - 1
    if len(text) <= BATCH_SYMBOLS // 2:
        yield 0, text
    elif kind.words:
        words, step = text.split(), BATCH_SYMBOLS // 64
        for at in range(0, max(1, len(words) - lap), step):
            yield at, b" ".join(words[at : at + step + lap])
    else:
        step = BATCH_SYMBOLS // 2
        for at in range(0, max(1, len(text) - lap), step):
            yield at, text[at : at + step + lap]


def segments(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    if len(values) == 0:
        return []
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return list(zip(begins, [*begins[1:], len(values)], strict=True))


def shared(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose key another document has too."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys)
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(several, np.diff([*first, len(k)]))
    return out


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct value, by value, and the number of each row's value."""
    order = np.argsort(values)
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    group = np.empty(len(v), np.int32)
    group[order] = np.cumsum(new) - 1
    return (np.minimum.reduceat(order, np.flatnonzero(new)) if len(v) else order), group


def same_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Of the rows asked for, those whose bytes are those of the other place; equal hashes prove nothing."""
    out = np.zeros(len(at), bool)
    rows = np.flatnonzero(asked & (size == other_size) & (size > 0))
    for part in (rows[k : k + SLICE_ROWS] for k in range(0, len(rows), SLICE_ROWS)):
        equal = data[ranges(at[part], size[part])] == data[ranges(other[part], size[part])]
        out[part] = np.logical_and.reduceat(equal, np.cumsum(size[part]) - size[part])
    return out


def taken(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all [at, at + size), one after the other."""
    return np.concatenate([data[:0], *(data[ranges(at[k : k + SLICE_ROWS], size[k : k + SLICE_ROWS])] for k in range(0, len(at), SLICE_ROWS))])


def row_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = _finish(out * _BASE + c.astype(np.uint64))
    return out


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of [begin, begin + size), one after the other."""
    total = int(size.sum())
    starts = np.cumsum(size) - size
    return np.arange(total) + np.repeat(begin - starts, size)


def united(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of intervals by document, for intervals of any order; what touches is joined."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if len(doc) == 0:
        return doc, begin, end
    start_of = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    group = np.repeat(np.arange(len(start_of)), np.diff([*start_of, len(doc)]))
    span = int(end.max()) + 1
    furthest = np.maximum.accumulate(end + group * span) - group * span
    new = np.ones(len(doc), bool)
    new[1:] = (group[1:] != group[:-1]) | (begin[1:] > furthest[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], begin[first], furthest[last]


def _cut_chunk(table: pa.Table, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """Fragments of a chunk's usable documents, batch by batch: names of documents (id, place in the chunk), the batch, and
    document, begin and end in the batch, what to take off for places in the text, anchor's place and hash, hash of all.

    The chunk's documents come in the order of ``_ordered``; fragments do, too, so every pass sees the same.
    """
    pieces: list[tuple[int, int, int, bytes]] = []
    symbols = 0

    def work() -> tuple[np.ndarray, ...]:
        ids, places, base = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
        batch = read_batch([p[3] for p in pieces], kind)
        doc, begin, end, at, anchor, content = cut(batch, kind)
        shift = (np.concatenate([[0], batch.ends[:-1]]).astype(np.int64) - base)[doc]
        return ids, places, batch, doc, begin, end, shift, at, anchor, content

    for place, (name, text) in enumerate(zip(table.column(ID), table.column(TEXT), strict=True)):
        if not name.is_valid or not text.is_valid:
            continue
        for base, raw in stretches(text.as_buffer().to_pybytes(), kind):
            if pieces and symbols + len(raw) > BATCH_SYMBOLS:
                yield work()
                pieces, symbols = [], 0
            pieces.append((name.as_py(), place, base, raw))
            symbols += len(raw)
    if pieces:
        yield work()


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([(ID, "ascending"), (TAG, "ascending")])


def _bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (_finish(anchor ^ np.uint64(0x5DEECE66D)) % np.uint64(buckets)).astype(np.int64)


def _short(anchor: np.ndarray) -> np.ndarray:
    return (_finish(anchor) >> np.uint64(32)).astype(np.uint32)


def _anchors_of(cuts: Iterable[tuple[np.ndarray, ...]], buckets: int) -> tuple[np.ndarray, ...]:
    """(bucket << 32 | short hash) of a chunk's anchors, distinct and sorted, which of them several documents have, and
    the number of each fragment's."""
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for _, places, _, doc, _, _, _, _, anchor, _ in cuts:
        keys.append((_bucket_of(anchor, buckets).astype(np.uint64) << np.uint64(32)) | _short(anchor))
        docs.append(places[doc].astype(np.int32))
    key, doc = np.concatenate(keys), np.concatenate(docs)
    head, group = grouped(key)
    least, most = np.full(len(head), np.iinfo(np.int32).max, np.int32), np.full(len(head), -1, np.int32)
    np.minimum.at(least, group, doc)
    np.maximum.at(most, group, doc)
    return key[head], least < most, group


def _planes(values: np.ndarray) -> bytes:
    """Rising 32-bit numbers as differences, byte plane by byte plane, so that high bytes compress to nothing."""
    steps = np.diff(values.astype(np.int64), prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))


def _tell_anchors(kind: Kind, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, _, _ = _anchors_of(_cut_chunk(_ordered(table), kind), buckets)
        bucket = (names >> np.uint64(32)).astype(np.int64)
        runs, low = segments(bucket), names & np.uint64(0xFFFFFFFF)
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in runs], pa.int64()), CHUNK: pa.array([key[0].as_py()] * len(runs), pa.int64()),
            "block": pa.array([_planes(low[a:b]) for a, b in runs], pa.binary()),
        })

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows without the bucket) of a task's partition."""
    rows: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.setdefault(bucket, []).append(tuple(rest))
    for bucket in sorted(rows):
        yield bucket, rows.pop(bucket)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_bucket(batches):
        chunks, hashes = [c for c, _ in rows], [_from_planes(b) for _, b in rows]
        names, counts = np.unique(np.concatenate(hashes), return_counts=True)
        common = names[counts > 1]
        bits = [np.packbits(np.isin(h, common, assume_unique=True)).tobytes() for h in hashes]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int64()), pa.array(bits, pa.binary())], [CHUNK, "bucket", "bits"])


def _send(kind: Kind, buckets: int, bins: int):
    """Chunks and their answers to blocks of the fragments that are left, and to what is covered inside a batch."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        press = zstandard.ZstdCompressor(level=3)
        chunk = key[0].as_py()
        table = _ordered(table)
        # a usual chunk is cut once; the pieces of one with very long texts are cut again rather than held
        once = table.column(TEXT).nbytes <= 2 * CHUNK_BYTES
        cuts = list(_cut_chunk(table, kind)) if once else None
        names, alive, group = _anchors_of(cuts or _cut_chunk(table, kind), buckets)
        first = np.searchsorted(names, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, b = first[bucket], first[bucket + 1]
            alive[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        out: dict[str, list] = {"bucket": [], CHUNK: [], "block": []}
        held: list[tuple[np.ndarray, ...]] = []

        def emit(bucket: int, block: bytes) -> None:
            out["bucket"].append(bucket)
            out[CHUNK].append(chunk)
            out["block"].append(press.compress(block))

        def flush() -> None:
            if not held:
                return
            ids, place, begin, symbols, anchor, sizes, bucket, data = (np.concatenate([h[k] for h in held]) for k in range(8))
            order = np.argsort(bucket, kind="stable")
            starts = (np.cumsum(sizes) - sizes)[order]
            ids, place, begin, symbols, anchor, sizes, bucket = (x[order] for x in (ids, place, begin, symbols, anchor, sizes, bucket))
            for a, b in segments(bucket):
                emit(int(bucket[a]), _pack(ids[a:b], place[a:b], begin[a:b], symbols[a:b], anchor[a:b], sizes[a:b], taken(data, starts[a:b], sizes[a:b]).tobytes()))
            held.clear()

        seen = 0
        for ids, places, batch, doc, begin, end, shift, at, anchor, content in cuts or _cut_chunk(table, kind):
            left = alive[group[seen : seen + len(doc)]]
            seen += len(doc)
            doc, begin, end, shift, at, anchor, content = (x[left] for x in (doc, begin, end, shift, at, anchor, content))
            if len(doc) == 0:
                continue
            # documents come by id, so the first of equal fragments has the smallest
            head, equal = grouped(content)
            settled = (ids[doc] > ids[doc[head]][equal]) & (end - begin == (end - begin)[head][equal])
            low, high = batch.places(begin), batch.places(end)
            settled &= same_bytes(batch.data, low, high - low, low[head][equal], (high - low)[head][equal], settled)
            if settled.any():
                d, b, e = united(places[doc[settled]], (begin - shift)[settled], (end - shift)[settled])
                emit(-1, _pack_spans(d, b, e))
            doc, begin, end, shift, at, anchor = (x[~settled] for x in (doc, begin, end, shift, at, anchor))
            low, high = batch.places(begin), batch.places(end)
            held.append((ids[doc], places[doc], begin - shift, end - begin, at - begin, high - low, _bucket_of(anchor ^ np.uint64(0xB5297A4D), bins), taken(batch.data, low, high - low)))
            if sum(len(h[7]) for h in held) > HELD_BYTES:
                flush()
        flush()
        give_back()
        return pa.table({"bucket": pa.array(out["bucket"], pa.int64()), CHUNK: pa.array(out[CHUNK], pa.int64()), "block": pa.array(out["block"], pa.binary())})

    return run


def _pack(ids: np.ndarray, place: np.ndarray, begin: np.ndarray, symbols: np.ndarray, anchor: np.ndarray, sizes: np.ndarray, data: bytes) -> bytes:
    places, local = np.unique(place, return_inverse=True)
    names = ids[np.unique(place, return_index=True)[1]]
    parts = [names, places, local.astype(np.int32), begin.astype(np.int32), symbols.astype(np.uint16), anchor.astype(np.uint16), sizes.astype(np.uint32)]
    return struct.pack("<qq", len(places), len(place)) + b"".join(p.tobytes() for p in parts) + data


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    """ids, places, begin, symbols, anchor, sizes of fragments, and their bytes."""
    n_docs, n = struct.unpack_from("<qq", block)
    at, out = 16, []
    for kind, count in ((np.int64, n_docs), (np.int64, n_docs), (np.int32, n), (np.int32, n), (np.uint16, n), (np.uint16, n), (np.uint32, n)):
        out.append(np.frombuffer(block, kind, count, at))
        at += out[-1].nbytes
    return out[0][out[2]], out[1][out[2]], *(x.astype(np.int64) for x in out[3:]), np.frombuffer(block, np.uint8, offset=at)


def _pack_spans(place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(x.astype(np.int32).tobytes() for x in (place, begin, end - begin))


@dataclass
class Fragments:
    """Fragments of one bucket by document, smaller ids first."""

    doc: np.ndarray  # rank of the document id
    anchor: np.ndarray  # symbols before the anchor
    symbols: np.ndarray
    starts: np.ndarray  # in data
    sizes: np.ndarray
    data: np.ndarray


def _match_buckets(kind: Kind, match: Callable[[Fragments], tuple[np.ndarray, np.ndarray]]):
    """Blocks of fragments to blocks of intervals (place of the document, begin, length) by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()

        def rows(chunks: list[int], blocks: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blocks, pa.binary())], [CHUNK, "block"])

        for bucket, given in _by_bucket(batches):
            if bucket < 0:  # settled inside a batch
                yield rows([c for c, _ in given], [b for _, b in given])
                continue
            parts = [_unpack(open_.decompress(b)) for _, b in given]
            chunk = np.repeat([c for c, _ in given], [len(p[0]) for p in parts])
            ids, place, begin, symbols, anchor, sizes = (np.concatenate([p[k] for p in parts]) for k in range(6))
            data = np.concatenate([p[6] for p in parts])
            order = np.lexsort((begin, place, chunk, ids))
            starts = (np.cumsum(sizes) - sizes)[order]
            chunk, ids, place, begin, symbols, anchor, sizes = (x[order] for x in (chunk, ids, place, begin, symbols, anchor, sizes))
            rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
            fragment, window = match(Fragments(rank, anchor, symbols, starts, sizes, data))
            if len(fragment) == 0:
                continue
            row = np.cumsum(np.concatenate([[0], (chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1])]))
            d, b, e = united(row[fragment], begin[fragment] + window, begin[fragment] + window + kind.window)
            at = np.searchsorted(row, d)
            home = np.argsort(chunk[at], kind="stable")
            d, b, e, at = d[home], b[home], e[home], at[home]
            runs = segments(chunk[at])
            del parts, data
            yield rows([int(chunk[at[i]]) for i, _ in runs], [press.compress(_pack_spans(place[at[i:j]], b[i:j], e[i:j])) for i, j in runs])

    return run


def _finish_chunk(columns: list[str]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        table, open_ = _ordered(table), zstandard.ZstdDecompressor()
        spans = [np.frombuffer(open_.decompress(b), np.int32).reshape(3, -1) for b in found.column("block").to_pylist()]
        place, begin, size = np.concatenate([np.zeros((3, 0), np.int32), *spans], axis=1).astype(np.int64)
        place, begin, end = united(place, begin, begin + size)
        counts = np.bincount(place, minlength=table.num_rows)
        offsets = pa.array(np.concatenate([[0], counts.cumsum()]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (begin, end)]
        return pa.table([*[table.column(c) for c in columns], *lists], names=[*columns, BEGINS, ENDS])

    return run


ROW, ID, TAG, TEXT, CHUNK = "row", "__id", "__tag", "__text", "__chunk"
BEGINS, ENDS = "repeat_begins", "repeat_ends"
SPANS = T.ArrayType(T.LongType())


def covered(docs: DataFrame, kind: Kind, match: Callable[[Fragments], tuple[np.ndarray, np.ndarray]], doc_id: str, text: str) -> DataFrame:
    """All rows and columns of ``docs`` with repeat_begins and repeat_ends: what windows cover that start in a smaller id too.

    begins and ends are intervals in symbols, sorted, disjoint and not touching. ``match`` gets the fragments of a bucket
    and names its covered windows. Rows of null id or text have none and take part in nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-total // CHUNK_BYTES))
    buckets = max(LEAST_BUCKETS, -(-total // ANCHOR_BYTES))
    bins = max(LEAST_CHUNKS, -(-total // CHUNK_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks // 16))
    names = docs.columns
    rest = [c for c in names if c != text]
    # the other columns travel as one, so that none of their names meets another
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias(ROW), F.col(doc_id).cast("long").alias(ID), F.xxhash64(F.col(text)).alias(TAG),
        F.encode(F.col(text), "UTF-8").alias(TEXT),
    )
    keyed = keyed.withColumn(CHUNK, F.pmod(F.xxhash64(ID, TAG), F.lit(chunks))).repartition(tasks, CHUNK)
    # all three passes take the same columns, so that Spark makes this shuffle once
    told = keyed.groupBy(CHUNK).applyInArrow(_tell_anchors(kind, buckets), f"bucket long, {CHUNK} long, block binary")
    answers = told.repartition(tasks, "bucket").mapInArrow(_answer, f"{CHUNK} long, bucket long, bits binary")
    sent = keyed.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(_send(kind, buckets, bins), f"bucket long, {CHUNK} long, block binary")
    # what is settled already goes along, dealt by its chunk
    dealt = sent.repartition(tasks, F.when(F.col("bucket") < 0, -F.col(CHUNK)).otherwise(F.col("bucket")))
    found = dealt.mapInArrow(_match_buckets(kind, match), f"{CHUNK} long, block binary")
    out = T.StructType([T.StructField(ROW, T.StructType([docs.schema[c] for c in rest])), T.StructField(TEXT, T.BinaryType()), T.StructField(BEGINS, SPANS), T.StructField(ENDS, SPANS)])
    done = keyed.groupBy(CHUNK).cogroup(found.groupBy(CHUNK)).applyInArrow(_finish_chunk([ROW, TEXT]), out)
    return done.select(*[F.decode(TEXT, "UTF-8").alias(text) if c == text else F.col(f"{ROW}.`{c}`") for c in names], BEGINS, ENDS)
