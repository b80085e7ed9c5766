"""Periodic runs of words, found by recursive frequency splitting and a scan over lags.

A run is a maximal stretch of words in which words ``period`` apart are identical, of at least ``least`` words and
``times`` periods. Each of its words therefore occurs at least ``times`` times in it, so in any segment that holds the
whole run. A word that occurs less often in its segment splits it, which makes other words too rare; that is repeated until
no segment changes, and segments shorter than ``least`` go. Prose falls apart in a pass or two.

The segments that survive are scanned for lags, without trying each: stretches of 16, 32, 64.. words are named by
doubling, and the lag of a place is the distance at which its stretch comes next. Inside a run of smallest period q this
lag is q at every place, for the stretches of the power of two from q up, and outside it is not (two periods would have a
common divisor as a period). Runs are the rows of equal lags; n words cost n log n steps, however often they repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.batches import give_back, small_batches

WORDS, RUNS, COLLAPSED = "periodic_words", "periodic_runs", "periodic_text"
RUN_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_BLANK = b" \t\n\x0b\x0c\r"
#: bytes of a text that are split into words at once
PIECE = 1 << 20


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; no piece ends inside a word."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in _BLANK:
            end += 1
        yield raw[at:end].split()
        at = end


def word_ids(raw: bytes) -> np.ndarray:
    """One number a word, equal for equal words."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in _pieces(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _stretches(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True, cut where ``breaks`` is True as well."""
    opens = flags & np.concatenate([[True], ~flags[:-1] | breaks[1:]])
    closes = flags & np.concatenate([~flags[1:] | breaks[1:], [True]])
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def surviving_segments(ids: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments in which every word occurs ``times`` times, of at least ``least`` words."""
    done, low, high = [], np.array([0]), np.array([len(ids)])
    while True:
        wide = high - low >= least
        low, high = low[wide], high[wide]
        if not len(low):
            break
        sizes = high - low
        segment = np.repeat(np.arange(len(low)), sizes)
        place = np.arange(len(segment)) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        _, inverse, counts = np.unique(segment * (len(ids) + 1) + ids[place], return_inverse=True, return_counts=True)
        rare = counts[inverse] < times
        changed = np.zeros(len(low), bool)
        changed[segment[rare]] = True
        done.append(np.stack([low[~changed], high[~changed]]))
        b, e = _stretches(changed[segment] & ~rare, np.concatenate([[True], segment[1:] != segment[:-1]]))
        low, high = place[b], place[e - 1] + 1
    found = np.concatenate(done, axis=1) if done else np.zeros((2, 0), np.int64)
    return tuple(found[:, np.argsort(found[0])])


def _next_lag(names: np.ndarray) -> np.ndarray:
    """How far on the same name comes next; 0 where it does not."""
    order = np.argsort(names, kind="stable")
    lag = np.zeros(len(names), np.int64)
    same = names[order[1:]] == names[order[:-1]]
    lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return lag


def lag_runs(ids: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. ``times`` must be at least 3."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by this scan")
    # the widest stretch that every run of a period up to its width holds twice, a period apart
    k = 1
    while all(max(least, times * q) - q >= 2 * k for q in range(1, 2 * k + 1)):
        k *= 2
    names, width, lowest, out = ids, 1, 0, [np.zeros((0, 3), np.int64)]
    while max(least, times * (lowest + 1)) <= len(ids):
        while width < k:
            pairs = names[:-width] * (len(ids) + 1) + names[width:]
            names, width = np.unique(pairs, return_inverse=True)[1], 2 * width
        lag = _next_lag(names)
        lag[(lag <= lowest) | (lag > k)] = 0
        b, e = _stretches(lag > 0, np.concatenate([[True], lag[1:] != lag[:-1]]))
        period = lag[b]
        length = e - b + k - 1 + period
        enough = length >= np.maximum(least, times * period)
        out.append(np.stack([b, length, period], axis=1)[enough])
        lowest, k = k, 2 * k
        if k > len(names) + width - 1:
            break
    found = np.concatenate(out)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def periodic_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of a document, by start and period."""
    low, high = surviving_segments(ids, least, times)
    if not len(low):
        return np.zeros((0, 3), np.int64)
    # segments side by side, each followed by a word of its own
    sizes = high - low + 1
    begins = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(begins[-1]) + np.repeat(low - begins[:-1], sizes)
    joined = ids[np.minimum(place, len(ids) - 1)]
    joined[begins[1:] - 1] = ids.max() + 1 + np.arange(len(low))
    joined = np.unique(joined, return_inverse=True)[1]
    found = lag_runs(joined, least, times)
    found[:, 0] = place[found[:, 0]]
    return found


def _collapsed(raw: bytes, runs: np.ndarray, n_words: int) -> str:
    """The words outside of runs and in the first period of one, joined by a space."""
    if not len(runs):
        return b" ".join(b" ".join(words) for words in _pieces(raw) if words).decode()
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept, at, parts = np.cumsum(edges)[:-1] == 0, 0, []
    for words in _pieces(raw):
        left = [words[i] for i in np.flatnonzero(kept[at : at + len(words)]).tolist()]
        at += len(words)
        if left:
            parts.append(b" ".join(left))
    return b" ".join(parts).decode()


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with periodic_words (long), periodic_runs and periodic_text.

    periodic_runs has (start, length, period) of each run by start and period; words are stretches of other than ASCII
    white space, numbered from 0. periodic_text has the words joined by a space without those that a run holds after its
    first period. A null or empty text has no words, no runs and an empty text. Repeated rows get equal results, an empty
    table stays empty, and columns named like the new ones are replaced.
    """
    docs = docs.drop(WORDS, RUNS, COLLAPSED)
    small_batches(docs.sparkSession)
    fields = [T.StructField(WORDS, T.LongType()), T.StructField(RUNS, RUN_TYPE), T.StructField(COLLAPSED, T.StringType())]
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends, rows, texts = [], [0], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                raw = (value.as_py() or "").encode()
                ids = word_ids(raw)
                found = periodic_runs(ids, least, times)
                counts.append(len(ids))
                ends.append(ends[-1] + len(found))
                rows.append(found)
                texts.append(_collapsed(raw, found, len(ids)))
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            runs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())],
                [*batch.schema.names, WORDS, RUNS, COLLAPSED],
            )
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def strongest_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first by start, then period."""

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    none = F.lit(None).cast(RUN_TYPE.elementType)
    return F.aggregate(runs, none, better)


def runs_text(runs: Column) -> Column:
    """One line ``start,length,period`` a run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text, or for ids whose CRC32 is divisible by ten its words with a period repeated from some word to the end."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(
            F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i.cast("long") - a) % p).cast("int")))), " ")

    # the words are bound once: inside a lambda an expression is worked out for every element
    bound = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, bound).otherwise(text)


def crc_of(doc_id: object) -> int:
    """CRC32 of an id in decimal, as ``with_planted_run`` takes it."""
    return zlib.crc32(str(doc_id).encode())
