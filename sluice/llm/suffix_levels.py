"""Suffix-array dedup: a logarithmic family of suffix arrays, merge-scanned by every new batch.

Documents' stretches are dealt by their anchors (``fragments``). In a bucket they come in batches of rising document ids.
A batch gets the suffix array of its windows, ordered by the first ``window`` bytes, which are all that a match needs;
equal neighbours in it are repeats inside the batch. The array is then merge-scanned against the arrays of earlier
batches, the levels, for windows they hold. What is new becomes a level of its own, and levels of about equal size merge,
so there are never more than logarithmically many. Bytes are compared, not hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.fragments import BYTES, Fragments, covered, ranges, row_hash, shared

#: windows in a batch; a document's windows stay together
BATCH_WINDOWS = 1 << 14
#: a window holds this many bytes before its anchor and the anchor, or the anchor and as many after it
SIDE = (BYTES.window - BYTES.anchor) // 2


class SuffixLevels:
    """Sorted arrays of distinct windows; the sizes at least double from one to the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, sorted_windows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(sorted_windows), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, sorted_windows), len(level) - 1)
            found |= level[at] == sorted_windows
        return found

    def add(self, sorted_windows: np.ndarray) -> None:
        if len(sorted_windows) == 0:
            return
        self.levels.append(sorted_windows)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            merged = np.concatenate([self.levels.pop(), self.levels.pop()])
            merged.sort(kind="stable")  # two sorted runs: one merge
            self.levels.append(merged)


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes (ties by place in ``starts``), and those bytes."""
    rows = np.lib.stride_tricks.sliding_window_view(data, depth)[starts]
    keys = np.ascontiguousarray(rows).view(f"S{depth}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def candidates(frags: Fragments) -> np.ndarray:
    """Fragments that share ``SIDE`` bytes before or after an anchor, and the anchor, with another document."""
    place, width = frags.starts + frags.anchor, BYTES.anchor + SIDE
    out = np.zeros(len(place), bool)
    for at, fits in ((place, frags.symbols - frags.anchor >= width), (place - SIDE, frags.anchor >= SIDE)):
        f = np.flatnonzero(fits)
        if len(f):
            out[f] |= shared(row_hash([frags.data[at[f] + k] for k in range(width)]), frags.doc[f])
    return out


def match(frags: Fragments) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, window in it) of all windows that a smaller document has too."""
    chosen = np.flatnonzero(candidates(frags))
    index, found = SuffixLevels(), []
    sizes = frags.symbols[chosen] - BYTES.window + 1
    doc = frags.doc[chosen]
    at = 0
    upto = np.cumsum(sizes)
    while at < len(chosen):
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_WINDOWS)) + 1
        stop = int(np.searchsorted(doc, doc[min(stop, len(doc)) - 1], side="right"))
        part, size = chosen[at:stop], sizes[at:stop]
        window = ranges(np.zeros(len(part), np.int64), size)
        fragment = np.repeat(part, size)
        order, keys = suffix_array(frags.data, frags.starts[fragment] + window, BYTES.window)
        fragment, window = fragment[order], window[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(first) - 1
        heads = keys[first]
        old = index.holds(heads)
        owner = frags.doc[fragment]
        hit = old[group] | (owner > owner[first][group])
        found.append((fragment[hit], window[hit]))
        index.add(heads[~old])
        at = stop
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in zip(*found, strict=True)) if found else (none, none)


@F.pandas_udf(T.StringType())
def kept_text(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """A text without the given runs of bytes; characters of which only a part is left go too."""
    out = []
    for t, b, e in zip(texts, begins, ends, strict=True):
        raw = (t or "").encode()
        edges = [0, *(x for pair in zip(b, e, strict=True) for x in pair), len(raw)]
        out.append("".join(raw[edges[k] : edges[k + 1]].decode("utf-8", "ignore") for k in range(0, len(edges), 2)))
    return pd.Series(out)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``repeat_begins`` and ``repeat_ends`` (array<long>) and ``repeat_kept`` (binary).

    Removed are all bytes covered by a 50-byte string that also starts in a document with a smaller id: begins and ends
    are the removed runs in bytes of the text's UTF-8, sorted, with kept bytes between; repeat_kept is the rest. Null texts
    are empty; texts shorter than 50 bytes, and rows of null id, keep everything and take nothing from others. Rows of
    equal id do not take from each other. Columns with the three new names are replaced, others pass through.
    """
    docs = docs.drop("repeat_begins", "repeat_ends", "repeat_kept")
    value = F.coalesce(F.col(text), F.lit(""))
    @F.pandas_udf(T.BinaryType())
    def kept(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, b, e in zip(texts, begins, ends, strict=True):
            raw, at, parts = (t or "").encode(), 0, []
            for x, y in zip(b, e, strict=True):
                parts.append(raw[at:x])
                at = y
            out.append(b"".join([*parts, raw[at:]]))
        return pd.Series(out)

    told = covered(docs, BYTES, match, doc_id, text)
    return told.withColumn("repeat_kept", F.when(F.size("repeat_begins") == 0, F.encode(value, "UTF-8")).otherwise(kept(F.col(text), "repeat_begins", "repeat_ends")))
