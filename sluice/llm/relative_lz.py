"""Substring dedup over words by relative Lempel-Ziv parsing.

Documents' stretches are dealt by their anchors (``fragments``). In a bucket they come in blocks of rising document ids.
Every stretch is factored greedily against every block of smaller documents, the references: from a word on, the longest
match in the block's index, then on behind it. A factor of at least ``window`` words makes its words duplicates. A greedy
factor can end inside another match, so the windows that cross a factor boundary are looked up one by one. Only stretches
that say something new become references, so a common passage is indexed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.fragments import WORDS, Fragments, covered, ranges, row_hash, shared
from sluice.llm.names import unused

#: stretches in a reference block; a document's stretches stay together
BLOCK_STRETCHES = 1 << 12
#: a window holds this many words before its anchor and the anchor, or the anchor and as many after it
SIDE = (WORDS.window - WORDS.anchor) // 2


def word_codes(frags: Fragments) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for the words of all fragments, in the order of the data, and each fragment's first word."""
    ends = np.flatnonzero(frags.data == 32)
    words = frags.data.tobytes().split(b" ")[:-1]  # every word ends with a space
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))
    return codes, np.searchsorted(ends, frags.starts)


class Reference:
    """A block's index: its suffixes of up to ``depth`` words, sorted. Rows are big-endian codes, 0 behind the end."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray, depth: int):
        self.depth = depth
        at, end = ranges(first, size), np.repeat(first + size, size)
        self.rows = np.unique(rows_of(codes, at, end, depth))

    def longest(self, query: np.ndarray) -> np.ndarray:
        """Words that the longest match of each query row has."""
        at = np.searchsorted(self.rows, query)
        best = np.zeros(len(query), np.int64)
        for side in (at - 1, at):
            near = np.clip(side, 0, len(self.rows) - 1)
            a, b = (x.view(">u4").reshape(len(query), self.depth) for x in (np.ascontiguousarray(query), self.rows[near]))
            same = (a == b) & (a != 0)
            best = np.maximum(best, np.where(same.all(axis=1), self.depth, (~same).argmax(axis=1)))
        return best


def rows_of(codes: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` codes from each place, 0 from ``end`` on, as byte strings that sort like the codes."""
    place = at[:, None] + np.arange(depth)
    inside = place < end[:, None]
    rows = np.where(inside, codes[np.minimum(place, len(codes) - 1)], 0).astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").reshape(-1)


def parse(reference: Reference, codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window) of all windows of the stretches that the reference holds, from their greedy factors."""
    last = size - WORDS.window
    at = np.zeros(len(first), np.int64)
    active = np.flatnonzero(last >= 0)
    inner, crossing = [], []
    while len(active):
        here = first[active] + at[active]
        length = reference.longest(rows_of(codes, here, first[active] + size[active], reference.depth))
        held = np.clip(length - WORDS.window + 1, 0, None)  # windows inside the factor
        held = np.minimum(held, last[active] - at[active] + 1)
        inner.append((np.repeat(active, held), ranges(at[active], held)))
        begin = at[active] + np.maximum(held, 1)
        end = np.minimum(at[active] + length, last[active] + 1)
        span = np.clip(end - begin, 0, None)
        crossing.append((np.repeat(active, span), ranges(begin, span)))
        at[active] += np.maximum(length, 1)
        active = active[at[active] <= last[active]]
    stretch, window = (np.concatenate(c) for c in zip(*crossing, strict=True)) if crossing else (np.zeros(0, np.int64),) * 2
    if len(stretch):
        places = first[stretch] + window
        known = reference.longest(rows_of(codes, places, first[stretch] + size[stretch], reference.depth)) >= WORDS.window
        inner.append((stretch[known], window[known]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in zip(*inner, strict=True)) if inner else (none, none)


def candidates(frags: Fragments, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fragments that share words before or after an anchor, and the anchor, with another document."""
    place, width = first + frags.anchor, WORDS.anchor + SIDE
    out = np.zeros(len(place), bool)
    for at, fits in ((place, frags.symbols - frags.anchor >= width), (place - SIDE, frags.anchor >= SIDE)):
        f = np.flatnonzero(fits)
        if len(f):
            out[f] |= shared(row_hash([codes[at[f] + k] for k in range(width)]), frags.doc[f])
    return out


def match(frags: Fragments) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, window in it) of all windows that a smaller document has too."""
    if len(frags.doc) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, first = word_codes(frags)
    chosen = np.flatnonzero(candidates(frags, codes, first))
    depth = int(frags.symbols[chosen].max()) if len(chosen) else 0
    references: list[Reference] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    doc, at = frags.doc[chosen], 0
    while at < len(chosen):
        stop = int(np.searchsorted(doc, doc[min(at + BLOCK_STRETCHES, len(doc)) - 1], side="right"))
        part = chosen[at:stop]
        start, size = first[part], frags.symbols[part]
        windows = size - WORDS.window + 1
        base = np.cumsum(windows) - windows
        known = np.zeros(int(windows.sum()), bool)
        for reference in references:
            # stretches that are wholly known need no further reference
            left = np.flatnonzero(np.add.reduceat(~known, base) > 0)
            stretch, window = parse(reference, codes, start[left], size[left])
            known[base[left][stretch] + window] = True
        # inside the block, a window belongs to the smallest document that has it
        stretch = np.repeat(np.arange(len(part)), windows)
        window = ranges(np.zeros(len(part), np.int64), windows)
        own = rows_of(codes, start[stretch] + window, start[stretch] + window + WORDS.window, WORDS.window)
        _, head, group = np.unique(own, return_index=True, return_inverse=True)
        owner = frags.doc[part][stretch]
        told = known | (owner > owner[head][group])
        found.append((part[stretch[told]], window[told]))
        new = np.add.reduceat(~told, base) > 0
        if new.any():
            references.append(Reference(codes, start[new], size[new], depth))
        at = stop
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in zip(*found, strict=True)) if found else (none, none)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``repeat_begins`` and ``repeat_ends`` (array<long>, in words), ``repeat_words``
    (long) and ``repeat_kept`` (string).

    Words are runs of characters other than ASCII white space. Removed are all words covered by a run of 13 words that also
    starts in a document with a smaller id; begins and ends are the removed runs, repeat_words counts all words of the text
    and repeat_kept holds the others, joined by one space. Null texts have no words; texts under 13 words, and rows of null
    id, keep everything and take nothing from others. Rows of equal id do not take from each other. Columns with the new
    names are replaced, others pass through.
    """
    docs = docs.drop("repeat_begins", "repeat_ends", "repeat_words", "repeat_kept")
    @F.pandas_udf("struct<words: long, kept: string>")
    def kept(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, e in zip(texts, begins, ends, strict=True):
            words, at, parts = (t or "").encode().split(), 0, []
            for x, y in zip(b, e, strict=True):
                parts += words[at:x]
                at = y
            out.append((len(words), b" ".join(parts + words[at:]).decode()))
        return pd.DataFrame(out, columns=["words", "kept"])

    [told_by] = unused(docs.columns, "kept")
    told = covered(docs, WORDS, match, doc_id, text).withColumn(told_by, kept(F.col(text), "repeat_begins", "repeat_ends"))
    return told.select(
        *[F.col(f"`{c}`") for c in docs.columns], "repeat_begins", "repeat_ends",
        F.col(f"{told_by}.words").alias("repeat_words"), F.col(f"{told_by}.kept").alias("repeat_kept"),
    )
