"""Where statements begin in records: a lexer as a parallel automaton.

A record is what stands between two separators. In which state the lexer enters it depends on all text before, so each
record is turned into a transition function: the state it leaves in for every state it may be entered in. Functions are
composed, first over the records of a split, then over the splits of a file, and no text is looked at twice for one state.

States are short strings: ``""`` a statement may begin, ``m`` inside a statement whose separator was part of a comment,
``'`` and ``"`` inside quotes, ``*`` inside a block comment, ``q`` and a closing mark inside q'[..]'. Only states that
occur in a dump are followed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.dialects import Dialect
from sluice.functions.scale import materialise
from sluice.functions.text import LEADING_NOISE

START, WITHIN = "", "m"
#: states that a file may end in without being broken
CLOSED = (START, WITHIN)


def _left_over(text: Column, dialect: Dialect, state: str) -> Column:
    """What stands at the end of a text after its last complete token; text from ``state`` on."""
    noise = LEADING_NOISE.removeprefix(r"(?i)\A")
    # a ``;`` outside literals ends a statement in the middle of a record, and directives may follow
    body = rf"(?:{dialect.token}|;(?i:{noise})?+)*+"
    lead = rf"(?i:{noise})?+" if state == START else dialect.closing(state)
    return F.regexp_replace(text, rf"\A{lead}{body}", "")


def _state_of(rest: Column, dialect: Dialect) -> Column:
    mark = F.regexp_extract(rest, r"(?s)\A[nN]?[qQ]'(.?)", 1)
    closer = F.translate(mark, "[{(<", "]})>")
    state = F.when(rest == "", START)
    if dialect.q_quotes:
        # a record that ends behind the quote has the separator's ``;`` as its mark
        state = state.when(rest.rlike(r"\A[nN]?[qQ]'"), F.concat(F.lit("q"), F.when(mark == "", ";").otherwise(closer)))
    for sign, name in (("'", "'"), ('"', '"'), ("/*", "*"), ("--", WITHIN), ("#", WITHIN)):
        state = state.when(rest.startswith(sign), F.lit(name))
    return state.otherwise(START)


def whole_statement(dialect: Dialect) -> str:
    """An INSERT from its first letter on whose literals are all closed, and that holds nothing else a lexer must know of:
    outside its literals there is no ``;``, no comment, no name in quotes, no quote of another form."""
    q, inner, signs = (r"(?<![qQ])" if dialect.q_quotes else ""), *((r"[^'\\]", r"\\#") if dialect.backslash else ("[^']", ""))
    other = rf"""[^-/";'{signs}]*"""
    return rf"""\A(?i:INSERT){other}(?:(?:{q}'{inner}*'|-(?!-)|/(?!\*)){other})*+\z"""


def _plain(dialect: Dialect) -> str:
    """INSERTs whose state is told by the number of their quotes: no sign of a comment, of a name in quotes, of a quote of
    another form, in a literal or not. A ``;`` may be followed by a directive with a quote of its own."""
    q, signs = ("qQ", r"|[qQ](?!')") if dialect.q_quotes else ("", "")
    escapes = r"\\#" if dialect.backslash else ""
    return rf"""\A(?i:INSERT)(?:[^-/";{q}{escapes}]+|-(?!-)|/(?!\*)|;(?![\r \t]){signs})*+\z"""


def leaves_in(text: Column, dialect: Dialect, state: str = START) -> Column:
    """The state after ``text``, entered in ``state``. Whole INSERTs are known by one pattern, and the plain ones among the
    others by the number of their quotes."""
    slow = _state_of(_left_over(text, dialect, state), dialect)
    if state != START:
        if state == WITHIN:
            return slow
        return F.when(text.rlike(rf"\A{dialect.closing(state)}"), slow).otherwise(F.lit(state))
    odd = ~text.rlike(_plain(dialect))
    quotes = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("'"), F.lit("")))
    whole = text.rlike(whole_statement(dialect))
    return F.when(whole, START).when(odd, slow).otherwise(F.when(quotes % 2 == 0, START).otherwise("'"))


def transitions(records: DataFrame, dialect: Dialect) -> tuple[DataFrame, list[str]]:
    """Records with ``leaves``, the index of the state they leave in by the index of the state they are entered in.

    ``records`` must be stored: one pass is made for each round of states that turn up. Returns the states as well; the
    first is ``START``.
    """
    states, fresh = [START], [START]
    while fresh:
        seen = records.select(F.explode(F.array(*[leaves_in(F.col("value"), dialect, s) for s in fresh])).alias("s"))
        fresh = sorted({r.s for r in seen.distinct().collect()} - set(states))
        states += fresh
    number = F.create_map(*[c for i, s in enumerate(states) for c in (F.lit(s), F.lit(i))])
    leaves = F.array(*[F.element_at(number, leaves_in(F.col("value"), dialect, s)) for s in states])
    return records.withColumn("leaves", leaves), states


def _table(leaves: pd.Series) -> np.ndarray:
    return np.array(leaves.tolist(), np.int64).reshape(len(leaves), -1)


def _walk(table: np.ndarray, order: np.ndarray, state: int, met: tuple[np.ndarray, np.ndarray] | None):
    """States before each record and the statement heads, -1 as long as none is met, of records entered in one state.

    ``met`` is the same for another state: where both come to the same state they go on as one, and the rest is taken over.
    """
    before, heads, head, others = [], [], -1, None if met is None else met[0].tolist()
    for i, (row, place) in enumerate(zip(table.tolist(), order.tolist(), strict=True)):
        if others is not None and others[i] == state:
            later = met[1][i:]
            return np.array(before + others[i:]), np.concatenate([np.array(heads, np.int64), np.where(later >= place, later, head)])
        before.append(state)
        if state == 0:
            head = place
        heads.append(head)
        state = row[state]
    return np.array([*before, state]), np.array(heads, np.int64)


def scan_splits(n_states: int):
    """Records ordered by split and place -> for every record and entry state the ``ord`` its statement begins at in the
    split, or -1; behind each split a row without ``ord`` with the states it leaves in and its last heads.

    A batch at a time: what is kept between batches are a state and a head for each entry state.
    """

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, n_states), pa.int32()), pa.array(values.ravel(), pa.int64()))

    def row(split: tuple, order, heads: np.ndarray, after: np.ndarray | None) -> pa.RecordBatch:
        path, block, chunk = split
        n = len(heads)
        nothing = pa.nulls(n, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([chunk] * n, pa.int64()),
             pa.nulls(n, pa.int64()) if order is None else pa.array(order, pa.int64()), lists(heads), nothing if after is None else lists(after)],
            ["file_path", "block_start", "chunk_id", "ord", "heads", "leaves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, states, heads = None, None, None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            blocks, order = column["block_start"].to_numpy(), column["ord"].to_numpy()
            paths = column["file_path"].dictionary_encode()
            table = column["leaves"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n_states)
            path_of = paths.indices.to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (path_of[1:] != path_of[:-1])) + 1
            for at, end in zip([0, *cuts], [*cuts, len(order)], strict=True):
                if at == end:
                    continue
                here = (paths.dictionary[int(path_of[at])].as_py(), int(blocks[at]), column["chunk_id"][int(at)].as_py())
                if here != split:
                    if split is not None:
                        yield row(split, None, heads[None], states[None])
                    split, states, heads = here, np.arange(n_states), np.full(n_states, -1, np.int64)
                walks, first = {}, None
                for state in sorted(set(states.tolist())):
                    walks[state] = _walk(table[at:end], order[at:end], state, first)
                    first = first or walks[state]
                found = np.stack([np.where(walks[s][1] >= 0, walks[s][1], h) for s, h in zip(states.tolist(), heads, strict=True)], axis=1)
                yield row(split, order[at:end], found, None)
                states, heads = np.array([walks[s][0][-1] for s in states.tolist()]), found[-1]
        if split is not None:
            yield row(split, None, heads[None], states[None])

    return run


def scan_file(states: list[str]):
    """Splits of one file -> the state each is entered in, the statement it goes on with, and whether the file is broken."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block_start")
        table, heads = _table(frame["leaves"]), _table(frame["heads"])
        state, carried, enters, blocks, chunks, orders = 0, None, [], [], [], []
        for block, chunk, leaves, head in zip(frame["block_start"], frame["chunk_id"], table, heads, strict=True):
            enters.append(state)
            for out, value in zip((blocks, chunks, orders), carried or (None,) * 3, strict=True):
                out.append(value)
            if head[state] >= 0:
                carried = (block, chunk, head[state])
            state = int(leaves[state])
        none = pd.array([None] * 0, "Int64")
        return pd.DataFrame({
            "file_path": frame["file_path"], "block_start": frame["block_start"], "enters": enters,
            "head_block": pd.array(blocks, none.dtype), "head_chunk": pd.array(chunks, none.dtype),
            "head_ord": pd.array(orders, none.dtype), "broken": states[state] not in CLOSED,
        })

    return run


def statement_heads(marked: DataFrame, states: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per record (file_path, block_start, ord, heads), per split (.., enters, head_block, head_chunk, head_ord, broken).

    A task goes through its splits in order and holds a batch of records, however long a split is.
    """
    keys = ["file_path", "block_start"]
    ordered = marked.select(*keys, "chunk_id", "ord", "leaves").repartition(*keys).sortWithinPartitions(*keys, "ord")
    inside = materialise(ordered.mapInArrow(
        scan_splits(len(states)), "file_path string, block_start long, chunk_id long, ord long, heads array<long>, leaves array<long>"), "record-heads")
    per_file = inside.filter("ord IS NULL").drop("ord").groupBy("file_path").applyInPandas(
        scan_file(states),
        "file_path string, block_start long, enters int, head_block long, head_chunk long, head_ord long, broken boolean")
    return inside.filter("ord IS NOT NULL").select(*keys, "ord", "heads"), per_file
