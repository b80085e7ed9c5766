"""What must not grow with the input: rows held by a task, tasks that do all the work, sorts of whole records."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.operators import profile
from sluice.plans import load_queries, queries
from sluice.session import scratch
from sluice.sources import dumps, encoding, lexer, ranges

SF = "/root/testdata/sf0.01"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_heads_of_splits_in_batches(size):
    """Batches cut anywhere give the heads and end states of every record and entry state."""
    rng, n = np.random.default_rng(size), 3
    blocks = np.repeat([0, 10, 20, 30], [1, 40, 5, 54])
    paths = np.repeat(["a", "b"], [41, 59])
    table, order = rng.integers(0, n, (100, n)), np.arange(100) + 500
    table[rng.random(100) < 0.6] = np.arange(n)
    batches = [pa.RecordBatch.from_arrays(
        [pa.array(paths[i : i + size]), pa.array(blocks[i : i + size]), pa.array(blocks[i : i + size]), pa.array(order[i : i + size]),
         pa.array(table[i : i + size].tolist(), pa.list_(pa.int32()))], ["file_path", "block_start", "chunk_id", "ord", "leaves"])
        for i in range(0, 100, size)]
    got = pa.Table.from_batches(list(lexer.scan_splits(n)(iter(batches)))).to_pylist()
    want = []
    for block in (0, 10, 20, 30):
        states, heads = list(range(n)), [-1] * n
        for i in np.flatnonzero(blocks == block):
            heads = [int(order[i]) if s == 0 else h for s, h in zip(states, heads)]
            states = [int(table[i, s]) for s in states]
            want.append((block, int(order[i]), heads, None))
        want.append((block, None, heads, states))
    assert [(r["block_start"], r["ord"], r["heads"], r["leaves"]) for r in got] == want


def test_work_is_dealt(spark):
    """Cheap rows with much work in each are not left in the one split of a small file; dumps are not three files."""
    for made in (load_queries.ddl_convert_names(spark, SF), queries.ddl_convert(spark, SF)):
        assert made.rdd.getNumPartitions() >= 8
    kinds = load_queries._kinds(load_queries._orders(spark, SF), [F.lit("a"), F.lit("b")])
    assert kinds.rdd.getNumPartitions() >= 8


def test_charset_batches_are_bounded(spark):
    spark.conf.set(ROWS, "10000")
    files = spark.createDataFrame([(1, b"INSERT")], "doc_id int, head binary")
    for step in (encoding.detect_charset, encoding.fallback_charset):
        spark.conf.set(ROWS, "10000")
        step(files)
        assert int(spark.conf.get(ROWS)) <= 250


def test_split_totals_sort_no_records(spark, monkeypatch, capsys):
    plans = []
    monkeypatch.setattr(dumps, "materialise", lambda df, label: plans.append(df) or df)
    path = queries._dump(spark, SF, "customer")
    dumps.scan(dumps.read_records(spark, path))
    plans[0].explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_files_of_blocks(spark, monkeypatch):
    """A bucket is written as one file for each block of keys, the first under the bucket's own name."""
    monkeypatch.setattr(load_queries, "_BLOCK", 8000)
    o, folder = load_queries._orders(spark, SF), scratch(spark, "dump-blocks")
    load_queries._write_files(spark, load_queries._bucketed(o), folder)
    files = {r[0].rsplit("/", 1)[-1] for r in spark.read.text(folder).select(F.input_file_name()).distinct().collect()}
    blocks = {r[0] for r in o.select(F.floor(F.col("o_orderkey") / 8000)).distinct().collect()}
    assert len(blocks) > 1
    assert {f.replace("%3D", "=").replace("%2C", ",") for f in files} == {
        f"bucket={k}{f',block={b}' if b else ''}.sql" for k in range(4) for b in blocks}
    assert spark.read.option("lineSep", ";\n").text(folder).count() == o.count()


TEXTS = [
    "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (1, 'a -- b /* \" ; q''x')", "INSERT INTO t VALUES (1, 'it''s", "insert into t values (-1, '')",
    "INSERT INTO t VALUES (q'[it's]')", "INSERT INTO t VALUES (nq'!a", "INSERT INTO t VALUES (1) -- it's", "INSERT INTO t VALUES (1) /* it's", "INSERT INTO t VALUES (5-4/2, 'x')",
    "INSERT INTO \"it's\" VALUES (1)", "INSERT INTO t VALUES ('a\\'b')", "INSERT INTO t VALUES (1); PROMPT it's", "PROMPT it's", "", "INSERT INTO t VALUES ('a;\nb')", "INSERT INTO t VALUES (1) ",
    "INSERT INTO t VALUES ('q', 'Q''', 'xq')", "INSERT INTO t VALUES (1) # it's",
]


@pytest.mark.parametrize("name", ["oracle", "mysql", "ansi"])
def test_whole_statements_are_told_in_one_walk(spark, name, monkeypatch):
    """What one pattern tells is what the lexer and the careful way to statements say, signs inside literals included."""
    dialect = dumps.dialect_of(name)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "ord long, value string")
    state, slow = lexer.leaves_in(F.col("value"), dialect), lexer._state_of(lexer._left_over(F.col("value"), dialect, ""), dialect)
    whole = F.col("value").rlike(lexer.whole_statement(dialect))
    rows = texts.select("ord", whole.alias("whole"), state.alias("state"), slow.alias("slow")).collect()
    assert {TEXTS[r.ord] for r in rows if r.whole} >= {TEXTS[0], TEXTS[1], TEXTS[3], TEXTS[8], TEXTS[14]}
    assert all(r.state == r.slow == "" for r in rows if r.whole)
    records = texts.select(F.lit("f").alias("file_path"), F.lit(0).alias("block_start"), F.lit(0).alias("chunk_id"), "ord", "value", F.lit(False).alias("bad_bytes"))
    quick = dumps.to_statements(records, dialect).collect()
    monkeypatch.setattr(dumps, "whole_statement", lambda d: r"\A(?!)")
    assert sorted(quick) == sorted(dumps.to_statements(records, dialect).collect())


def test_kinds_and_magnitudes_are_numbers(spark):
    """No text and, up to 18 digits, no decimal is compared for each value; longer integers keep their magnitude."""
    expected = {
        "NULL": (profile.NULL, None, None), "'a'": (profile.TEXT, None, None), "-5": (profile.INT, 5, None), "1.50": (profile.DEC, None, None),
        "999999999999999999": (profile.INT, 999999999999999999, None), "-9223372036854775809": (profile.INT, None, 9223372036854775809),
        "1e5": (profile.FLOAT, None, None), "007": (profile.TEXT, None, None), "'2024-01-31'": (profile.DATE, None, None),
        "TO_DATE('2024-01-31 10:00:00', 'YYYY-MM-DD HH24:MI:SS')": (profile.STAMP, None, None), "'2024-02-31'": (profile.TEXT, None, None), "SYSDATE": (profile.TEXT, None, None)}
    described = profile._described(spark.createDataFrame([(v,) for v in expected], "raw string"))
    types = dict(described.dtypes)
    assert (types["kind"], types["small"], types["large"]) == ("int", "bigint", "decimal(20,0)")
    rows = described.collect()
    assert {r.raw: (r.kind, r.small, None if r.large is None else int(r.large)) for r in rows} == expected
    texts = {r.raw: r.text for r in rows}
    assert texts["'2024-01-31'"] == "2024-01-31" and texts["TO_DATE('2024-01-31 10:00:00', 'YYYY-MM-DD HH24:MI:SS')"] == "2024-01-31 10:00:00"


def test_heads_of_known_charset_stay_in_the_jvm(spark, monkeypatch):
    """Python decodes the heads that are no UTF-8 and have no mark, not all of them in every charset (load_ledger)."""
    @F.pandas_udf("string")
    def none(data: pd.Series, charset: pd.Series) -> pd.Series:
        assert data.isna().all()
        return pd.Series([None] * len(data), dtype=object)

    monkeypatch.setattr(encoding, "decode_strict", none)
    heads = [b"INSERT INTO t VALUES (1);\n" * 9, "INSERT INTO t VALUES ('é');\n".encode(), "INSERT".encode("utf-16"), b""]
    files = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, head binary")
    rows = {r.k: (r.encoding, r.confidence, r.ignore_errors) for r in encoding.choose_charset(files).collect()}
    assert rows == {0: ("utf-8", 1.0, False), 1: ("utf-8", 1.0, False), 2: ("utf-16", 1.0, False), 3: ("utf-8", 1.0, False)}


def test_ranges_are_digested_one_at_a_time(tmp_path):
    """Ends of files become digests where they are read; the bytes of a batch of files are never held together."""
    data = bytes(range(256)) * 1024
    (tmp_path / "a").write_bytes(data)
    n = 300
    uris, at, size = pd.Series([(tmp_path / "a").as_uri()] * n), pd.Series(range(n)), pd.Series([64 * 1024] * n)
    ranges.digest_range.func(uris[:1], at[:1], size[:1])
    tracemalloc.start()
    got = ranges.digest_range.func(uris, at, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [hashlib.sha256(data[k : k + 64 * 1024]).hexdigest() for k in range(n)] and peak < 2 << 20
