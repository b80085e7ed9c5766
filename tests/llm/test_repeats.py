"""Substring operators against brute force over all windows."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import fragments, queries, relative_lz, suffix_levels

SF = "/root/testdata/sf0.01"


def brute(sequences, window):
    """By position in ``sequences`` of (id, symbols): covered symbols as a mask."""
    first = {}
    for i, s in sequences:
        if i is not None:
            for k in range(len(s) - window + 1):
                w = s[k : k + window]
                if i < first.get(w, i + 1):
                    first[w] = i
    out = []
    for i, s in sequences:
        mask = np.zeros(len(s), bool)
        if i is not None:
            for k in range(len(s) - window + 1):
                if first[s[k : k + window]] < i:
                    mask[k : k + window] = True
        out.append(mask)
    return out


def odd_texts(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé ", k=rng.randrange(1, 7))) for _ in range(60)] + ["日本", "\n", "  ", "x\x00y"]
    passages = [" ".join(rng.choices(vocabulary, k=n)) for n in (8, 12, 13, 14, 30, 200)]
    rows = [(None, passages[4] * 3), (7, None), (8, ""), (9, " "), (10, "z" * 400), (11, "z" * 300), (3, "ab " * 300), (2, "ab " * 80), (10, passages[5]), (10, passages[5])]
    for i in range(150):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))) for _ in range(3)]
        rows.append((20 + i, (" " if i % 3 else "").join([parts[0], rng.choice(passages), parts[1], rng.choice(passages)[:300], parts[2]])))
    rows += [(1000 + i, passages[5] + str(i % 3)) for i in range(40)]
    rng.shuffle(rows)
    return rows


def spans(mask):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_on_odd_texts(spark, seed, monkeypatch):
    rows = odd_texts(seed)
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id string, tag long").repartition(5)
    got = {r.tag: r for r in suffix_levels.remove_repeats(docs).collect()}
    want = brute([(i, (t or "").encode()) for i, t in rows], 50)
    assert len(got) == len(rows)
    for k, mask in enumerate(want):
        raw = np.frombuffer((rows[k][1] or "").encode(), np.uint8)
        assert (got[k].repeat_begins, got[k].repeat_ends) == spans(mask), rows[k]
        assert bytes(got[k].repeat_kept) == raw[~mask].tobytes() and got[k].id == "x"
    assert suffix_levels.remove_repeats(docs.limit(0)).count() == 0


def test_levels_stay_few_and_hold_everything():
    rng = np.random.default_rng(0)
    index, seen = suffix_levels.SuffixLevels(), set()
    for _ in range(60):
        batch = np.unique(rng.integers(0, 5000, 200).astype("S5"))
        old = index.holds(batch)
        assert old.tolist() == [b in seen for b in batch.tolist()]
        index.add(batch[~old])
        seen |= set(batch.tolist())
        assert len(index.levels) <= 14 and all(len(a) >= 2 * len(b) for a, b in zip(index.levels, index.levels[1:]))


def test_very_long_texts_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(fragments, "BATCH_SYMBOLS", 4096)
    for kind in (fragments.BYTES, fragments.WORDS):
        text = " ".join(str(i) for i in range(30_000)).encode()
        symbols = text.split() if kind.words else text
        windows = []
        for base, part in fragments.stretches(text, kind):
            n = len(part.split() if kind.words else part)
            windows += range(base, base + n - kind.window + 1)
        assert windows == list(range(len(symbols) - kind.window + 1))


def test_registered_bytes(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op2_suffix_levels(spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, raw), mask in zip(rows, brute(rows, 50), strict=True):
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (
            len(raw), int(mask.sum()), len(spans(mask)[0]), hashlib.sha256(kept).hexdigest()
        )


@pytest.mark.parametrize("block", [7, 8192])
def test_words_on_odd_texts(spark, block, monkeypatch):
    rows = odd_texts(3)
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id string, tag long").repartition(5)
    got = {r.tag: r for r in relative_lz.remove_repeats(docs).collect()}
    words = [(t or "").encode().split() for _, t in rows]
    assert len(got) == len(rows)
    for k, mask in enumerate(brute([(i, tuple(w)) for (i, _), w in zip(rows, words, strict=True)], 13)):
        assert (got[k].repeat_begins, got[k].repeat_ends, got[k].repeat_words) == (*spans(mask), len(words[k])), rows[k]
        assert got[k].repeat_kept == b" ".join(w for w, m in zip(words[k], mask, strict=True) if not m).decode()
    assert relative_lz.remove_repeats(docs.limit(0)).count() == 0


def test_parsing_against_many_small_blocks(monkeypatch):
    """The matcher alone, with blocks of few stretches, so that most matches lie in earlier blocks."""
    monkeypatch.setattr(relative_lz, "BLOCK_STRETCHES", 5)
    rng = np.random.default_rng(2)
    pool = [" ".join(rng.choice(list("abcdefgh"), 22)) for _ in range(12)]
    texts = []
    for _ in range(120):
        a, b = pool[rng.integers(12)].split(), pool[rng.integers(12)].split()
        cut = int(rng.integers(0, 22))
        texts.append(a[:cut] + b[cut:])
    sizes = np.array([len(" ".join(t)) + 1 for t in texts])
    data = np.frombuffer(("".join(" ".join(t) + " " for t in texts)).encode(), np.uint8)
    n = len(texts)
    monkeypatch.setattr(relative_lz, "candidates", lambda f, c, p: np.ones(len(f.doc), bool))
    frags = fragments.Fragments(np.arange(n), np.zeros(n, int), np.full(n, 22), np.cumsum(sizes) - sizes, sizes, data)
    got = set(zip(*(x.tolist() for x in relative_lz.match(frags)), strict=True))
    first = {}
    for i, t in enumerate(texts):
        for k in range(10):
            first.setdefault(tuple(t[k : k + 13]), i)
    assert got == {(i, k) for i, t in enumerate(texts) for k in range(10) if first[tuple(t[k : k + 13])] < i}


def test_registered_words(spark):
    rows = [(r.doc_id, tuple((r.text or "").encode().split())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op9_relative_lz(spark, SF).collect()}
    for (i, words), mask in zip(rows, brute(rows, 13), strict=True):
        kept = b" ".join(w for w, m in zip(words, mask, strict=True) if not m)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), int(mask.sum()), hashlib.sha256(kept).hexdigest())


def thue_morse(bits):
    """Two words of 2**bits bytes that polynomials modulo 2^64 cannot tell apart, whatever their base."""
    flags = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[f] for f in flags), "".join("ba"[f] for f in flags)


def test_words_are_told_by_their_bytes(spark):
    one, other = thue_morse(11)
    shared = [f"w{i}" for i in range(6)]
    docs = spark.createDataFrame([(1, " ".join([*shared, one, *shared])), (2, " ".join([*shared, other, *shared])), (3, " ".join([*shared, one, *shared]))], "doc_id long, text string")
    got = {r.doc_id: list(r.repeat_begins) for r in relative_lz.remove_repeats(docs).collect()}
    assert got == {1: [], 2: [], 3: [0]}


def test_equal_hashes_prove_nothing():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    at, size, head = np.array([0, 3, 6, 6]), np.array([3, 3, 3, 2]), np.array([0, 0, 0, 0])
    asked = np.array([False, True, True, True])
    assert fragments.same_bytes(data, at, size, head, np.array([3, 3, 3, 3]), asked).tolist() == [False, False, True, False]


def test_columns_of_any_name_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(40))
    names = ["__id", "__tag", "__text", "__chunk", "__kept", "kept", "row", "repeat_words"]
    docs = spark.createDataFrame([(i, text, *range(i, i + len(names))) for i in (7, 8)], f"doc_id long, text string, {' int, '.join(names)} int")
    for operator in (relative_lz.remove_repeats, suffix_levels.remove_repeats):
        rows = {r.doc_id: r.asDict() for r in operator(docs).collect()}
        for i in (7, 8):
            own = [c for c in names if c != "repeat_words" or operator is suffix_levels.remove_repeats]
            assert [rows[i][c] for c in own] == [i + k for k, c in enumerate(names) if c in own]


def test_blocks_and_levels_decide(monkeypatch):
    """With small blocks the factors against earlier blocks, and with small batches the levels, find what sorting found."""
    rng = np.random.default_rng(5)
    words = [f"v{i}".encode() for i in range(40)]
    passages = [b" ".join(words[j] for j in rng.integers(0, 40, 18)) + b" " for _ in range(6)]
    parts = [passages[k] for k in rng.integers(0, 6, 300)]
    sizes = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    frags = fragments.Fragments(np.arange(300) // 2, np.full(300, 7), np.full(300, 18), np.cumsum(sizes) - sizes, sizes, data)
    calls = []
    real = relative_lz.parse
    monkeypatch.setattr(relative_lz, "parse", lambda *a: calls.append(1) or real(*a))
    whole = set(zip(*(x.tolist() for x in relative_lz.match(frags))))
    monkeypatch.setattr(relative_lz, "BLOCK_STRETCHES", 16)
    assert not calls
    assert set(zip(*(x.tolist() for x in relative_lz.match(frags)))) == whole and calls


def test_a_batch_is_cut_in_slices(monkeypatch):
    """What is held beside two megabytes of text is a small multiple of them, and slices cut no fragment in two."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, int(n), np.uint8)) for n in rng.integers(0, 20_000, 200)]
    batch = fragments.read_batch(texts, fragments.BYTES)
    tracemalloc.start()
    whole = fragments.cut(batch, fragments.BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))
    mixed = [b"", b"ab" * 300, b"", b"x" * 49, b"y" * 50, *texts[:3], b""]
    few = fragments.read_batch(mixed, fragments.BYTES)
    expected = fragments.cut(few, fragments.BYTES)
    for size in (64, 100, 1000):
        monkeypatch.setattr(fragments, "SLICE_SYMBOLS", size)
        assert all(np.array_equal(a, b) for a, b in zip(fragments.cut(few, fragments.BYTES), expected, strict=True))
    edges = np.cumsum([0, *map(len, mixed)])
    windows = [w for b, e in zip(expected[1], expected[2], strict=True) for w in range(b, e - 49)]
    assert windows == [w for a, b in zip(edges, edges[1:]) for w in range(a, b - 49)] and len(whole[0]) > 1000


def test_a_chunk_is_cut_once_for_its_answers(monkeypatch):
    texts = [("word%d " % (k % 3)).encode() * 40 + b"same words in every text " * 8 for k in range(6)]
    table = pa.table({fragments.ID: pa.array(range(6), pa.int64()), fragments.TAG: pa.array([0] * 6, pa.int64()), fragments.TEXT: pa.array(texts, pa.binary())})
    answers = pa.table({"bucket": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
    calls, real = [], fragments.cut
    monkeypatch.setattr(fragments, "cut", lambda *a: calls.append(1) or real(*a))
    for kind in (fragments.BYTES, fragments.WORDS):
        calls.clear()
        sent = fragments._send(kind, 4, 4)((pa.scalar(0),), table, answers)
        assert sent.num_rows and len(calls) == 1
        # texts too long to be held are cut again, with the same outcome
        monkeypatch.setattr(fragments, "CHUNK_BYTES", 1)
        assert fragments._send(kind, 4, 4)((pa.scalar(0),), table, answers).equals(sent) and len(calls) == 3
        monkeypatch.setattr(fragments, "CHUNK_BYTES", 4 << 20)


def test_words_are_read_as_split_reads_them(monkeypatch):
    """Columns of words and their hashes come from the bytes of all texts at once, not word by word."""
    rng = np.random.default_rng(4)
    texts = [b"", b" ", b"a", b"\t\x0b a  b\r\nc\x0c", b"", "ü\xa0x  y".encode(), b"long" * 40_000 + b" x " + b"long" * 40_000, bytes(rng.integers(0, 256, 5000, np.uint8))]
    words = [t.split() for t in texts]
    flat = [w for p in words for w in p]
    calls, real = [], fragments.xxhash.xxh64_intdigest
    monkeypatch.setattr(fragments.xxhash, "xxh64_intdigest", lambda *a: calls.append(1) or real(*a))
    for size in (16, 1 << 16):
        monkeypatch.setattr(fragments, "SLICE_SYMBOLS", size)
        calls.clear()
        batch = fragments.read_batch(texts, fragments.WORDS)
        assert batch.data.tobytes() == b"".join(w + b" " for w in flat)
        assert batch.ends.tolist() == np.cumsum([len(p) for p in words]).tolist()
        assert np.diff(batch.offsets).tolist() == [len(w) + 1 for w in flat]
        named = {}
        assert all(named.setdefault(w, h) == h for w, h in zip(flat, batch.hashes.tolist(), strict=True))
        assert len(set(named.values())) == len(named)
    assert len(calls) == 2  # the words longer than a slice
    assert len(fragments.read_batch([], fragments.WORDS).hashes) == 0
