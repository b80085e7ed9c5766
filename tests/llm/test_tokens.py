"""BPE encoding, decoding and token counts against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from sluice.llm import bpe, queries, token_counts
from sluice.llm.vocabulary import DEFAULT_PATH, load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(DEFAULT_PATH)


def odd_texts():
    rng = random.Random(7)
    words = ["the", " tion", "é", "ß", "\n", "  ", " ", "\t", "'s", "'ll", "123", "!?", "日本語", "😀", "á", " ", "x" * 50, "<|endoftext|>", "_", "\x1c"]
    mixed = ["".join(rng.choices(words, k=rng.choice([1, 5, 60, 900]))) for _ in range(60)]
    unsplit = ["".join(rng.choices("abcdeé", k=n)) for n in (300, 3000, 9000)] + ["ab" * 4000, "a" * 7001, " " * 5000 + "x", "é" * 5000, "日" * 3000]
    return [None, "", " ", *mixed, *unsplit, "word " * 4000, "<|endoftext|>" * 300, unsplit[1] + " tail " + unsplit[2]]


def test_ids_and_text(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, None, "kept") for i, t in enumerate(texts)], "doc_id long, text string, bpe_ids string, parts string")
    for part in (37, 700, 65_536):
        rows = bpe.decode(bpe.encode(docs, part_chars=part)).collect()
        assert len(rows) == len(texts) and {r.parts for r in rows} == {"kept"}
        for r in rows:
            assert r.bpe_ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, (part, texts[r.doc_id])
            assert r.bpe_text == library.decode(r.bpe_ids, skip_special_tokens=False)


def test_pieces_join_exactly(library):
    coder, rng = load(DEFAULT_PATH), random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choices("abetion", k=rng.randrange(1, 400))).encode()
        assert coder.encode_piece(piece, leaf=rng.choice([1, 7, 30])) == library.encode(piece.decode(), add_special_tokens=False).ids


def test_counts(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 1, "kept") for i, t in enumerate(texts)] * 2, "doc_id long, text string, token_count int, start string")
    for chunk, overlap in ((90, 30), (1000, 12), (32_768, 512)):
        rows = token_counts.count_tokens(docs, chunk_chars=chunk, overlap=overlap).collect()
        assert len(rows) == 2 * len(texts) and {r.start for r in rows} == {"kept"}
        for r in rows:
            assert r.token_count == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids), (chunk, texts[r.doc_id])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none)).count() == token_counts.count_tokens(none).count() == 0


def test_decode_odd_ids(spark):
    rows = bpe.decode(spark.createDataFrame([(None,), ([],), ([999_999],), ([162],)], "bpe_ids array<int>")).collect()
    assert [r.bpe_text for r in rows] == ["", "", "", "�"]


def test_registered(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: r for r in queries.op1_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(texts[i]))
    counted = {r.doc_id: r for r in queries.op7_token_counts(spark, SF).collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in counted.items()} == {
        i: (len(t.encode()), len(ids[i]), len(ids[i]) > 512) for i, t in texts.items()
    }
