"""The corpus pipeline, stage by stage: each stage against a brute-force version on what the stage before kept."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sluice.functions.scale import materialise
from sluice.llm import quality
from sluice.llm.vocabulary import DEFAULT_PATH
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), f"test-{name}"))
    return [frame.collect() for frame in out]


def test_columns_and_order(spark, stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "similar", "repeats", "mixing", "tokens"]
    for rows in stages[1:-1]:
        assert tuple(rows[0].__fields__) == pipeline.COLUMNS


def test_quality(spark, stages):
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: model.score(np.array([quality.features(r.text or "")]))[0] for r in stages[0]}
    assert {r.doc_id for r in stages[1]} == {i for i, s in score.items() if s >= 0.7}


def test_one_of_similar_stays(stages):
    """Exactly the smallest id of every group that links of at most four bits connect."""
    prints = {r.doc_id: brute_print(r.text) for r in stages[1]}
    values = sorted(set(prints.values()))
    links = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4]
    part, least = brute_components(links, values), {}
    for i, p in prints.items():
        least[part[p]] = min(i, least.get(part[p], i))
    assert {r.doc_id for r in stages[2]} == set(least.values())
    assert len(stages[2]) == len(least) < len(stages[1])


def test_rows_of_one_id(spark):
    """Equal rows of one id are one document; rows of one id with unlike texts, or without an id, are told apart."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (7, b, "de", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_one_of_similar(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", a), ("1", b), ("None", c)]


def test_repeats(stages):
    rows = [(r.doc_id, r.text.encode()) for r in stages[2]]
    want = {}
    for (i, raw), mask in zip(rows, brute_repeats(rows, 50), strict=True):
        left = np.frombuffer(raw, np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
        if left:
            want[i] = left
    got = {r.doc_id: r.text for r in stages[3]}
    assert got.keys() == want.keys()
    assert all(got[i] == want[i] or abs(len(got[i]) - len(want[i])) <= 3 for i in want)  # pieces of characters may meet
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_mixing(stages):
    want = brute_mix([(r.doc_id, r.text, r.source) for r in stages[3]])
    taken = {}
    for r in stages[4]:
        taken[str(r.doc_id)] = taken.get(str(r.doc_id), 0) + 1
    assert taken == {i: t // n for i, n, _, _, t in want if t}


def test_tokens(stages):
    library = Tokenizer.from_file(DEFAULT_PATH)
    texts = {r.doc_id: r.text for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.bpe_ids, r.n_tokens, r.text_sha256) == (ids, len(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c " * 30, "en", "a", 1), (3, "w " * 40_000, "en", None, 1), (3, "w " * 40_000, "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= 2 * docs.count()
