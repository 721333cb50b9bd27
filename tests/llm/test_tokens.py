import random

import numpy as np
import pytest

from ridelens.llm import tokens
from tests.llm.helpers import docs, hard_rows


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.MODEL)


def texts(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        alphabet = rng.choice(["ab ", "abc", "the and ing", "a\nb ", "éçxyz  ", "日本語 ab", "aaaaaa", "  x"])
        rows.append((i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(200, 700)))))
    return rows


@pytest.mark.parametrize("chunk", [97, 150])
def test_chunked_encoding_is_the_library_encoding(spark, model, chunk):
    rows = texts(chunk)
    got = {r.doc_id: r for r in tokens.encode(docs(spark, rows), chunk=chunk).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert got[d].tokens == model.encode(t), t
        assert got[d].round_trip and got[d].scan_ok


def test_hard_rows_and_decoding(spark, model):
    rows = [*hard_rows(), (8, "▁x")]
    encoded = tokens.encode(docs(spark, rows), chunk=1000)
    got = sorted(((r.doc_id, r.tokens, r.round_trip) for r in encoded.collect()), key=str)
    assert got == sorted(((d, model.encode(t or ""), "▁" not in (t or "")) for d, t in rows), key=str)
    back = sorted(((r.doc_id, r.text) for r in tokens.decode(encoded).collect()), key=str)
    assert back == sorted(((d, (t or "").replace("▁", " ")) for d, t in rows), key=str)


def test_empty(spark):
    assert tokens.encode(docs(spark, [])).collect() == []


def test_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random(s) < 0.4, -np.inf, rng.random(s)) for s in [(3, 4), (4, 5), (5, 2)])
    left, right = tokens.product(tokens.product(a, b), c), tokens.product(a, tokens.product(b, c))
    assert np.array_equal(np.isfinite(left), np.isfinite(right))
    assert np.allclose(np.where(np.isfinite(left), left, 0), np.where(np.isfinite(right), right, 0))


def test_giant_rows_that_repeat_or_have_no_id(spark, model):
    long, other = "ab cd\n" * 300, "xy " * 400
    rows = [(1, long), (1, long), (None, long), (None, other), (1, other), (2, long)]
    got = sorted(((r.doc_id, r.tokens, r.round_trip, r.scan_ok) for r in tokens.encode(docs(spark, rows), chunk=200).collect()), key=str)
    assert got == sorted(((d, model.encode(t), True, True) for d, t in rows), key=str)


def test_a_scan_without_one_path_is_encoded_whole(spark, model, monkeypatch):
    monkeypatch.setattr(tokens, "product", lambda a, b: np.full((a.shape[0], b.shape[1]), -np.inf))
    rows = [(1, "ab cd\n" * 300), (2, "a▁b " * 300), (3, "short")]
    got = {r.doc_id: r for r in tokens.encode(docs(spark, rows), chunk=200).collect()}
    assert [got[d].tokens for d in (1, 2, 3)] == [model.encode(t) for _, t in rows]
    assert [(got[d].round_trip, got[d].scan_ok) for d in (1, 2, 3)] == [(True, False), (False, False), (True, True)]
