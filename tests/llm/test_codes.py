import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import codes
from ridelens.llm.queries import op11_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, position int, part string"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The definition row by row: (vec_id, label, code, error), books."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts)
    ints = np.zeros((len(rows), parts * width), np.int64)
    for i, r in enumerate(rows):
        ints[i, : len(r[1])] = np.floor(np.asarray(r[1], np.float32).astype(float) * scale)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i].tolist()))
    out, books = [""] * len(rows), []
    errors = np.zeros(len(rows), np.int64)
    for p in range(parts):
        part = ints[:, p * width : (p + 1) * width]
        book = part[order[:entries]].copy()
        for k in range(rounds + 1):
            d = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            if k < rounds:
                for e in set(at.tolist()):
                    book[e] = part[at == e].sum(axis=0) // (at == e).sum()
        out = [c + f"{e:02x}" for c, e in zip(out, at)]
        errors += d.min(axis=1)
        books.append(book)
    return [(r[0], r[2], c, int(e)) for r, c, e in zip(rows, out, errors)], np.array(books)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, "y") for i, v, label in rows], SCHEMA)


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0], r[1] is None, r[1], r[2]))


def test_equals_the_definition_with_hot_vectors_ties_and_gaps(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), np.float32(v), int(i) % 3) for i, v in enumerate(rng.normal(0, 0.1, (700, 12)))]
    hot = np.float32(rng.normal(0, 0.1, 12))
    rows += [(1000 + i, hot, None if i % 2 else 5) for i in range(400)]  # one vector holds a third
    rows += [(7, hot, 1), (7, hot, 1), (3, rows[3][1], 0), (None, hot, 2)]  # repeated ids, no id
    rows += [(5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * 12, 1), (5003, [float("inf")] * 12, 1)]
    rows += [(5004, [], 1), (5005, [0.5], None), (5006, [-3.0] * 12, 4)]
    want, books = plain(rows)
    got, got_books = codes.compress(table(spark, rows).repartition(5))
    assert np.array_equal(books, got_books)
    assert by_id(got.select("vec_id", "label", "code", "error").collect()) == by_id(want)
    summed = {r.label: r.label_error for r in codes.with_label_error(got).collect()}
    assert summed == {lab: sum(e for _, x, _, e in want if x == lab) for lab in {x for _, x, _, _ in want}}


def test_few_rows_none_and_huge_components(spark):
    assert codes.compress(table(spark, []))[0].count() == 0
    assert codes.compress(table(spark, [(1, None, 1)]))[0].count() == 0
    got, books = codes.compress(table(spark, [(2, [0.25] * 8, 1), (1, [-0.25] * 8, 1)]))
    assert by_id(got.collect()) == [(1, 1, "00000000", 0), (2, 1, "01010101", 0)] and books.shape == (4, 2, 2)
    got, books = codes.compress(table(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]))
    assert abs(books).max() == codes.limit(2) and [r.error for r in got.collect()] == [0, 0, 0]


def test_shortlists_never_lose_the_nearest_entry():
    rng = np.random.default_rng(5)
    for spread in (3, 40, 300):
        book = rng.integers(-300, 300, (200, 6))
        members = rng.integers(-300, 300, (1, 6)) + rng.integers(-spread, spread + 1, (50, 6))
        listed = np.flatnonzero(codes.shortlists(members.min(axis=0)[None], members.max(axis=0)[None], book)[0])
        d = ((members[:, None] - book) ** 2).sum(axis=2)
        at, error = codes.nearest(members, book, listed)
        assert np.array_equal(at, d.argmin(axis=1)) and np.array_equal(error, d.min(axis=1))
        assert spread > 40 or len(listed) < 100


@pytest.mark.parametrize("bits,width", [(1, 3), (2, 2), (3, 3), (5, 2)])
def test_the_curve_visits_neighbours(bits, width):
    """Every cell once, and consecutive places are one step apart."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), axis=-1).reshape(-1, width)
    keys = codes.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_large_integers_are_exact():
    most = codes.limit(4)
    members, book = np.array([[most] * 4, [-most, most, 0, 1]]), np.array([[-most] * 4, [most - 1] * 4])
    at, error = codes.nearest(members, book, np.arange(2))
    assert at.tolist() == [1, 0] or error[0] == 4
    want = [min(sum((int(a) - int(b)) ** 2 for a, b in zip(m, e)) for e in book) for m in members]
    assert error.tolist() == want


def test_decoded_vectors_are_near(spark):
    rows = [(i, np.random.default_rng(i % 4).normal(0, 0.1, 8), 1) for i in range(40)]
    coded, books = codes.compress(table(spark, rows))
    for r in codes.decode(coded, books).collect():
        assert np.abs(np.array(r.vector) - rows[r.vec_id][1]).max() <= 0.5 / 1024 + 1e-6
    assert codes.decode(coded.withColumn("code", F.lit(None).cast("string")), books).filter("vector is null").count() == 40


def test_query_carries_the_digest_of_its_codebooks(spark):
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.random.default_rng(1).normal(0, 0.1, (30, 8)))]
    _, books = plain(rows)
    assert codes.books_digest(books) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert callable(op11_vector_codes)
