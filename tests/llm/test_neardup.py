import random

import pytest
from pyspark.sql import functions as F

from ridelens.llm import neardup
from tests.llm.helpers import docs, hard_rows


def brute(rows, threshold=0.8):
    """{doc_id: (copy_of, class_id, n_links)} by comparing all pairs of word sets."""
    sets = {}
    for d, t in rows:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {d: {o for o in sets if o != d and sets[d] and sets[o] and len(sets[d] & sets[o]) >= threshold * len(sets[d] | sets[o])} for d in sets}
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        same = [o for o in sets if sets[o] == sets[d] and sets[d]]
        out[d] = (min([d, *same]), min(seen), len(links[d]))
    return out


def near_copies(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            w = list(rng.choice(base[-4:]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.randrange(3, 120))
        base.append(w)
        rows.append((i, " ".join(w)))
    return rows


def result(df):
    return {r.doc_id: (r.copy_of, r.class_id, r.n_links) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = near_copies(150)
    assert result(neardup.jaccard_join(docs(spark, rows))) == brute(rows)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 7)
    rows = [(i, " ".join([f"c{j}" for j in range(60)] + [f"u{i % 40}"])) for i in range(60)] + [(100 + i, t) for i, t in near_copies(40)]
    assert result(neardup.jaccard_join(docs(spark, rows))) == brute(rows)


def test_hard_rows(spark):
    got = neardup.jaccard_join(docs(spark, hard_rows())).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 6]
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got)
    kept = neardup.keep_one(docs(spark, [*hard_rows(), (9, "one")]))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_empty(spark):
    assert neardup.jaccard_join(docs(spark, [])).collect() == []


def test_bands_reach_the_target():
    for recall in (0.9, 0.99, 0.9999):
        b = neardup.bands_for(0.8, recall, 6)
        assert 1 - (1 - 0.8**6) ** b >= recall > 1 - (1 - 0.8**6) ** (b - 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in joined}


def test_keep_one_with_clashing_names_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "x")
    rows = [(1, long, 7, "a"), (2, near, 8, "b"), (3, "another text here", 9, "c"), (3, "another text here", 9, "c"), (3, "a third one", 10, "d"), (None, "n", 1, "e"), (None, "n", 1, "e"), (4, None, 2, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int, `text_hash` string")
    df = df.withColumn("_text_key", F.lit(7)).withColumn("row", F.create_map(F.lit("k"), F.lit(1))).withColumn("a.b", F.lit(3))
    kept = neardup.keep_one(df.repartition(3))
    assert kept.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text, r.gone_id, r.text_hash) for r in kept.collect()), key=str)
    assert got == sorted({r for r in rows if r[0] != 2}, key=str)
    assert {(r["_text_key"], r["row"]["k"], r["a.b"]) for r in kept.collect()} == {(7, 1, 3)}


@pytest.mark.parametrize("block", [5, 9])
def test_large_groups_by_differences_from_their_core(spark, monkeypatch, block):
    """Groups with a core whose documents are near it, far from it, of other lengths, repeated, or chained without any core."""
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", block)
    rng = random.Random(block)
    base = [f"c{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            w[rng.randrange(80)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w[: rng.choice([80, 80, 72, 66])])))
    rows += [(200 + i, " ".join(f"s{j}" for j in range(4 * i, 4 * i + 60))) for i in range(25)]
    expected = brute(rows)
    assert max(v[2] for v in expected.values()) > 20 and len({v[1] for v in expected.values()}) < 60
    assert result(neardup.jaccard_join(docs(spark, rows + rows[:4]))) == expected


def test_documents_near_a_core_are_not_paired(spark, monkeypatch):
    """Of light edits of one text no pair of blocks is made: their links are counted."""
    monkeypatch.setattr(neardup, "BLOCK_DOCUMENTS", 10)
    rows = [(i, " ".join([*(f"c{j}" for j in range(120)), f"u{i}"])) for i in range(90)]
    inside = docs(spark, rows).select(
        F.lit(0).cast("long").alias("root"), "doc_id", F.lit(1).cast("long").alias("copies"), F.lit(90).cast("long").alias("n"), F.lit(9).alias("blocks"), "text", F.xxhash64("text").alias("text_hash")
    )
    apart = neardup._differences(inside, 0.8)
    assert apart.filter("far").count() == 0 and neardup._far_from_core(apart, 0.8).count() == 0
    assert {r.links for r in neardup._near_core(apart).filter("links > 0").collect()} == {89}
    assert result(neardup.jaccard_join(docs(spark, rows))) == brute(rows)
