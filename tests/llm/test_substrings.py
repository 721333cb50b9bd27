import random
import re

from ridelens.llm import substrings
from tests.llm.helpers import docs, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def passages(n=60, seed=5):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(8, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(shared) if rng.random() < 0.6 else rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(30))
        rows.append((i * 7 % n, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_equals_brute_force(spark):
    rows = passages()
    assert result(substrings.remove_repeats(docs(spark, rows))) == brute(rows)


def test_hot_keys_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_DOCUMENTS", 3)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    rows = passages(seed=6)
    assert result(substrings.remove_repeats(docs(spark, rows))) == brute(rows)


def test_hard_rows(spark):
    rows = [*hard_rows(), (7, "a b " * 10), (7, "a b " * 10), (7, "b a " * 10), (None, "a b " * 10)]
    assert result(substrings.remove_repeats(docs(spark, rows))) == brute(rows)
    assert substrings.remove_repeats(docs(spark, [])).collect() == []


def test_automaton_finds_the_smallest_document():
    rng = random.Random(8)
    for _ in range(40):
        texts = [(rng.choices("ab", k=rng.randrange(1, 30)), rng.randrange(9)) for _ in range(rng.randrange(1, 7))]
        automaton = substrings.SuffixAutomaton()
        for w, d in texts:
            automaton.add(w, d)
        automaton.finish()
        probe = rng.choices("ab", k=25)
        want = []
        for i in range(len(probe) - 3):
            window = probe[i : i + 4]
            holds = [d for w, d in texts for j in range(len(w) - 3) if w[j : j + 4] == window]
            want.append(min(holds) if holds else None)
        assert automaton.first_documents(probe, 4) == want


def test_rows_in_slices_of_batches(spark, monkeypatch):
    """The same result whether a task takes its rows in one slice or in many."""
    rng = random.Random(3)
    part = [" ".join(rng.choices(["a", "b", "c", "d"], k=40)) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(part, 3) + [f"u{i}"])) for i in range(60)]
    want = sorted(map(tuple, substrings.remove_repeats(docs(spark, rows).coalesce(1)).collect()))
    whole = substrings.sliced
    monkeypatch.setattr(substrings, "sliced", lambda batches, *a: whole(batches, "text", 500))
    assert sorted(map(tuple, substrings.remove_repeats(docs(spark, rows).coalesce(1)).collect())) == want
    assert any(r[2] for r in want)
