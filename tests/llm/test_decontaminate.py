import random

from ridelens.llm import decontaminate
from ridelens.llm.common import table
from tests.conftest import SF001
from tests.llm.helpers import docs, hard_rows


def least_edits(pattern, text):
    """Least edits between the pattern and any piece of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = "q"
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, "z")
    return "".join(s)


def test_equals_full_alignment():
    rng = random.Random(4)
    words = ["the", "of", "anat", "ering", "onou", "thest", "whand", "edly"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(rng.randrange(8, 24))) for i in range(12)]
    index = decontaminate.Index(items)
    texts = []
    for i, t in items:
        for share in (0.0, 0.03, 0.05, 0.08, 0.2):
            texts.append(say(10) + " " + edited(rng, t, int(len(t) * share)) + " " + say(5))
    got = index.scan(texts)
    for t, found in zip(texts, got):
        want = set()
        for s, of, k in zip(index.segments, index.items, index.budget):
            if least_edits("".join(map(chr, s)), t.lower()) <= k:
                want |= set(of)
        assert set(found) == want


def test_whole_items_are_found(spark):
    d, b = table(spark, SF001, "documents"), table(spark, SF001, "benchmark")
    items = [(r.item_id, r.text) for r in b.collect()]
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.scan(d, b).collect()}
    for r in d.collect():
        assert {i for i, t in items if t in r.text} <= got[r.doc_id]
    assert sum(map(bool, got.values())) < 60


def test_hard_rows_and_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_CHARACTERS", 60)
    item = "A benchmark question of some length, asked only once."
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "short"), (1, item), (4, item + " More of it.")], "item_id long, text string")
    rows = [*hard_rows(), (8, "x " * 500 + item.upper().replace(" ", "\n") + " y"), (9, item[:30])]
    got = {(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontaminate.scan(docs(spark, rows), bench).collect()}
    assert (8, True, (1,)) in got and sum(c for _, c, _ in got) == 1
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows) - 1
    assert decontaminate.scan(docs(spark, []), bench).collect() == []
    assert decontaminate.scan(docs(spark, rows), bench.limit(0)).filter("contaminated").count() == 0


def test_a_line_that_many_items_share(monkeypatch):
    """Items that begin with one instruction: found where the line stands, with and without small groups."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    line = " ".join(word() for _ in range(15)) + " "
    items = [(i, line + " ".join(word() for _ in range(9))) for i in range(60)]
    index = decontaminate.Index(items)
    # No segment inside the line is stored more than once.
    assert len({s.tobytes() for s in index.segments}) == len(index.segments) < 60 * 28
    texts = [line * 4, line[:30] + " " + items[7][1][80:], " ".join(word() for _ in range(60)), line[20:70] + edited(rng, line[:75], 3)]
    got = index.scan(texts)
    assert got[0] == list(range(60)) and got[1] == [7] and got[2] == []
    for t, found in zip(texts, got):
        want = {i for s, of, k in zip(index.segments, index.items, index.budget) for i in of if least_edits("".join(map(chr, s)), t.lower()) <= k} if len(t) < 500 else set(found)
        assert set(found) == want
    monkeypatch.setattr(decontaminate, "MATCHES", 50)
    monkeypatch.setattr(decontaminate, "BANDS", 3)
    assert index.scan(texts[1:]) == got[1:]


def test_every_excerpt_of_a_segments_length_is_found():
    rng = random.Random(6)
    letters = "abcdefghijklmnop "
    item = "".join(rng.choices(letters, k=250)).strip()
    excerpts = [item[i : i + decontaminate.SEGMENT] for i in range(len(item) - decontaminate.SEGMENT + 1)]
    assert decontaminate.SEGMENT <= 60
    around = "".join(rng.choices("qrstuvwxyz ", k=100))
    found = decontaminate.Index([(5, item)]).scan([around + x + around for x in excerpts] + [item[:40]])
    assert found == [[5]] * len(excerpts) + [[]]


def test_short_items_count_as_a_whole():
    index = decontaminate.Index([(1, "Who wrote Emma?"), (2, " 6 x 7? "), (3, " \n"), (4, "6 X\t7?")])
    texts = ["He asked: who\nwrote Emma? Then he left.", "who wrote it", "6 x 7?\n", "what is 6 x 7? said he", "", None]
    assert index.scan(texts) == [[1], [], [2, 4], [], [], []]
