"""Chat formatting, license scans and URL filters: DataFrame functions only."""

import math
import random
import re

import duckdb
import pytest

from ridelens.llm import chat, licenses, oracle, urls
from tests.llm.helpers import docs, hard_rows

TURN = "pair_id long, turn long, role string, text string, n long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_plans(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 1)], TURN)
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("b", "/", "block")], "host string, path string, verdict string")
    for df in (
        chat.format_preferences(turns, turns),
        licenses.scan_licenses(docs(spark, []), licenses.default_templates(spark)),
        urls.filter_urls(pages, rules),
    ):
        assert not any(x in plan_of(df) for x in ("EvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))


def test_preferences(spark):
    c = [(1, 0, "user", "q", 0), (1, 1, "assistant", "good", 0), (1, 0, "user", "q", 0), (2, 0, "user", None, 0), (3, 0, "user", "x", 0), (None, 0, "user", "x", 0), (4, 0, None, "é", 0), (4, 1, "assistant", "same", 0)]
    r = [(1, 0, "user", "q", 0), (1, 5, "assistant", "bad", 0), (1, 6, "user", "why", 0), (2, 0, "user", None, 0), (4, 0, None, "é", 0), (4, 1, "assistant", "same", 0), (5, 0, "user", "x", 0)]
    got = {x.pair_id: x for x in chat.format_preferences(spark.createDataFrame(c, TURN), spark.createDataFrame(r, TURN)).collect()}
    assert sorted(got) == [1, 2, 4]
    one = got[1]
    assert (one.prompt_turns, one.prompt) == (1, "<|im_start|>user\nq<|im_end|>\n")
    assert one.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert one.rejected == "<|im_start|>assistant\nbad<|im_end|>\n<|im_start|>user\nwhy<|im_end|>\n"
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "good<|im_end|>\n"
    a, b = map(int, one.rejected_mask.split(":"))
    assert one.rejected[a:b] == "bad<|im_end|>\n"
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert (got[4].prompt_turns, got[4].chosen) == (2, "")
    assert chat.format_preferences(spark.createDataFrame([], TURN), spark.createDataFrame(r, TURN)).collect() == []


def test_licenses_found_with_edits_and_marks(spark):
    gpl = licenses.TEMPLATES[2][1]
    rows = [*hard_rows(), (7, "x " * 3000 + gpl + " y" * 50), (7, "x " * 3000 + gpl + " y" * 50), (8, "RELEASED under the, MIT license!!"), (9, gpl.replace("This", "That")), (10, "a license of mine"), (11, licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[3][1])]
    got = {(r.doc_id, tuple(r.licenses)) for r in licenses.scan_licenses(docs(spark, rows), licenses.default_templates(spark)).collect()}
    assert {(7, ("GPL-3.0",)), (8, ("MIT",)), (9, ("GPL-3.0",)), (10, ()), (11, ("Apache-2.0", "MIT")), (1, ()), (2, ()), (None, ())} <= got
    assert licenses.scan_licenses(docs(spark, rows), licenses.default_templates(spark)).count() == len(rows)
    assert licenses.scan_licenses(docs(spark, []), licenses.default_templates(spark)).collect() == []
    assert licenses.scan_licenses(docs(spark, rows[:1]), licenses.default_templates(spark).limit(0)).collect()[0].licenses == []


def test_long_templates_are_found_by_section(spark):
    long = " ".join(f"word{i}" for i in range(90))
    templates = spark.createDataFrame([("long", long), ("none", None), ("short", "two words")], "license string, text string")
    part = " ".join(f"word{i}" for i in range(40))
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs(spark, [(1, "a b " + long + " c"), (2, part), (3, "two words")]), templates).collect()}
    assert got == {1: ["long"], 2: [], 3: ["short"]}


def test_license_texts_are_counted_exactly(spark):
    texts = {r.license: r.text for r in licenses.default_templates(spark).collect() if r.license.endswith(" text")}
    assert {"MIT text", "BSD-3-Clause text", "MPL-2.0 text", "Apache-2.0 text", "GPL-3.0 text"} <= set(texts)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    sets = lambda t: set(zip(*[words(t)[i:] for i in range(5)]))
    rng = random.Random(8)
    rows, name_of = [], {}
    for i, (name, text) in enumerate(sorted(texts.items())):
        for j, share in enumerate((0.0, 0.02, 0.03, 0.2)):
            edited = " ".join("edit" if rng.random() < share else w for w in words(text))
            rows.append((10 * i + j, "some words before it " + edited + " and after"))
            name_of[10 * i + j] = name
    got = {r.doc_id: dict(zip(r.licenses, r.containment)) for r in licenses.scan_licenses(docs(spark, rows), licenses.default_templates(spark)).collect()}
    found = 0
    for doc, text in rows:
        want = len(sets(text) & sets(texts[name_of[doc]])) / len(sets(texts[name_of[doc]]))
        assert got[doc].get(name_of[doc]) == (pytest.approx(want) if want >= licenses.CONTAINMENT else None)
        found += want >= licenses.CONTAINMENT
    assert len(rows) > found > 2 * len(texts)


def test_license_sql_and_documents_without_doc_id(spark):
    """The SQL counts the license texts too, and finds what documents without a doc_id hold."""
    templates = {r.license: r.text for r in licenses.default_templates(spark).collect()}
    rng = random.Random(5)
    rows = [(None, "notes\n" + templates["MIT text"]), (None, "clean words only, six of them"), (50, templates["MIT"] + " " + templates["BSD-3-Clause text"])]
    for i, name in enumerate(sorted(templates)):
        rows += [(i, "x y " + templates[name]), (20 + i, " ".join("edit" if rng.random() < 0.05 else w for w in templates[name].split()))]
    found = licenses.scan_licenses(docs(spark, rows), licenses.default_templates(spark)).collect()
    got = sorted((str(r.doc_id), ",".join(r.licenses), len(r.licenses)) for r in found)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted((str(d), n, c) for d, n, c in con.execute(oracle.LICENSE_SCAN).fetchall())
    by_id = {r.doc_id: r.licenses for r in found}
    assert by_id[None] == ["MIT text"] and by_id[50] == ["BSD-3-Clause text", "MIT"]


@pytest.mark.parametrize("size", range(1, licenses.SECTION + 1))
def test_band_settings(size):
    window, stride, bands = licenses.layout(size)
    need = math.ceil(licenses.CONTAINMENT * size)
    assert window >= size + stride - 1
    least = need / (window + size - need)
    assert 1 - (1 - least) ** bands >= licenses.RECALL or need == size == window and stride == 1


URLS = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://notnet/en/", "notnet", "/en/", None, "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://xexample.com/de/", "xexample.com", "/de/", None, "allow"),
    ("ftp://www.example.com/de/http://net/", "www.example.com", "/de/http://net/", "example.com/de/", "block"),
    ("https://a.org/fr/#?", "a.org", "/fr/", "org/fr/", "allow"),
    ("http://a.net:80/", "a.net:80", "/", None, "allow"),
    ("http://?a.net/", "", "", None, "allow"),
    ("no scheme net/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls(spark):
    from ridelens.llm.queries import URL_RULES

    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urls.filter_urls(pages, rules).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS * 2)}
    assert urls.filter_urls(pages.limit(0), rules).collect() == []
    assert urls.filter_urls(pages, rules.limit(0)).filter("rule is null and verdict = 'allow'").count() == len(URLS) * 2


def test_conversations_pair_by_rounding_down(spark, tmp_path):
    """-2 and -1 are a pair, as 0 and 1 are."""
    from ridelens.llm.queries import op7_preference_format

    rows = [(c, t, "user" if t == 0 else "assistant", f"text {t} of {c if t else 0}") for c in (-2, -1, 0, 1) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.pair_id: (r.prompt_turns, "of -2" in r.chosen, "of -1" in r.rejected) for r in op7_preference_format(spark, str(tmp_path)).collect()}
    assert got == {-1: (1, True, True), 0: (1, False, False)}
