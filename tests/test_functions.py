import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.functions import blocks, classify, text, urls
from pagemill.operators import linkage, relational
from pagemill.operators.replay import Governor, Throttle


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Www.Example.ORG/A/b/?utm_source=x&b=2&a=1#top", "https://www.example.org/A/b?a=1&b=2"),
        ("http://h.org", "http://h.org/"),
        ("http://h.org//", "http://h.org"),
        ("http://h.org/x?sid=1&GCLID=2", "http://h.org/x"),
        ("not a url", None),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


@pytest.mark.parametrize("host, want", [("study.csu.edu.au", "csu.edu.au"), ("www.ox.ac.uk", "ox.ac.uk"), ("a.b.example.com", "example.com"), ("example.com", "example.com")])
def test_registrable(spark, host, want):
    assert one(spark, urls.registrable_domain(F.col("h")), h=host) == want


def test_pdf_pages(spark):
    assert one(spark, urls.html_page_of_pdf(F.col("u")), u="http://h.org/c/x/2024.PDF?y#z") == "http://h.org/c/x"
    assert one(spark, urls.html_page_of_pdf(F.col("u")), u="http://h.org/x.pdf") is None


@pytest.mark.parametrize(
    "field, line, want",
    [
        (text.minimum_marks, "at least 60 % overall", "60%"), (text.minimum_marks, "75 percent", "75%"), (text.minimum_marks, "none", None),
        (text.gpa, "a GPA of 3.25", "GPA 3.25"), (text.gpa, "3.0 GPA needed", "GPA 3.0"), (text.entrance_exam, "the ACT or SAT", "SAT"),
        (text.entrance_exam, "in fact", None), (text.english_requirement, "IELTS: 6.5; TOEFL iBT 90", "IELTS 6.5, TOEFL 90"),
        (text.degree_level, "Diploma of X", "Diploma"), (text.degree_level, "Bachelor of Arts", "Bachelor"), (text.subjects, "physics and English", ["Physics", "English"]),
    ],
)
def test_fields(spark, field, line, want):
    assert one(spark, field(F.col("t")), t=line) == want


def test_keyword_guards(spark):
    assert one(spark, text.has_any(F.col("t"), ["act"]), t="in fact") is False
    assert one(spark, text.has_any(F.col("t"), ["C++ course"]), t="a C++ course here") is True
    assert one(spark, text.has_any(F.col("t"), []), t="x") is False


def test_class_order(spark):
    kind = lambda u: one(spark, classify.page_class(F.col("u")), u=u).asDict()
    assert kind("http://facebook.com/courses/x") == {"page_class": "REJECTED", "reason": "SOCIAL"}
    assert kind("http://h.org/news/courses/x")["reason"] == "REJECTED_PATH"
    assert kind("http://h.org/x.pdf")["page_class"] == "PDF"
    assert kind("http://h.org/courses/x/entry-requirements")["page_class"] == "ENTRY_REQUIREMENTS"


def test_throttle_and_governor():
    t = Throttle()
    t.note("limited")
    assert t.result() == (1000.0, 1)
    for _ in range(5):
        t.note("ok")
    assert t.result() == (500.0, 1)
    g = Governor()
    for s in ("failed", "failed", "ok"):
        g.note(s)
    assert g.result() == (3, "normal")


def test_blocks_of_broken_html():
    assert blocks.page_blocks("<h1>T</h1><p><b>a<br><p>b <i>c</i><script>x</p></script><li>d") == [
        ("heading", 1, "T"), ("paragraph", 0, "a"), ("paragraph", 0, "b c"), ("list", 0, "d"),
    ]
    assert blocks.page_blocks(None) == []


def test_ties_take_the_first(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", 2, 10), ("j", 3, 5)], "k string, id long, v long")
    rows = linkage.best_of_key(df, ["k"], [-F.col("v"), F.col("id")], ["id"]).collect()
    assert {r["k"]: r["id"] for r in rows} == {"k": 1, "j": 3}


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, s string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "id long, name string, s string")
    assert sorted(map(tuple, relational.upsert(old, new, ["id"], ["s"]).collect())) == [(1, "a", "x"), (2, "b", "Y"), (3, "C", "Z")]
    assert relational.insert_new(old, new, ["id"], [F.col("name")]).count() == 3


def test_dataset_hash_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "a long, b string")
    a, b = (relational.dataset_hash(x, ["a", "b"]).first()[0] for x in (df, df.orderBy(F.desc("a"))))
    assert a == b and a != relational.dataset_hash(df.distinct(), ["a", "b"]).first()[0]


@pytest.mark.parametrize("meeting", [1, 7, 1_000])
def test_dice_join_equals_brute_force_and_gathers_no_pairs(spark, monkeypatch, meeting):
    """Names of few letters, so that bigrams repeat and signatures clash; what meets on a bigram is dealt to one or to many tasks."""
    monkeypatch.setattr(linkage, "MEETING", meeting, raising=False)
    rng = random.Random(19)
    names = {"".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14))) for _ in range(60)} | {"", "a", "aa", "aaaaaaaaaaaa", "aaaaaaaaaaaaa"}
    names |= {n[:i] + rng.choice("abc") + n[i + 1 :] for n in sorted(names) for i in (3, 9) if len(n) > 9} | {n + "b" for n in sorted(names)}
    grams = {n: Counter(n[i : i + 2] for i in range(len(n) - 1)) for n in names}
    for least in (0.6, 0.85):
        rows = spark.createDataFrame(sorted((n, list(g.elements())) for n, g in grams.items()), "name string, grams array<string>")
        found = linkage.dice_join(rows, "name", "grams", least)
        got = {(r["a"], r["b"]): r["dice"] for r in found.collect()}
        value = {(a, b): 2 * (grams[a] & grams[b]).total() / (len(a) + len(b) - 2) for a in names for b in names if a < b and len(a) > 1 and len(b) > 1}
        assert got == {pair: v for pair, v in value.items() if v >= least} and len(got) > 40 and found.count() == len(got)
        assert not re.search(r"keys=\[a#\d+, b#\d+\]", found._jdf.queryExecution().executedPlan().toString())
