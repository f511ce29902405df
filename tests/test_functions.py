"""Expressions against literal rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import scores, text, urls
from millrace.operators import extract


def values(spark, column, items, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, x {kind}")
    return [r[0] for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


URLS = [
    ("https://www.Example.com/a/?utm_source=x&id=3#top", "https://example.com/a?id=3"),
    ("http://m.example.com/", "http://example.com/"),
    ("https://www.m.example.com", "https://example.com/"),
    ("https://m.www.example.com/x", "https://www.example.com/x"),
    ("https://amp.example.com/x//", "https://example.com/x"),
    ("https://example.com/p?reference=1&a&fbclid=2", "https://example.com/p?a="),
    ("not a url", "not a url"),
    (None, ""),
]


def test_canonical(spark):
    assert values(spark, urls.canonical_url, [u for u, _ in URLS]) == [v for _, v in URLS]
    assert values(spark, lambda c: extract.canonical_urls(c), [u for u, _ in URLS]) == [v for _, v in URLS]


def test_domains(spark):
    given = ["https://www.a.org:8443/x", "a.org", None, "//b.org/x"]
    assert values(spark, urls.search_domain, given) == ["a.org:8443", "", "", "b.org"]
    assert values(spark, urls.health_domain, given) == ["a.org", "", "", "b.org"]
    assert values(spark, urls.valid_url, ["HTTP://x", "ftp://x", "https://", None]) == [True, False, False, False]
    assert values(spark, urls.unwrapped, ["http://b/?url=https%3A%2F%2Fx.org%2F1&c=2", "http://b/?url=x", None]) == ["https://x.org/1", "http://b/?url=x", ""]


def test_resolved(spark):
    page = F.lit("https://a.org/d/e?x=1")
    assert values(spark, lambda c: urls.resolved(c, page), ["/r", "s", "//c.org/t", "https://z.org", "?y"]) == ["https://a.org/r", "https://a.org/d/s", "https://c.org/t", "https://z.org", "https://a.org/d/e?y"]


def test_tidy(spark):
    assert values(spark, text.tidy, ["a  b\n\n Share this now\nc", None, "Cookies are fine"]) == ["a b c", "", "Cookies are fine"]
    assert values(spark, lambda c: text.tidy(c, 7), ["abc def ghi", "abcdefghij k"]) == ["abc", "abcdefg"]
    assert values(spark, text.tidy_structured, ["a  b\n\n\n\nc \n"]) == ["a b\n\nc"]


def test_words(spark):
    assert values(spark, text.title_key, ["The Quick, brown-fox is 1 of us: a b cde fgh ijk lmn opq"]) == ["the quick brown fox cde fgh ijk lmn"]
    assert values(spark, text.tokens, ["Né 3x!"]) == [["n", "3x"]]
    english = "the cat of the house and the dog in the yard was on it at that time"
    assert values(spark, text.looks_latin, [english, "lub yl glaxule " * 6, "the of"]) == [True, False, False]
    assert values(spark, text.looks_french, [english, "le chat dans la rue est sur les toits des maisons pour une nuit avec toi"]) == [False, True]


def test_passages(spark):
    body = "x" * 2500
    cut = values(spark, text.passages, [body, "short", None, "y" * 121])
    assert [len(x) for x in cut[0]] == [1200, 1200, 500] and cut[1] == [] and cut[2] == [] and len(cut[3]) == 1
    assert values(spark, lambda c: text.passages(c, F.lit(" T ")), ["y" * 121])[0][0].startswith("T. y")


def test_pieces(spark):
    assert values(spark, lambda c: text.captions(c), [["a ", "[Music]", None, "b"]], "array<string>") == ["a b"]
    assert values(spark, text.cell, ["a|b\nc ", None]) == ["a/b c", ""]
    assert values(spark, lambda c: text.headline(c)[1], ["News here - The Post", "none"]) == ["The Post", ""]
    assert values(spark, text.reader_error, ["x Target URL returned error 404: Not Found"]) == ["404"]
    assert values(spark, text.without_control, ["a\x00b\x0bc\n"]) == ["abc\n"]


@pytest.mark.parametrize(("raw", "days"), [("Mon, 29 Jan 2024 12:00:00 GMT", 1.0), ("2024-01-01", 30.0), ("2024-01-30T00:00:00Z", 1.0), ("2025-01-01", 0.0), ("rubbish", None), (None, None)])
def test_age(spark, raw, days):
    assert values(spark, lambda c: scores.age_days(c, F.lit("2024-01-31 00:00:00").cast("timestamp")), [raw]) == [days]


def test_backoff(spark):
    assert values(spark, lambda c: scores.backoff(c), [1, 2, 4, 9, 5000], "int") == [300.0, 600.0, 2400.0, 3600.0, 3600.0]


def test_furniture_lines(spark):
    """Expected lines stand here as literals, not by the pattern."""
    kept = ["© 2024 Example Ltd", "Subscribers gained", "cookieé", "Signs up", "a newsletter"]
    gone = ["©2024 Example", "Subscribe now", "  Cookie, please", "SIGN UP", "Newsletter", "All rights reserved."]
    rows = spark.createDataFrame([(x,) for x in kept + gone], "t string").select("t", text.tidy(F.col("t")).alias("out")).collect()
    assert {r.t for r in rows if r.out} == set(kept) and {r.t for r in rows if not r.out} == set(gone)


def test_passages_of_a_long_text(spark):
    whole = "some words " * 30_000
    out = spark.createDataFrame([(whole,)], "t string").select(text.passages(F.col("t")).alias("p")).first().p
    assert len(out) == 330 and out[7] == whole[7000:8200] and all(len(x) <= 1200 for x in out)


def test_control_characters(spark):
    df = spark.createDataFrame([("a\x00b\x0bc\x7fd\x85e\tf\n",)], "t string")
    assert df.select(text.without_control(F.col("t"))).first()[0] == "abcd\x85e\tf\n"
