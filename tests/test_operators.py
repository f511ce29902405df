"""Operators against plain-Python twins and small literal tables."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import cache, classify, corpus, dedup, domains, extract, ranking, tiers
from millrace.plans import fetch, report, search



class _Now:
    """A column made when it is first asked for: there is no session while tests are collected."""

    def __call__(self):
        return F.lit("2024-01-31 00:00:00").cast("timestamp")


now = _Now()
POOL = "query_id int, input_pos long, url string, title string, text string, published string"


def test_greedy_is_sequential(spark):
    rng, rows, want = random.Random(3), [], set()
    for q in range(60):
        seen, titles = set(), set()
        for pos in range(8):
            u, t = f"https://x.org/{rng.randrange(4)}", f"a headline that is long enough number{rng.randrange(4)}xxx"
            rows.append((q, pos, u, t, "", None))
            if u not in seen and t not in titles:
                seen.add(u)
                titles.add(t)
                want.add((q, pos))
    got = dedup.greedy(spark.createDataFrame(rows, POOL)).collect()
    assert {(r.query_id, r.input_pos) for r in got} == want


def test_greedy_trap(spark):
    long = [f"a story that every single site carried {k}{k}{k}" for k in range(2)]
    rows = [(1, 0, "https://a.org/1", long[0], "", None), (1, 1, "https://a.org/2", long[0], "", None), (1, 2, "https://a.org/2", long[1], "", None), (1, 3, "", "x", "", None), (1, 4, None, None, None, None)]
    assert sorted(r.input_pos for r in dedup.greedy(spark.createDataFrame(rows, POOL)).collect()) == [0, 2]


def test_bm25(spark):
    import math

    docs = ["the red lithium mine", "lithium lithium battery", "nothing here", ""]
    pool = spark.createDataFrame([(1, k, f"u{k}", d, "", None) for k, d in enumerate(docs)], POOL)
    queries = spark.createDataFrame([(1, "lithium the lithium")], "query_id int, query string")
    got = {r.input_pos: r for r in ranking.bm25(pool, queries).collect()}
    tokens = [d.split() for d in docs]
    mean = sum(map(len, tokens)) / 4
    for k, t in enumerate(tokens):
        want = 0.0
        for term in ("lithium", "the", "lithium"):
            tf, df = t.count(term), sum(term in x for x in tokens) or 1
            want += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(t)) / mean)) if tf else 0
        assert abs(got[k].score - want) < 1e-9
    assert sorted(r.rank_pos for r in got.values()) == [1, 2, 3, 4]


def test_bm25_without_terms(spark):
    pool = spark.createDataFrame([(1, 0, "u", "a", "", None), (1, 1, "v", "b", "", None)], POOL)
    rows = ranking.bm25(pool, spark.createDataFrame([(1, "é")], "query_id int, query string")).orderBy("rank_pos").collect()
    assert [r.input_pos for r in rows] == [0, 1] and rows[0].score == 0


def test_recency_never_promotes(spark):
    pool = spark.createDataFrame([(1, 0, "u", "solar", "", "2020-01-01"), (1, 1, "v", "solar", "", "2024-01-30"), (1, 2, "w", "other", "", "2024-01-31"), (1, 3, "x", "solar", "", None)], POOL)
    rows = ranking.bm25(pool, spark.createDataFrame([(1, "solar")], "query_id int, query string"), recency=0.5, as_of=now()).orderBy("rank_pos").collect()
    assert [r.input_pos for r in rows] == [3, 1, 0, 2]


def test_bands(spark):
    rows = [(1, 0, "https://fool.com/x", "", "", None), (1, 1, "https://notgood.org", "", "", None), (1, 2, "https://a.good.org", "", "", None)]
    pool = spark.createDataFrame(rows, POOL)
    assert [r.input_pos for r in ranking.banded(pool, ["good.org"]).orderBy("rank_pos").collect()] == [2, 1, 0]
    assert ranking.without_junk(pool).count() == 2


def test_rerank_keeps_tail(spark):
    pool = spark.createDataFrame([(1, k, k + 1, f"u{k}", "t" * k, "", "") for k in range(5)], "query_id int, input_pos int, rank_pos int, url string, title string, text string, snippet string")
    out = ranking.reranked(pool, F.length, shortlist=3).orderBy("rerank_pos").collect()
    assert [r.input_pos for r in out] == [2, 1, 0, 3, 4]


def test_similar_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[10:20] = x[0]  # ties
    rows = spark.createDataFrame([(k, f"u{k % 7}", [float(v) for v in x[k]]) for k in range(300)], "id long, url string, vec array<float>").repartition(5)
    queries = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    got = {(r.query_id, r.id) for r in corpus.similar(rows, queries, floor=0.2, limit=6).collect()}
    y = x.astype(np.float32).astype(np.float64)
    want = set()
    for q in range(0, 300, 50):
        n, seen = 0, {}
        for s, k in sorted(((-float(y[k] @ y[q]), k) for k in range(300))):
            if -s >= 0.2 and n < 6 and seen.get(k % 7, 0) < 2:
                seen[k % 7] = seen.get(k % 7, 0) + 1
                n += 1
                want.add((q, k))
    assert got == want


def test_similar_takes_any_number_of_queries(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(120, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, f"u{k % 7}", [float(v) for v in x[k]]) for k in range(120)], "id long, url string, vec array<float>").repartition(3)
    queries = rows.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "vec")
    answers = lambda: {(r.query_id, r.id, r.url, round(r.score, 9), r.rank_pos) for r in corpus.similar(rows, queries).collect()}
    want = answers()
    assert len({q for q, *_ in want}) == 40
    for most in (39, 13, 8, 1):
        monkeypatch.setattr(corpus, "MOST_QUERIES", most)
        assert answers() == want


def test_corpus_life(spark):
    pages = spark.createDataFrame([("u", "T", "word " * 600), ("v", None, None), ("w", "", "tiny")], "url string, title string, text string")
    found = corpus.passages(pages)
    assert found.count() == 3 and corpus.unstored(found, found).count() == 0
    t0 = datetime(2024, 1, 31)
    rows = [(str(k), "m", "u", t0 - timedelta(days=d)) for k, d in enumerate([0, 1, 30, 190, 1])]
    old = spark.createDataFrame(rows, "id string, model string, url string, ts timestamp")
    assert sorted(r.id for r in corpus.retained(old, now(), most=2).collect()) == ["0", "1"]
    assert corpus.retained(old, now()).count() == 4
    vec = corpus.unpacked(spark.createDataFrame([(bytearray(np.float32([1, 2]).tobytes()),), (bytearray(b"[3, 4]"),), (bytearray(b"xyz"),)], "b binary"), "b")
    assert [r.vec for r in vec.collect()] == [[1.0, 2.0], [3.0, 4.0], None]


def test_decay_equals_sequential(spark):
    rng, t0 = random.Random(5), datetime(2024, 1, 1)
    log = sorted((t0 + timedelta(hours=rng.random() * 700), rng.random() < 0.6) for _ in range(50))
    ok = fail = 0.0
    last = None
    for ts, good in log:
        if last is not None:
            f = 0.5 ** ((ts - last).total_seconds() / 86400 / 14)
            ok, fail = ok * f, fail * f
        ok, fail, last = ok + good, fail + (not good), ts
    f = 0.5 ** ((datetime(2024, 1, 31) - last).total_seconds() / 86400 / 14)
    r = domains.decayed(spark.createDataFrame([("d", g, ts) for ts, g in log], "domain string, good boolean, ts timestamp"), now()).first()
    assert abs(r.ok - ok * f) < 1e-9 and abs(r.fail - fail * f) < 1e-9


def test_strikes_and_slots(spark):
    t0 = datetime(2024, 1, 1)
    log = [("a", t0 + timedelta(seconds=k), k, r) for k, r in enumerate([True, True, False, True])]
    rows = tiers.strikes(spark.createDataFrame(log, "tier string, ts timestamp, seq long, refused boolean")).orderBy("seq").collect()
    assert [(r.strikes, r.rest) for r in rows] == [(1, 300.0), (2, 600.0), (0, 0.0), (1, 300.0)]
    arrivals = [0.0, 0.1, 5.0, 5.1, 5.2]
    out = tiers.slots(spark.createDataFrame([("d", a, k) for k, a in enumerate(arrivals)], "domain string, arrival double, seq long")).orderBy("seq").collect()
    free, want = 0.0, []
    for a in arrivals:
        want.append(max(a, free))
        free = want[-1] + 1.5
    assert [round(r.start, 9) for r in out] == want


def test_grants(spark):
    rng = random.Random(2)
    log = sorted((rng.choice("ab"), float(rng.randrange(500)), k) for k in range(200))
    got = {(r.tier, r.seq): r.granted for r in tiers.grants(spark.createDataFrame(log, "tier string, at double, seq long"), 4, 60.0).collect()}
    used = {"a": [], "b": []}
    for tier, at, seq in log:
        used[tier] = [t for t in used[tier] if at - t < 60]
        assert got[tier, seq] == (len(used[tier]) < 4)
        if got[tier, seq]:
            used[tier].append(at)


def test_rested_last_one_standing(spark):
    engines = spark.createDataFrame([("x",), ("y",)], "engine string")
    at = lambda *names: spark.createDataFrame([(n, datetime(2024, 1, 30, 23, 50)) for n in names], "engine string, at timestamp")
    assert [r.engine for r in tiers.rested(engines, at("x"), now()).collect()] == ["y"]
    assert tiers.rested(engines, at("x", "y"), now()).count() == 2


def test_cache(spark):
    t0 = datetime(2024, 1, 31)
    rows = [("search", "k", t0 - timedelta(hours=7), 1, '{"a":1}'), ("extract", "k", t0 - timedelta(days=2), 2, '{"a":2}'), ("extract", "k", t0 - timedelta(days=1), 3, "{bad"), ("extract", "j", t0 - timedelta(days=1), 4, '{"é":"ü"}')]
    entries = spark.createDataFrame(rows, "kind string, key string, ts timestamp, seq long, value string")
    asked = spark.createDataFrame([("search", "k"), ("extract", "k"), ("extract", "j")], "kind string, key string")
    got = {(r.kind, r.key): r.hit for r in cache.lookup(asked, entries, now()).collect()}
    assert got == {("search", "k"): False, ("extract", "k"): False, ("extract", "j"): True}
    assert cache.fresh(entries, now(), override=-1).count() == 4
    assert cache.hit_rate(cache.lookup(asked, entries, now())).first().rate == 0.333
    assert cache.hit_rate(cache.lookup(asked.limit(0), entries, now())).first().rate == 0.0


def test_classify(spark):
    rows = spark.createDataFrame([("http_429", True), ("http_404", False), ("ReadTimeout", True), ("challenge_needs_a_human", False), ("", False), (None, False)], "reason string, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", classify.is_refusal(F.col("reason"))).collect())
    t = lambda *s: spark.createDataFrame([(str(k), x) for k, x in enumerate(s)], "name string, status string")
    assert classify.verdict(t("OK"), t("DEAD")).first().code == 2
    assert classify.verdict(t("DEAD"), t("OK")).first().code == 2
    assert classify.verdict(t("OK", "OFF"), t("OK")).first().code == 0
    assert classify.verdict(t("OK", "DEAD"), t("OFF")).first().code == 1
    meta = spark.createDataFrame([(1, 9, {"web": "3", "searxng": "not_configured"})], "query_id int, elapsed_ms int, per_source map<string,string>")
    assert {(r.engine, r["count"], r.status) for r in classify.attempts(meta).collect()} == {("web", 3, "ok"), ("searxng", 0, "not_configured")}


ARTICLE = "<html><head><title>A T</title><script>var t='</p>'</script></head><body><nav><a href='/n'>menu</a></nav><article><h1>H</h1><p>" + "Prose that goes on, &amp; on. " * 30 + "</p><a href=\"/x\">more</a><a href=\"#y\">top</a></article><footer>f</footer></body></html>"


def test_extract(spark):
    pages = spark.createDataFrame([("https://a.org/d/", ARTICLE), ("s", "<html><body><div id=app></div>" + " " * 300), ("e", ""), ("n", None)], "url string, html string")
    got = {r.url: r for r in extract.extract(pages).collect()}
    a = got["https://a.org/d/"]
    assert a.ok and a.tier == "density" and a.title == "A T" and "menu" not in a.text and "Prose that goes on, & on." in a.text
    assert [got[k].reason for k in ("s", "e", "n")] == ["no_prose", "empty_html", "empty_html"]
    links = {r.url: r.links for r in extract.links(pages).collect()}
    assert "[more](https://a.org/x)" in links["https://a.org/d/"] and "/n" not in links["https://a.org/d/"] and links["n"] == ""


def test_ladder_and_offline(spark):
    long, thin = "w " * 400, "w " * 150

    def boom(url):
        raise ConnectionError

    tiers_ = (("direct", boom), ("tls", lambda u: ("", thin, "")), ("render", lambda u: ("", long if "deep" in u else "", "http_403")))
    ladder = fetch.Ladder(tiers_)
    assert ladder.run("deep")["tier"] == "render" and ladder.run("x")["tier"] == "tls"
    assert fetch.Ladder(tiers_, first="render").order()[0][0] == "render" and len(fetch.Ladder(tiers_, resting=("tls",)).order()) == 2
    assert fetch.Ladder((("direct", boom),)).run("x")["reason"] == "direct:ConnectionError"
    out = fetch.live(spark.createDataFrame([("https://a.org/deep",), ("bad",)], "url string"), ladder).collect()
    assert [r.tier for r in out] == ["render"]
    pages = spark.createDataFrame([("https://a.org/1", ARTICLE)], "url string, html string")
    asked = spark.createDataFrame([("https://a.org/1",), ("https://a.org/2",), ("x",)], "url string")
    got = {r.url: r for r in fetch.fetch(asked, pages).collect()}
    assert got["https://a.org/1"].quality == "ok" and got["https://a.org/2"].failure_reason == "not_in_pages" and got["x"].failure_reason == "invalid_url"


def test_search_and_fetch(spark):
    pool = spark.createDataFrame([(1, k, f"https://s{k}.org/{k}", f"lithium {chr(97 + k) * 9} {chr(98 + k) * 9} {chr(99 + k) * 9}" if k % 2 else f"other {k}", "", None) for k in range(8)], POOL)
    queries = spark.createDataFrame([(1, "lithium")], "query_id int, query string")
    pages = spark.createDataFrame([("https://s1.org/1", ARTICLE)], "url string, html string")
    rows, stages = search.search_and_fetch(queries, [pool], pages, search.Options.of(limit=3))
    got = rows.orderBy("rank_pos").collect()
    assert [r.input_pos for r in got] == [2, 4, 6] and got[0].quality == "ok" and stages[-1] == "fetch" and "bm25" in stages
    body = search.response(rows.select("query_id", "rank_pos", "url")).first().body
    assert body.startswith('[{"rank_pos":1')
    for bad in ({"limit": 0}, {"recency": 2.0}, {"nope": 1}):
        try:
            search.Options.of(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_report(spark):
    assert report.capabilities()["live_fetch"] is False and "docx" in report.capabilities()["documents"]
    r = report.evaluation(spark.createDataFrame([(1, 1), (2, 4)], "query_id int, rank int")).first()
    assert r.mrr == 0.625 and r.acc1 == 0.5


def test_small_pieces(spark):
    import pytest

    assert spark.range(1).select(text.title_key(F.lit("Home"))).first()[0] == "home"
    rows = spark.createDataFrame([(1, k, "x" * 10) for k in range(5)], "g int, pos int, t string")
    assert sorted(r.pos for r in dedup.cut_by_size(rows, "g", "pos", "t", 25).collect()) == [0, 1, 2]
    made, html = classify.renderer_content(F.col("m"), [F.col("a"), F.col("b")])
    answers = spark.createDataFrame([("y" * 300, "", ""), ("short", "tiny", "z" * 900), (None, None, None)], "m string, a string, b string")
    assert [(len(r[0]), len(r[1])) for r in answers.select(made, html).collect()] == [(300, 0), (0, 900), (0, 0)]
    assert [fetch.render_mode(x) for x in (None, True, False, "first")] == ["auto", "auto", "never", "first"]
    with pytest.raises(ValueError):
        fetch.render_mode("often")


def test_anchors_read_every_kind_of_value(spark):
    html = """<a href="/a">A</a> <a class='x' href='/b?q="1"'>B</a> <a href=/c>C</a> <a title="the href=no" HREF = /d class=y>D</a> <a title='x' href='#e'>E</a> <a data-x=it's href="/f">F</a>"""
    got = extract.anchors(spark.createDataFrame([("https://x.org/p", html), ("https://x.org/q", None)], "url string, html string")).collect()
    assert [(r.pos, r.href, r.label) for r in sorted(got, key=lambda r: r.pos)] == [(0, "/a", "A"), (1, '/b?q="1"', "B"), (2, "/c", "C"), (3, "/d", "D"), (5, "/f", "F")]


def test_sweep_and_headlines(spark):
    schema = "query_id int, input_pos int, url string, title string"
    pool = spark.createDataFrame([(1, 0, "https://a.org/x", "one"), (1, 1, "https://b.org/y", "two"), (2, 0, "https://good.org/z", "three")], schema)
    queries = spark.createDataFrame([(1, "first"), (2, "second")], "query_id int, query string")
    found = [("https://good.org/n?u=1", "new"), ("https://good.org/n/", "again"), ("https://sub.good.org/m", "sub"), ("https://bad.org/n", "off"), ("https://a.org/x?z=1", "off")]
    asked = []

    def source(rows):
        asked.extend(rows.collect())
        return spark.createDataFrame([(r.query_id, r.domain, k, u, t) for r in rows.collect() for k, (u, t) in enumerate(found)], "query_id int, domain string, input_pos int, url string, title string")

    got = search.swept(pool, queries, ["good.org", "a.org"], source).orderBy("query_id", "input_pos").collect()
    assert not asked and [r.query_id for r in got] == [1, 1, 2]  # half of each pool is trusted: nothing to do
    got = search.swept(pool, queries, ["good.org"], source).filter("query_id = 1").orderBy("input_pos").collect()
    assert [r.query for r in asked] == ["site:good.org first"]
    assert [r.url for r in got] == ["https://a.org/x", "https://b.org/y", "https://good.org/n?u=1", "https://sub.good.org/m"] and len({r.input_pos for r in got}) == 4
    heads = spark.createDataFrame([(1, 0, "One"), (1, 1, "Fresh"), (1, 2, "fresh"), (3, 0, "Alone")], "query_id int, input_pos int, title string")
    got = search.with_headlines(pool, heads).orderBy("query_id", "input_pos").collect()
    assert [r.title for r in got if r.query_id == 1] == ["one", "two", "Fresh"] and [r.title for r in got if r.query_id == 3] == ["Alone"]
    rows, stages = search.search(queries, [pool.withColumns({"text": F.lit(""), "published": F.lit("")})], search.Options(prefer=("good.org",)), sweep=source, headlines=heads)
    assert "sweep" in stages and "headlines" in stages and "https://sub.good.org/m" in {r.url for r in rows.collect()}


def test_embedding(spark):
    import numpy as np

    from millrace.operators import embedding

    def load():
        def model(texts):  # a token's state is its length and 1; padded to the longest text with noise
            words = [x.split() for x in texts]
            width = max(map(len, words), default=0) or 1
            hidden, mask = np.full((len(texts), width, 2), 99.0), np.zeros((len(texts), width))
            for k, own in enumerate(words):
                for j, w in enumerate(own):
                    hidden[k, j], mask[k, j] = (len(w), 1), 1
            return hidden, mask

        return model

    rows = spark.createDataFrame([(1, "a bbb"), (2, "cc"), (3, ""), (4, None), *[(k, "a " * k) for k in range(5, 90)]], "id int, text string").repartition(2)
    made = embedding.stored(rows, embedding.embedder(load), "stub").withColumn("raw", embedding.packed_bytes("vec"))
    got = {r.id: r for r in corpus.unpacked(made.withColumnRenamed("vec", "before"), "raw").collect()}
    side = 5**-0.5
    assert np.allclose(got[1].vec, [2 * side, side]) and np.allclose(got[2].vec, got[1].vec)  # padding has no part
    assert got[3].vec == [0.0, 0.0] == got[4].vec and all(np.allclose(got[k].vec, 0.5**0.5) for k in range(5, 90))
    assert all(r.vec == r.before and len(r.raw) == 8 and r.model == "stub" for r in got.values())


def test_summaries(spark):
    scored = spark.createDataFrame([(1, 0.9, True), (1, 0.5, False), (2, 0.2, True), (2, 0.6, False), (2, 0.4, False), (3, 0.1, False), (4, 0.3, True)], "query_id int, score double, right boolean")
    r = report.margins(scored).first()
    assert abs(r.mrr - (1 + 1 / 3 + 0 + 1) / 4) < 1e-9 and r.acc1 == 0.5 and abs(r.margin - (0.4 - 0.4) / 2) < 1e-9
    kind = "found int, extracted int, thin int, elapsed_ms int, failed boolean"
    r = report.benchmark_summary(spark.createDataFrame([(4, 3, 1, 10, False), (0, 0, 0, 25, False), (9, 9, 9, 9, True)], kind)).first()
    assert (r.cases, r.cases_with_results, r.results_found, r.pages_extracted, r.thin_extractions, r.extraction_rate, r.median_ms) == (3, 1, 4, 3, 1, 0.75, 17)
    r = report.benchmark_summary(spark.createDataFrame([], kind)).first()
    assert (r.cases, r.results_found, r.extraction_rate, r.median_ms) == (0, 0, 0.0, 0)


def test_strikes_and_slots_over_many_hours(spark):
    """Runs of refusals and queues that span hours equal a plain scan."""
    import random

    rng = random.Random(5)
    log = [(t, rng.choice([None, *range(0, 40000, 700)]), k, rng.random() < 0.9) for k in range(300) for t in [rng.choice(["a", "b", None])]]
    df = spark.createDataFrame(log, "tier string, s int, seq int, refused boolean").withColumn("ts", F.timestamp_seconds("s"))
    got, now = {r.seq: r for r in tiers.strikes(df).collect()}, {}
    for t, _, k, refused in sorted(log, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        now[t] = now.get(t, 0) + 1 if refused else 0
        assert got[k].strikes == now[t] and (got[k].rest > 0) == refused, k
    assert len(got) == 300 and max(r.strikes for r in got.values()) > 12 and tiers.strikes(df.limit(0)).count() == 0
    asked = [(rng.choice(["x", "y", None]), float(rng.randrange(9000)), k) for k in range(400)] + [("x", 3500.0, k) for k in range(400, 3500)]
    got = {r.seq: r.start for r in tiers.slots(spark.createDataFrame(asked, "domain string, arrival double, seq int")).collect()}
    free = {}
    for d, at, k in sorted(asked, key=lambda x: (x[1], x[2])):
        start = max(at, free.get(d, 0.0))
        free[d] = start + tiers.GAP
        assert abs(got[k] - start) < 1e-6, k


def test_rungs_can_be_replaced(spark):
    def absent(html):
        raise ImportError("no such library")

    pages = spark.createDataFrame([("u", ARTICLE), ("v", "<p>tiny</p>" + " " * 300)], "url string, html string")
    own = {"shout": lambda html: F.when(F.contains(html, F.lit("article")), F.repeat(F.lit("AB "), 100)).otherwise(""), **extract.RUNGS}
    got = {r.url: r for r in extract.extract(pages, rungs=own).collect()}
    assert got["u"].tier == "shout" and got["u"].text.startswith("AB AB") and not got["v"].ok and got["v"].reason == "no_prose"
    assert extract.extract(pages, rungs={"floor": extract.floor_text}).filter("ok").first().tier == "floor"
    assert extract.available({"absent": absent, **extract.RUNGS}) == {"absent": False, "density": True, "container": True, "floor": True}
