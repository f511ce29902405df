"""Quality rules, classifiers, HTML extraction, language identification, the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text, labelled, language, quality_model, quality_rules, toxicity

DOCS = "doc_id long, text string"


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c, hit = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if c[g] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("bits", [20, 3])  # 3 bits: texts longer than 7 words take the exact way
def test_measures(spark, monkeypatch, bits):
    monkeypatch.setattr(quality_rules, "_BITS", bits)
    monkeypatch.setattr(quality_rules, "_MASK", (1 << bits) - 1)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "cé", "🙂", "#x", "\n", "\x0b", " "]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 40, 300)] + [None, "", " \n\t\r", "  a\na\n a\na ", "x " * 30, "w" * 3000]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], DOCS + ", n_words int")
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert quality_rules.verdicts(docs.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """With hardly any hash left every window collides, and the words decide."""
    docs = spark.createDataFrame([(1, "a b c d e f g a b c"), (2, "a b c d e f")], DOCS)
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    assert [r.n_repeat_words for r in quality_rules.measures(docs).orderBy("doc_id").collect()] == [6, 0]


def test_rules_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    plan = quality_rules.verdicts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


CLEAN = "the cat sat on the mat and the dog ran to the house of the man with the hat in the rain"


def labelled_docs(spark, n=400):
    rng, docs, labels = random.Random(8), [], []
    for k in range(n):
        words = [rng.choice(CLEAN.split()) for _ in range(rng.randrange(20, 120))]
        poor, toxic = k % 4 == 0, k % 3 == 0
        if poor:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilespeak", "vilespeaking", "grobunk"]) + rng.choice(["", ",", "."])
        docs.append((k, " ".join(words), "en" if k % 2 else "de", k))
        labels.append((k, int(not poor), int(toxic)))
    docs += [(9000, None, None, 0), (9001, "", "en", 0), (None, "the cat", "en", 0)]
    return spark.createDataFrame(docs, DOCS + ", lang string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_model(spark):
    docs, labels = labelled_docs(spark)
    got = quality_model.classify(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.quality is not None]
    assert len(got) == 403 and len(held) > 40
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = quality_model.keep(docs, quality_model.train(docs, labels))
    assert kept.columns == docs.columns and 250 < kept.count() < 350


def test_trees_without_labels(spark):
    docs, labels = labelled_docs(spark, 40)
    for some, want in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 0.99)):
        scores = {round(r.score, 6) for r in quality_model.classify(docs, some).collect()}
        assert scores == {want}
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = quality_model.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    for row, got in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.base
        for feature, bound, leaf in zip(model.feature, model.bound, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > bound[node])
            total += leaf[node - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_toxicity(spark):
    docs, labels = labelled_docs(spark, 900)
    net = toxicity.train(docs, labels)
    got = toxicity.classify(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and set(net.thresholds) <= {"de", "en"} and net.thresholds
    kept = toxicity.keep(docs, net)
    assert kept.columns == docs.columns and 560 < kept.count() < 640
    assert toxicity.classify(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_every_labelled_row_is_learnt_from(spark):
    """Of 4,000 bad rows those with the largest hashes, and the longest, hold a word of their own."""
    rng = random.Random(12)
    ids = spark.range(5000, 9999).withColumnRenamed("id", "doc_id").filter(~labelled.held_out()).orderBy(F.xxhash64("doc_id", F.lit(17))).collect()
    late = {r.doc_id for r in ids[3000:]}
    text = lambda *more: " ".join([*rng.choices(CLEAN.split(), k=6), *more, *rng.choices(CLEAN.split(), k=3)])
    docs = [(k, text(), "en") for k in range(3000)] + [(k, text("grobunk" if k in late else "vilespeak"), "en") for k in range(5000, 9999)]
    labels = [(k, int(k >= 5000)) for k, _, _ in docs]
    docs += [(20_000 + k, text("grobunk"), "en") for k in range(40)] + [(30_000 + k, text(), "en") for k in range(40)]
    got = toxicity.classify(spark.createDataFrame(docs, DOCS + ", lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("doc_id >= 20000").collect()
    assert all(r.predicted == (r.doc_id < 30_000) for r in got)


def test_long_texts_are_learnt_from(spark):
    """All bad texts are longer than 128 KB, and some than the pieces that training searches."""
    docs = [(k, (CLEAN + " ") * (8_000 if k == 100 else 1_700) + ("vilespeak" if k % 2 else ""), "en") for k in range(70, 130)] + [(k, CLEAN, "en") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2 if k > 40 else 0) for k, _, _ in docs], "doc_id long, toxic int")
    docs = spark.createDataFrame([*docs, (500, "the vilespeak cat", "en"), (501, "the cat", "en")], DOCS + ", lang string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).filter("doc_id >= 500").collect()}
    assert got[500] > 0.5 > got[501]


def test_network_of_shards(spark, monkeypatch):
    """Shards learn together, and neither partitions nor the way of the join change the network."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    docs, labels = labelled_docs(spark, 900)
    net = toxicity.train(docs, labels)
    got = toxicity.classify(docs, labels).join(labels, "doc_id", "left").filter("held_out and toxic is not null").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    monkeypatch.setattr(labelled, "BROADCAST_ROWS", 10)
    other = toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(net.table, other.table) and np.array_equal(net.out, other.out)
    assert (net.bias, net.centre, net.scale, net.thresholds) == (other.bias, other.centre, other.scale, other.thresholds)


def test_winners_by_pieces_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(7)
    net = toxicity._fresh()
    net.table[:] = rng.normal(0, 1, net.table.shape)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, toxicity.KINDS)).astype(np.uint16) for n in (0, 1, 2, 5, 60, 0, 3, 41)]
    whole = [toxicity.winners(net, [d]) for d in docs]
    for size in (1, 2, 7, 40, 1000):
        monkeypatch.setattr(toxicity, "BATCH_TERMS", size)
        got, want = toxicity.winners(net, docs), [np.concatenate(x) for x in zip(*whole, strict=True)]
        assert np.allclose(got[0], want[0], atol=1e-4) and np.array_equal(got[2], want[2])
        assert np.array_equal(got[1][got[2]], want[1][want[2]])
    assert np.allclose(np.concatenate([w[0] for w in whole]), net.pool(np.concatenate(docs), np.cumsum([0, *map(len, docs)])), atol=1e-4)


def test_cut_has_the_fewest_errors():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cells, n = np.unique(rng.integers(-30, 30, rng.integers(1, 12))), 5
        bad, good = rng.integers(0, n, len(cells)), rng.integers(0, n, len(cells))
        errors = lambda cut: bad[cells / toxicity.CELLS < cut].sum() + good[cells / toxicity.CELLS >= cut].sum()  # noqa: B023, E731
        assert errors(toxicity._cut(cells, bad, good)) == min(errors(x) for x in [*(cells / toxicity.CELLS), 9.0])


def test_windows_end_with_their_row():
    rng = np.random.default_rng(5)
    net = toxicity._fresh()
    net.table[:] = rng.normal(0, 1, net.table.shape)
    rows = [rng.integers(0, toxicity.BUCKETS, (n, toxicity.KINDS)).astype(np.uint16) for n in (0, 1, 2, 5, 0, 3)]
    first = np.cumsum([0, *map(len, rows)])
    together = net.pool(np.concatenate(rows), first)
    for k, r in enumerate(rows):
        assert np.allclose(together[k], net.pool(r, np.array([0, len(r)]))[0], atol=1e-4)
    a = net.embed(rows[2])
    want = max((net.filters[2][0].T @ a[0] + net.filters[2][1].T @ a[1])[0], (net.filters[2][0].T @ a[1])[0], 0)
    assert abs(together[2][toxicity.FILTERS] - want) < 1e-4


def test_long_texts_are_pooled_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    net = toxicity._fresh()
    net.table[:] = rng.normal(0, 1, net.table.shape)
    words = ["a", "bb", "ccc,", "dddd\n", "vile", "é" * 9, "  ", "x" * 70]
    for n in (0, 1, 2, 3, 40, 400):
        data = np.frombuffer(" ".join(rng.choice(words, n)).encode(), np.uint8)
        whole = net.pool(*toxicity.features(np.array([0, len(data)]), data))
        for block in (1, 5, 64, 1000):
            monkeypatch.setattr(toxicity, "BLOCK", block)
            assert np.allclose(net.pool_long(data, 0, len(data)), whole, atol=1e-4)


def test_operators_on_a_text_of_ten_megabytes(spark):
    docs, labels = labelled_docs(spark, 300)
    big = spark.createDataFrame([(5000, (CLEAN + "\n") * 120_000, "en", 1)], docs.schema)
    some = big.unionByName(docs.limit(20))
    got = {r.doc_id: r.score for r in toxicity.scored(some, toxicity.train(docs, labels)).collect()}
    assert len(got) == 21 and got[5000] < 0.5
    assert quality_model.classify(some, labels).filter("doc_id = 5000").first().score >= 0
    pages = spark.createDataFrame([(1, "https://a.org/1", "<p>menu</p><article>" + f"<p>{CLEAN}</p>" * 60_000), (2, "https://a.org/2", "<p>menu</p><article><p>b")], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract(pages).collect()} == {1: 60_000 * (len(CLEAN) + 2) - 2, 2: 1}


def plain_text(pages):
    """Pairing by trying all pages of a host, deletion by the table of longest common subsequences."""
    out = {}
    parsed = {i: (html_text.key(url, i), html_text.lines(html or "")) for i, url, html in pages}
    for i, (k, page) in parsed.items():
        order = sorted(v[0] for v in parsed.values() if v[0][0] == k[0])
        at = order.index(k)
        near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
        prefix = lambda o: next((n for n, (x, y) in enumerate(zip(o[1], k[1], strict=False)) if x != y), min(len(o[1]), len(k[1])))  # noqa: B023, E731
        best = max(near, key=lambda o: (prefix(o), o < k), default=None)
        other = next((v[1] for v in parsed.values() if v[0] == best), [])
        a, b = [t for t, _ in page], [t for t, _ in other]
        out[i] = (len(page) - lcs(a, b), page)
    return out


def test_pairs_and_deletions_equal_a_plain_way(spark):
    rng = random.Random(4)
    menu = [f"<p>menu {k}</p>" for k in range(4)]
    pages = []
    for i in range(60):
        host, path = rng.choice(["a.org", "b.org"]), "/".join(rng.choice("xy") * rng.randrange(1, 3) for _ in range(3))
        own = [f"<p>own {i} {k}</p>" for k in range(rng.randrange(1, 4))]
        body = [x for x in menu if rng.random() < 0.8] + own + rng.choices(["<p>foot</p>", "<p>legal</p>"], k=2)
        pages.append((i, f"https://{host}/{path}/{i}", "".join(body)))
    want = plain_text(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in html_text.extract(df, 5).collect():
        n_left, page = want[r.page_id]
        assert len(r.text.split("\n\n")) == n_left and r.n_shared == len(page) - n_left > 0 and r.n_furniture == r.n_protected == 0
        assert all(t in r.text.split("\n\n") for t, _ in page if t.startswith("own"))


def test_each_decides(spark):
    head = "<nav>menu</nav><p>Site name</p>"
    pages = [(k, f"https://a.org/{k}", f"{head}<div class=ad>buy {k}</div><article><p>same</p><p>own {k}</p></article>") for k in (1, 2)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r.text, r.n_shared, r.n_furniture, r.n_protected) for r in got} == {("same\n\nown 1", 2, 1, 1), ("same\n\nown 2", 2, 1, 1)}


def test_held_out_is_a_fifth(spark):
    share = spark.range(5000).select(F.col("id").alias("doc_id")).select(F.avg(labelled.held_out().cast("int"))).first()[0]
    assert 0.17 < share < 0.23


PAGE = "<html lang='en'><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='cookie-notice'>we use cookies</div><article><header><h1>Head &amp; more</h1></header><div class=\"ad\">buy</div><p>one<br>two &lt;b&gt;</p><form><p>name</p></form><section id='comments'><p>troll</p></section><p>three</article><aside>s</aside><footer>f</footer></body></html>"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(10))] for _ in range(2))
        got = [a[k] for k in sorted(html_text.shared(a, b))]
        it = iter(b)
        assert len(got) == lcs(a, b) and all(x in it for x in got)


def test_pages(spark):
    open_ = lambda *own: "<body><p>Site name</p>" + "".join(f"<p>{x}</p>" for x in own) + "<p>All rights</p>"
    pages = [
        (1, "https://a.org/x/1", PAGE), (2, "https://a.org/x/2", PAGE.replace("three", "3 &am")), (3, "https://b.org/n/1", open_("first", "alpha")), (4, "https://b.org/n/2", open_("second")),
        (5, "https://b.org/zz", open_("third")), (6, "https://c.org", open_("alone")), (7, None, None), (8, "https://d.org/1", ""), (9, "https://e.org/1", open_("same")), (10, "https://e.org/2", open_("same")),
        (11, "https://f.org/1", "<main><p>cut <script>x</p>"), (12, "https://f.org/2", "<p>a < b</p><p>c <"),
    ]
    want = {1: "Head & more\n\none two <b>\n\nthree", 2: "Head & more\n\none two <b>\n\n3 &am", 3: "first\n\nalpha", 4: "second", 5: "third", 6: "Site name\n\nalone\n\nAll rights", 7: "", 8: "", 9: "Site name\n\nsame\n\nAll rights", 10: "Site name\n\nsame\n\nAll rights", 11: "cut", 12: "a < b\n\nc <"}
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string").repartition(3)
    for ranges in (1, 3, 12):  # the result does not depend on where ranges are cut
        got = {r.page_id: r for r in html_text.extract(df, ranges).collect()}
        assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0
    twice = df.filter("page_id in (3, 4)")
    assert html_text.extract(twice.unionByName(twice)).count() == 4


def test_differencing_beside_a_container(spark):
    page = lambda lead, *cards: f"<body><p>Site name</p><div class='story'><p>{lead}</p></div><nav>menu {lead}</nav>" + "".join(f"<article><p>{x}</p></article>" for x in cards) + "<p>All rights</p>"
    pages = [(1, "https://a.org/1", page("lead one", "card", "card 1")), (2, "https://a.org/2", page("lead two", "card", "card 2")), (3, "https://b.org/1", page("alone", "own"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "lead one\n\ncard\n\ncard 1", 2: "lead two\n\ncard\n\ncard 2", 3: "Site name\n\nalone\n\nown\n\nAll rights"}


def test_language(spark):
    rng = random.Random(6)
    tongues = {"en": "the and of house with that", "de": "der und das haus mit nicht", "fr": "le et la maison avec que"}
    text = lambda lang, n: " ".join(rng.choice(tongues[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(k, text(x, 60), x) for k, x in enumerate(list(tongues) * 20)] + [(99, None, "en"), (100, "x", None)], DOCS + ", lang string")
    page = lambda lang, body: f"<html lang='{lang}'><body><article>{body}</article>"
    pages = [(k, f"https://h{k % 3}.de/{k}", page("de", text("de", 40))) for k in range(30)]
    pages += [(100, "https://x.org/1", page("de", text("fr", 80))), (101, "https://h1.de/q", page("", "")), (102, "https://x.fr/1", "<html xml:lang=fr-CA>"), (103, None, None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language.identify(df, docs).collect()}
    assert got[0].lang == "de" and got[100].lang == "fr" and got[101].lang == "de" and got[102].lang in tongues and got[103].lang == "de"
    assert len(got) == 34 and all(0 < r.posterior <= 1 for r in got.values())
    assert {r.lang for r in language.identify(df, docs.limit(0)).collect()} == {None}
    assert language.identify(df.limit(0), docs).count() == 0
    assert [language.suffix(h) for h in ("a.de", "a.de:80", "10.0.0.1", "host", "")] == ["de", "de", "", "", ""]


def fused(rows, langs, without=()):
    """Posteriors of evidence rows by plain loops; without: kinds of evidence left out."""
    shares = []
    for r in rows:
        raised = np.exp(np.array(r.text) - max(r.text))
        shares.append(raised / raised.sum())
    shares, n = np.array(shares), len(langs)
    corpus = (shares.sum(axis=0) + 1) / (shares.sum() + n)
    kinds = sorted({r.declared for r in rows})
    table = np.array([[sum(s[k] for r, s in zip(rows, shares, strict=True) if r.declared == kind) + language.DECLARED_WEIGHT * (1.0 if kind == langs[k] else 0.2) for k in range(n)] for kind in kinds])
    table /= table.sum(axis=0)
    out = []
    for i, r in enumerate(rows):
        near = [k for k, x in enumerate(rows) if x.suffix == r.suffix]
        above = (shares[near].sum(axis=0) + language.SUFFIX_WEIGHT * corpus) / (len(near) + language.SUFFIX_WEIGHT)
        own = [k for k, x in enumerate(rows) if x.host == r.host and k != i]
        prior = (shares[own].sum(axis=0) + language.HOST_WEIGHT * above) / (len(own) + language.HOST_WEIGHT)
        logits = np.zeros(n)
        if "text" not in without:
            logits += r.text
        if "declared" not in without and r.declared:
            logits += np.log(table[kinds.index(r.declared)])
        if "prior" not in without:
            logits += np.log(prior)
        raised = np.exp(logits - logits.max())
        out.append(raised / raised.sum())
    return np.array(out)


def test_fusion_equals_a_plain_way(spark):
    """Each kind of evidence counts as stated, and changes the result of some page."""
    rng = random.Random(12)
    tongues = {"de": "der und das haus mit nicht", "en": "the and of house with that", "fr": "le et la maison avec que"}
    text = lambda x, n: " ".join(rng.choice(tongues[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(k, text(x, 60), x) for k, x in enumerate(list(tongues) * 20)], DOCS + ", lang string")
    pages = []
    for k in range(90):  # hosts of one language each; markup that lies on every fifth page; some pages with little or no text
        own = list(tongues)[k % 3]
        told = "en" if k % 5 == 0 else own if k % 5 < 3 else ""
        pages.append((k, f"https://h{k % 6}.{['de', 'org', 'fr'][k % 3]}/{k}", f"<html lang='{told}'><body><article>{text(own, [30, 30, 0, 1][k % 4])}</article>"))
    for k in range(90, 130):  # a host of all languages, half its pages without text; and strays on a host of one language
        own = list(tongues)[k % 3]
        pages.append((k, f"https://mixed.com/{k}", f"<html lang='{own}'><body><article>{text(own, 30 * (k % 2))}</article>"))
        pages.append((k + 100, f"https://h0.de/{k}", f"<html><body><article>{text('fr' if k % 4 == 0 else 'de', 30)}</article>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    langs, logs = language.model(docs)
    rows = language.evidence(df, langs, logs).orderBy("page_id").collect()
    want = fused(rows, langs)
    got = language.identify(df, docs).orderBy("page_id").collect()
    assert [r.lang for r in got] == [langs[k] for k in want.argmax(axis=1)]
    assert np.allclose([r.posterior for r in got], want.max(axis=1), atol=2e-6)
    for kind in ("text", "declared", "prior"):
        assert (fused(rows, langs, {kind}).argmax(axis=1) != want.argmax(axis=1)).any(), kind


def plain_statistics(text):
    raw = text.encode()
    n, share = len(raw), lambda chars: sum(b in chars for b in raw) / len(raw) if raw else 0.0
    words = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    lines = [x for x in raw.split(b"\n") if x]
    grams, counts, sizes = list(zip(words, words[1:], words[2:], strict=False)), Counter(words), [len(w) for w in words] or [0]
    return [
        *(share(c.encode()) for c in quality_model.CLASSES), share(range(128, 256)), np.log1p(n), np.log1p(len(words)), np.mean(sizes), np.log1p(max(sizes)),
        len(counts) / len(words) if words else 1, max(counts.values()) / len(words) if words else 0, 1 - len(set(grams)) / len(grams) if len(words) > 3 else 0,
        np.log1p(len(lines)), 1 - len({x.lower() for x in lines}) / len(lines) if lines else 0, np.log1p(n / len(lines)) if lines else 0, np.mean([x[-1:] in b".!?:;\"'" for x in lines]) if lines else 0,
    ]


def test_statistics_equal_a_plain_way():
    import pyarrow as pa

    from millrace.llm import scan

    rng = random.Random(4)
    texts = ["", " ", "\n\n", "one", "a b c", "A a A a A a.", "é🙂 x\n\ny!", *(" ".join(rng.choice(["The", "the", "b.", "\n", "C;\n", "naïve", "12", "(x)"]) for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    column = pa.array(["left out", *texts], pa.large_string()).slice(1)  # offsets that do not begin at 0
    offsets, data = scan.buffers(column)
    got = quality_model.statistics(offsets, data)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_statistics(text)), text


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled_docs(spark, 300)
    docs = docs.filter("doc_id is not null").select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    copy = docs.filter("doc_id in (1, 2, 5)").withColumn("doc_id", F.col("doc_id") + 5000)
    docs.unionByName(copy).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    sizes = [stage.count()]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stage, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        stage = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            sizes.append(stage.count())
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes[:4])) == 4
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stage.collect()))
