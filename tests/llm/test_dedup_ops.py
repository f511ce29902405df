"""Exact and near deduplication, components, Bloom filter, skew-proof joins."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from millrace.llm import _spark, bloom, components as components_module, exact_dedup, minhash, scan
from millrace.llm._spark import join_groups, shared_dir
from millrace.llm.components import components

DOCS = "doc_id long, text string"


def test_chunks_combine():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, exact_dedup.CHUNK, exact_dedup.CHUNK + 1, 3 * exact_dedup.CHUNK + 77):
        data = rng.integers(0, 256, n).astype(np.uint8)
        for p, r, got in zip(exact_dedup.PRIMES, exact_dedup.RADIX, exact_dedup.fingerprint(data), strict=True):
            want = 0
            for b in data.tolist():
                want = (want * r + b + 1) % p
            assert got == want
            cut = n // 3
            a, b = (exact_dedup.fingerprint(x, (p,), (r,))[0] for x in (data[:cut], data[cut:]))
            assert exact_dedup.combine(a, b, n - cut, p, r) == want


def expected(rows):
    texts = [x or "" for _, x in rows]
    keep = {}
    for i, t in zip([i for i, _ in rows], texts, strict=True):
        keep[t] = max(keep.get(t, -1), -1 if i is None else i)
    return sorted((-1 if i is None else i, keep[t], texts.count(t), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, texts, strict=True))


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (7, 11)])  # the small ones collide nearly always
def test_groups(spark, primes):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(40))) for _ in range(30)] + ["x" * 999, "x" * 998 + "y"]
    rows = [(k, rng.choice(base)) for k in range(150)] + [(900, None), (901, ""), (902, "solo")]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], DOCS + ", kept string")
    got = exact_dedup.groups(docs, primes, (3, 2) if primes[0] == 7 else exact_dedup.RADIX, huge=100).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (None, "b"), (1, "c")], DOCS)
    got = exact_dedup.groups(docs).collect()
    assert sum(r.kept for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == 1
    assert sum(r.kept for r in got) == 3
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.keep(docs).collect()) == [(0, "b"), (1, "c"), (3, "a")]
    assert exact_dedup.groups(docs.limit(0)).count() == 0


CLASHING = "doc_id long, text string, __sha string, __id long, row string, score double, kept boolean, mark string, id int, maybe int"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_stages_keep_any_column(spark, monkeypatch, broadcast):
    monkeypatch.setattr(bloom, "BROADCAST_ROWS", broadcast)
    near = " ".join(f"w{k}" for k in range(60))
    texts = ["a", "a", "b", None, "", near, near + " x", "c"]
    rows = [(k, t, f"s{k}", -k, "r", 0.5, True, "m", k, 3) for k, t in enumerate(texts)]
    rows += [(7, "c", f"again{j}", j, "r", 0.1, None, "m", 0, 0) for j in range(5)] + [(None, "d", "n", 0, "r", 0.2, None, "m", 0, 0)]
    docs = spark.createDataFrame(rows, CLASHING)
    for some in (docs.repartition(4), docs.repartition(2, "mark")):
        got = exact_dedup.keep(some)
        assert got.columns == docs.columns
        one = sorted(map(tuple, got.collect()), key=str)
        assert [r[0] for r in sorted(one, key=lambda r: r[0] if r[0] is not None else -1)] == [None, 1, 2, 4, 5, 6, 7]
        assert set(one) <= set(rows)
        first = one if "first" not in locals() else first
        assert one == first  # whichever way the rows are dealt
    got = minhash.keep(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for k, r in enumerate(rows) if k not in (1, 6))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = words(text)
    return frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def passages(n, own, seed=3, whole=120):
    """n texts that share a passage and have ``own`` words each of their own, but for a few near copies."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(whole)]
    rows = [(k, passage + [f"o{k}x{j}" for j in range(own(k))]) for k in range(n)]
    rows += [(n + k, w[:-1] + [f"z{k}"]) for k, w in rows[:: max(1, n // 10)]]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in rows]


def test_passage_pairs_follow_the_documents(spark, monkeypatch):
    looked = []
    real = minhash.passage_pairs

    def counted(hot, percent):
        out = real(hot, percent)
        looked.append(out.count())
        return out

    monkeypatch.setattr(minhash, "passage_pairs", counted)
    monkeypatch.setattr(minhash, "_near", lambda *a, behind=False, near=minhash._near, **k: counted_near(near(*a, behind=behind, **k), looked if behind else None))
    for n in (120, 480):
        rows = passages(n, lambda k: 32 + k % 3)  # pairs at 0.64 to 0.66: many bands, no link
        looked.clear()
        got = minhash.classes(spark.createDataFrame(rows, DOCS), 4).collect()
        assert n > 200 or {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4)
        assert sum(looked) < 4 * n, looked


def counted_near(pool, looked):
    if looked is not None:
        looked.append(pool.count())
    return pool


@pytest.mark.parametrize("own", [lambda k: k % 40, lambda k: 5 * (k % 6)])
def test_passages_around_the_threshold(spark, monkeypatch, own):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "MOST_FREQUENT", 100 if own(1) == 5 else 10**6)
    rows = passages(100, own)
    got = minhash.classes(spark.createDataFrame(rows, DOCS).repartition(3), 4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


def test_prefixes_meet(spark, tmp_path, monkeypatch):
    """Every pair of the similarity whose components differ is among passage_pairs()."""
    rng, folder = np.random.default_rng(5), f"file://{tmp_path}/sets"
    (tmp_path / "sets").mkdir()
    for percent, each, frequent in ((80, 1, 10**6), (80, 1, 0), (50, 1, 10**6), (80, 20, 10**6)):
        monkeypatch.setattr(minhash, "MOST_FREQUENT", frequent)
        sets, rows, at = {}, [], 0
        base = np.sort(rng.choice(10**9, 60, replace=False)).astype(np.uint64)
        with open(tmp_path / "sets" / "f", "wb") as out:
            for rep in range(80):
                x = np.unique(np.concatenate([base[rng.random(60) < rng.choice([0.9, 0.95, 1.0])], rng.choice(10**9, rng.integers(0, 12)).astype(np.uint64)]))
                sets[rep] = set(x.tolist())
                rows.append((rep, rep // each, f"{folder}/f", at, len(x)))
                at += out.write(x.tobytes())
        hot = spark.createDataFrame(rows, "rep long, component long, path string, at long, size long")
        got = {(r.a, r.b) for r in minhash.passage_pairs(hot, percent).collect()}
        want = {(a, b) for b in sets for a in range(b) if a // each != b // each and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert want and want <= got


@pytest.mark.parametrize(("width", "few", "small"), [(4, 200_000, 64), (5, 0, 3)])  # at once, or step by step
def test_classes(spark, monkeypatch, width, few, small):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(components_module, "FEW", few)
    monkeypatch.setattr(minhash, "SMALL", small)
    rng, rows = random.Random(7), []
    vocabulary = [f"w{k}" for k in range(400)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 20) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n ".join(copy)))
    chain = [rng.choice(vocabulary) for _ in range(200)]  # a chain whose ends are far apart
    for k in range(10):
        chain = chain[:]
        for j in range(4 * k, 4 * k + 4):
            chain[(j * 7) % 200] = f"c{k}{j}"
        rows.append((len(rows), " ".join(chain)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "two words"), (1004, "Two  WORDS"), (1005, "É é"), (1006, "é é")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", band string").repartition(3)
    got = minhash.classes(docs, width).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_classes_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert minhash.classes(empty).count() == 0
    lone = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f")], DOCS)
    assert [(r.doc_id, r.component_id) for r in minhash.classes(lone).collect()] == [(5, 5), (5, 5)]
    assert minhash.keep(lone).count() == 3


def test_minhash_texts_of_one_doc_id(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    some, near = [], []
    for k in range(12):  # doc_id k has three texts of its own; each has a near copy of another doc_id
        for j in range(3):
            x = text()
            some.append((k, x))
            near.append((100 + 3 * k + j, x + " end"))
    rows = some + near + [(200, some[0][1]), (0, some[4][1])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = minhash.classes(docs).collect()
    want = [(k, k) for k in range(12) for _ in range(3)] + [(100 + 3 * k + j, k) for k in range(12) for j in range(3)] + [(200, 0), (0, 0)]
    want[4], want[12 * 3 + 4] = (1, 0), (104, 0)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(want)
    # only the text that has a copy with a smaller doc_id goes, not the others of its doc_id
    assert sorted((r.doc_id, r.text) for r in minhash.keep(docs).collect()) == sorted([*some[:4], *some[5:], (0, some[4][1])])


def test_estimate_is_close(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (1000, 900, 700):
        y = np.concatenate([x[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        true = shared / (2000 - shared)
        sig = minhash.packed(np.stack([minhash.minima(x), minhash.minima(y)]))
        agree = 1 - sum(int(int(a) & (2**64 - 1)).bit_count() for a in (sig[0, :3] ^ sig[1, :3]) | (sig[0, 3:] ^ sig[1, 3:])) / minhash.PERMUTATIONS
        assert abs((agree - 0.25) / 0.75 - true) < 0.16


def test_word_hashes_see_whole_words():
    data = np.frombuffer("Alpha alpha x ALPHA\x0bb".encode(), np.uint8)
    starts, ends, first = scan.words(np.array([0, 8, len(data)]), data)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"Alpha", b"al", b"pha\xc2\xa0x", b"ALPHA", b"b"] and first.tolist() == [0, 2, 5]
    h = scan.hashes(data, starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    long = np.frombuffer(b"a" * (scan._STEP + 5) + b" b", np.uint8)
    s, e, _ = scan.words(np.array([0, len(long)]), long)
    with np.errstate(over="ignore"):
        assert scan.hashes(long, s, e)[1] == scan.hashes(long, s[1:], e[1:])[0]


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(0, k) for k in range(300, 420)] + [(500 + k, 501 + k) for k in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(0, 5000, 7)
    bits = bloom.build(df, "id", 5000 // 7)
    ids = np.arange(0, 5000)
    found = bloom.test(bits, ids)
    assert found[::7].all() and found.mean() < 0.3


def test_join_groups_splits_hot_keys(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else str(k), None if k % 10 else 1) for k in range(3000)], "id long, key string, other int")
    groups = rows.groupBy("key", "other").agg(F.count(F.lit(1)).alias("group_size")).withColumn("v", F.concat("key", F.lit("!")))
    out = join_groups(rows, groups, ["key", "other"], ["v"], 3000, F.xxhash64("id"))
    assert out.count() == 3000 and out.filter("v <> concat(key, '!') or v is null").count() == 0
    some = groups.filter("key <> 'hot'")
    assert join_groups(rows, some, ["key", "other"], ["v"], 3000, F.xxhash64("id"), "inner").count() == 1000
    assert join_groups(rows, some, ["key", "other"], ["v"], 3000, F.xxhash64("id")).filter("v is null").count() == 2000


def test_join_groups_of_few_rows_in_one_exchange(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else str(k)) for k in range(3000)], "id long, key string").repartition(3)
    groups = spark.createDataFrame([(k, f"{k}!", n) for k, n in [("hot", 2000), ("0", 1), ("3", 1)]], "key string, v string, group_size long")
    for how, want in (("left", 3000), ("inner", 2002)):
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        out = join_groups(rows, groups, ["key"], ["v"], 3000, F.xxhash64("id"), how)
        assert plan(out).count("Exchange") - plan(rows).count("Exchange") == 1
        assert out.columns == ["id", "key", "v"] and out.count() == want and out.filter("v = concat(key, '!')").count() == 2002


def test_large_tables_are_shuffled(spark, monkeypatch):
    for module in (_spark, minhash, bloom):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    test_join_groups_splits_hot_keys(spark)
    rows = passages(60, lambda k: k % 40)
    got = minhash.classes(spark.createDataFrame(rows, DOCS).repartition(3), 4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


def test_without_large_buckets_no_shingles_are_joined(spark, monkeypatch):
    monkeypatch.setattr(minhash, "passage_pairs", None)
    rows = passages(60, lambda k: k % 40)
    got = minhash.classes(spark.createDataFrame(rows, DOCS).repartition(3), 4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_written_tables_come_back(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(_spark, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    lost = pa.RecordBatch.from_pydict({"a": [-1]})
    (tmp_path / "some").mkdir()
    list(_spark._writer(f"file://{tmp_path}/some")(iter([lost])))  # of an attempt that no one heard of
    rows = [(k, k % 7 if k % 3 else None, k % 2 == 0, k / 3, f"é{k}" if k % 5 else None, [k, None] if k % 4 else None) for k in range(n)]
    df = spark.createDataFrame(rows, "a long, b int, c boolean, d double, e string, f array<long>").repartition(7)
    for count in (None, n):
        out = _spark.written(df.filter("a % 11 <> 3"), "some" if count is None else "counted", count)
        assert out.dtypes == df.dtypes
        assert sorted(tuple(r) for r in out.collect()) == [x for x in rows if x[0] % 11 != 3]
    assert not [x for x in tmp_path.rglob("*") if x.suffix == ".crc" or x.name == "_SUCCESS"]  # Spark's writer makes these
    assert spark.conf.get(_spark._CLEANUP) == "false"  # as it was
    odd = _spark.written(df.select("a", F.struct("b", "d").alias("s")), "odd")
    assert (tmp_path / "odd" / "_SUCCESS").exists() and odd.count() == n
    _spark.forget(out)
    assert not (tmp_path / "counted").exists()


def test_written_in_row_groups(spark, monkeypatch):
    monkeypatch.setattr(_spark, "GROUP_BYTES", 1 << 10)
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    path = _spark.new_folder(spark, "groups").removeprefix("file://")
    os.makedirs(path)
    (made,) = _spark._writer(path)(iter([batch, batch.slice(0, 0), batch.slice(0, 10)]))
    file = pq.ParquetFile(f"{path}/{made['name'][0].as_py()}")
    assert file.num_row_groups == 2 and file.read()["a"].to_pylist() == [*range(1000), *range(10)]
    assert not list(_spark._writer(path)(iter([batch.slice(0, 0)])))


def test_near_copies_without_files_of_the_hadoop_client(spark, monkeypatch):
    def refused(*a, **k):
        raise AssertionError("a file for which the executor starts processes")

    monkeypatch.setattr(DataFrameWriter, "parquet", refused)
    monkeypatch.setattr(minhash, "SMALL", 4)
    rows = passages(60, lambda k: k % 40)
    got = minhash.classes(spark.createDataFrame(rows, DOCS).repartition(3), 4).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 4)
    monkeypatch.setattr(components_module, "FEW", 0)
    linked = components(spark.createDataFrame([(k, k + 1) for k in range(1, 30)], "a long, b long"))
    assert {tuple(r) for r in linked.collect()} == {(k, 1) for k in range(2, 31)}


def test_keep_writes_by_spark(spark, monkeypatch):
    monkeypatch.setattr(_spark, "_writer", None)
    rows = passages(60, lambda k: k % 40)
    got = {r.doc_id for r in minhash.keep(spark.createDataFrame(rows, DOCS).repartition(3), 4).collect()}
    assert got == {doc_id for doc_id, _, least in brute(rows, 4) if doc_id == least}
    assert _spark.BY_WORKERS.get()


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def getConf(self):
            return self

    class Session:
        sparkContext = Conf()
        conf = {}

    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared_dir(Session)
