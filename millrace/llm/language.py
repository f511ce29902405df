"""Operator 10: language identification of pages by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior per page: the likelihood of the page's own text under
byte-trigram models of each language; the language that the markup declares; the address suffix; and
a prior of the host. How far a declaration is to be trusted, and the priors, are learnt from all pages
by grouped aggregation of their text-only posteriors: the host's prior is smoothed towards its
suffix's, that towards the corpus's, and a page never counts for its own prior.

Edge cases: null html, or a page without text, is decided by the other evidence; a null url has the
empty host and no suffix; a page without any evidence gets the corpus prior; without labelled texts
the result has the language null and posterior 0; rows that repeat a page_id are decided each and
count each; ties go to the alphabetically first language; extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import html_text, scan
from ._spark import join_groups, staged

#: Labelled texts a language that its trigram model may learn from.
MOST = 2_000
BUCKETS = 1 << 13
#: Trigrams overlap and repeat, so their evidence counts less: at most as LONGEST independent ones.
LONGEST = 120.0
#: Pseudo-counts of the smoothing: suffix towards corpus, host towards suffix, and of declarations.
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT = 20.0, 10.0, 2.0

_HTML = re.compile(r"<html\b([^>]*)>", re.IGNORECASE)
_LANG = re.compile(r"(?:^|\s)(?:xml:)?lang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.IGNORECASE)
_META = re.compile(r"<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?\s*([a-zA-Z]{2,3})(?![a-zA-Z])", re.IGNORECASE)


def declared(html: str) -> str:
    """The primary language that the markup names, lower case; empty if none."""
    for tag in _HTML.finditer(html):
        found = _LANG.search(tag[1])
        if found:
            return found[1].lower()
    found = _META.search(html)
    return found[1].lower() if found else ""


def suffix(host: str) -> str:
    """The last label of a host name without its port; empty for numbers and bare names."""
    name = host.partition(":")[0].rstrip(".")
    last = name.rpartition(".")[2] if "." in name else ""
    return last if last.isalpha() else ""


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of lower-case bytes, first trigram of each row); letters and gaps only."""
    low, high = int(offsets[0]), int(offsets[-1])
    raw = scan.LOWERED[data[low:high]]
    n = max(0, len(raw) - 2)
    a, b, c = (raw[k : k + n].astype(np.uint32) for k in range(3))
    bucket = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) % np.uint32(BUCKETS)
    # a row's trigrams end with it, and a run of gaps tells nothing
    keep = ~((a == 32) & (b == 32)) & ~((b == 32) & (c == 32))
    for back in (1, 2):
        cut = offsets[1:] - low - back
        keep[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(keep)
    return bucket[at].astype(np.int64), np.searchsorted(at, offsets - low)


def model(docs: DataFrame, most: int = MOST) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the buckets) from at most ``most`` texts a language."""
    known = docs.filter("lang is not null and lang <> '' and text is not null").select("lang", "doc_id", "text")
    langs = sorted(x["lang"] for x in known.groupBy("lang").count().collect())
    if not langs:
        return [], np.zeros((0, BUCKETS))
    names = known.select("lang", F.xxhash64("doc_id", F.lit(29)).alias("order"))
    picked = None
    for lang in langs:  # a cut per language: the order of its most-th row, found on the keys alone
        own = names.filter(F.col("lang") == lang).orderBy("order").limit(most).agg(F.max("order").alias("last")).withColumn("lang", F.lit(lang))
        picked = own if picked is None else picked.unionByName(own)
    cuts = {x["lang"]: x["last"] for x in picked.collect()}
    test = F.lit(False)
    for lang, last in cuts.items():
        test |= (F.col("lang") == lang) & (F.xxhash64("doc_id", F.lit(29)) <= F.lit(last))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                offsets, data = scan.buffers(batch.column(1))
                row_lang = np.array([langs.index(x) for x in batch.column(0).to_pylist()])
                for a, b in scan.slices(offsets):
                    bucket, first = trigrams(offsets[a : b + 1], data)
                    who = np.repeat(row_lang[a:b], np.diff(first))
                    total += np.bincount(who * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        k, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(total[k, v])], names=["l", "b", "n"])

    rows = known.filter(test).select("lang", "text").mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BUCKETS rows
    total = np.zeros((len(langs), BUCKETS))
    total[rows["l"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return langs, np.log((total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """(page_id, url, host, suffix, declared, text array) with text the tempered log likelihoods."""
    shared = pages.sparkSession.sparkContext.broadcast(logs.T.astype(np.float32).copy())  # languages x 32 KB
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("text", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for low in range(0, len(batch), 100):
                    some = batch.slice(low, 100)
                    ids, urls, htmls = (some.column(k).to_pylist() for k in range(3))
                    texts = []
                    for html in htmls:
                        page = html_text.lines(html or "")
                        inner = [t for t, z in page if z == html_text.MAIN]
                        texts.append("\n".join(inner or [t for t, z in page if z == html_text.OPEN]))
                    hosts = [html_text.key(u, 0)[0] for u in urls]
                    told = [declared(h or "") for h in htmls]
                    offsets, data = scan.buffers(pa.array(texts, pa.large_string()))
                    bucket, first = trigrams(offsets, data)
                    out = []
                    for a, b in zip(first[:-1], first[1:], strict=True):
                        total = table[bucket[a:b]].sum(axis=0, dtype=np.float64)
                        out.append(total * min(1.0, LONGEST / max(1, b - a)))
                    yield pa.RecordBatch.from_pydict({"page_id": ids, "url": urls, "host": hosts, "suffix": [suffix(h) for h in hosts], "declared": [x if x in langs else "other" if x else "" for x in told], "text": [x.tolist() for x in out]}, schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, host string, suffix string, declared string, text array<double>")


def _softmax(column):
    top = F.array_max(column)
    raised = F.transform(column, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame, most: int = MOST) -> DataFrame:
    """(page_id, url, lang, posterior, text_lang, declared), one row per page."""
    langs, logs = model(docs, most)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"))
    found = evidence(pages, langs, logs)
    found = staged(found.withColumn("p", _softmax(F.col("text"))), "evidence")
    each = range(len(langs))
    mass = [F.sum(F.col("p")[k]).alias(f"m{k}") for k in each]
    total = found.agg(F.count(F.lit(1)).alias("n"), *mass).first()
    n = total["n"]
    if not n:
        return found.select("page_id", "url", F.lit("").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("").alias("text_lang"), "declared")
    corpus = np.array([total[f"m{k}"] + 1.0 for k in each])
    corpus /= corpus.sum()
    # P(declaration | language): at most len(langs) + 2 rows
    trust = {}
    for row in found.groupBy("declared").agg(*mass).collect():
        trust[row["declared"]] = np.array([row[f"m{k}"] for k in each])
    kinds = sorted(trust)
    counts = np.array([trust[k] for k in kinds]) + DECLARED_WEIGHT * np.array([[1.0 if k == lang else 0.2 for lang in langs] for k in kinds])
    likely = counts / counts.sum(axis=0, keepdims=True)
    # hierarchical priors: corpus -> suffix -> host
    suffixes = found.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), *mass)
    smoothed = F.array(*[(F.col(f"m{k}") + F.lit(SUFFIX_WEIGHT * float(corpus[k]))) / (F.col("n") + SUFFIX_WEIGHT) for k in each])
    suffixes = suffixes.select("suffix", smoothed.alias("above"))
    hosts = found.groupBy("host").agg(F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("group_size"), *mass).join(suffixes, "suffix")
    hosts = hosts.select("host", "group_size", F.col("group_size").alias("size"), F.array(*[f"m{k}" for k in each]).alias("mass"), "above")
    rows = join_groups(found, hosts, ["host"], ["size", "mass", "above"], n, F.xxhash64("page_id", "url"))
    # own counts leave the host's before smoothing
    prior = [(F.col("mass")[k] - F.col("p")[k] + HOST_WEIGHT * F.col("above")[k]) / (F.col("size") - 1 + HOST_WEIGHT) for k in each]
    told = F.lit(None).cast("array<double>")
    for k, kind in enumerate(kinds):  # no declaration is no evidence
        told = F.when(F.col("declared") == kind, F.array(*[F.lit(float(np.log(x)) if kind else 0.0) for x in likely[k]])).otherwise(told)
    logits = F.array(*[F.col("text")[k] + F.col("told")[k] + F.log(F.greatest(prior[k], F.lit(1e-12))) for k in each])
    rows = rows.withColumn("told", told).withColumn("logits", logits).withColumn("post", _softmax(F.col("logits")))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return rows.select("page_id", "url", best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("posterior"), best(F.col("text")).alias("text_lang"), "declared")
