"""Operator 1: quality scores by histogram gradient-boosted trees over document statistics.

Statistics come from the whole text, vectorised over Arrow buffers. Trees are grown level by level on
quantile bins with second-order gains, fitted on a bounded sample of labelled rows (MOST a class), and
flattened into arrays that numpy walks for all rows of a batch at once.

Edge cases: a null text counts as empty and gets a score too; without labels of both classes the score
is the share of label 1 (0.5 without any label); rows that repeat a doc_id are scored each; rows
without a doc_id are scored and never held out; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import labelled, scan

#: Labelled rows a class that the trees may learn from.
MOST = 10_000
TREES, DEPTH, BINS, RATE, SMOOTH = 60, 4, 64, 0.2, 1.0

# Character classes whose shares are statistics.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:", "!?", "#*$%&|<>", "()[]{}\"'", "=/\\@_+-~^`", " \t", "\n")
STATISTICS = [*(f"share_{k}" for k in range(len(CLASSES))), "beyond_ascii", "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_trigrams", "log_lines", "repeated_lines", "line_length", "stopped_lines"]
_CLASS = np.full(256, len(CLASSES) + 1, np.uint8)
for _k, _chars in enumerate(CLASSES):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = len(CLASSES)
_LINE = np.zeros(256, bool)
_LINE[10] = True


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice."""
    low, rows = int(offsets[0]), len(offsets) - 1
    sizes = np.diff(offsets).astype(np.float64)
    out = np.zeros((rows, len(STATISTICS)))
    kind = _CLASS[data[low : int(offsets[-1])]]
    full = np.flatnonzero(sizes)
    edges = offsets[:-1][full] - low
    for c in range(len(CLASSES) + 1):
        if len(full):
            out[full, c] = np.add.reduceat(kind == c, edges, dtype=np.int64) / sizes[full]
    starts, ends, first = scan.words(offsets, data)
    h = scan.hashes(data, starts, ends)
    grams = scan.windows(h, 3)
    line_starts, line_ends, line_first = scan.words(offsets, data, _LINE)
    lines = scan.hashes(data, line_starts, line_ends)
    length = (ends - starts).astype(np.float64)
    stopped = np.isin(data[line_ends - 1], np.frombuffer(b".!?:;\"'", np.uint8)) if len(line_ends) else np.zeros(0, bool)
    at = len(CLASSES) + 1
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        c, d = int(line_first[i]), int(line_first[i + 1])
        n, m = b - a, d - c
        row = [np.log1p(sizes[i]), np.log1p(n), 0, 0, 1, 0, 0, np.log1p(m), 0, 0, 0]
        if n:
            _, counts = np.unique(h[a:b], return_counts=True)
            row[2:6] = [length[a:b].mean(), np.log1p(length[a:b].max()), len(counts) / n, counts.max() / n]
            if n > 3:
                row[6] = 1 - len(np.unique(grams[a : b - 2])) / (n - 2)
        if m:
            row[8:11] = [1 - len(np.unique(lines[c:d])) / m, np.log1p(sizes[i] / m), stopped[c:d].mean()]
        out[i, at:] = row
    return out


@dataclass
class Trees:
    """Complete trees in arrays: node k has the children 2k + 1 and 2k + 2; leaves are the last level."""

    feature: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray  # go right when the statistic is greater
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):  # all rows stand on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the log loss; a constant when a class is missing."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(y[0])
        base = float(np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99))))
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    base = float(np.log(share / (1 - share)))
    total, inner = np.full(len(y), base), 2**depth - 1
    features, bounds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, start = 2**level, 2**level - 1
            here = node - start
            best = np.full(width, 1e-6)
            g_all, h_all = np.bincount(here, grad, width), np.bincount(here, hess, width)
            split = np.full(width, -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                place = here * (BINS + 1) + binned[:, f]
                g = np.bincount(place, grad, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)[:, : len(c)]
                h = np.bincount(place, hess, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)[:, : len(c)]
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + SMOOTH) + gr**2 / (hr + SMOOTH) - (g_all**2 / (h_all + SMOOTH))[:, None]
                gain[(h < 0.5) | (hr < 0.5)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], split[better] = top[better], k[better]
                feature[start : start + width][better] = f
                bound[start : start + width][better] = c[k[better]]
            right = x[np.arange(len(y)), feature[node]] > bound[node]
            node = 2 * node + 1 + right
        leaf_of = node - inner
        g, h = np.bincount(leaf_of, grad, inner + 1), np.bincount(leaf_of, hess, inner + 1)
        leaf = RATE * g / (h + SMOOTH)
        total += leaf[leaf_of]
        features.append(feature)
        bounds.append(bound)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(bounds), np.array(leaves), base)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, statistics) of the rows (y, text)."""
    with np.errstate(over="ignore"):
        for batch in batches:
            offsets, data = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets):
                x = statistics(offsets[a : b + 1], data)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])]], names=["y", *STATISTICS])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> Trees:
    """Trees for the label, from at most ``most`` rows a class."""
    rows = labelled.sample(docs, labels, label, most).select("y", "text")
    found = rows.mapInArrow(_numbers, "y int, " + ", ".join(f"{x} double" for x in STATISTICS)).toPandas()
    found = found.sort_values(list(found.columns))  # the same trees however the rows arrive
    return fit(found[STATISTICS].to_numpy(np.float64), found["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, *keep) of every row."""
    fields = [f for f in docs.schema if f.name in keep]
    kind = "doc_id long, score double" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                offsets, data = scan.buffers(batch.column(1))
                for a, b in scan.slices(offsets):
                    score = model.score(statistics(offsets[a : b + 1], data))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), *[batch.column(2 + k).slice(a, b - a) for k in range(len(fields))]], names=["doc_id", "score", *[f.name for f in fields]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"), *[F.col(f.name) for f in fields]).mapInArrow(run, kind)


def classify(docs: DataFrame, labels: DataFrame, bound: float = 0.3, most: int = MOST) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = scored(docs, train(docs, labels, most=most))
    return out.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= bound).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Trees, bound: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the bound."""
    return labelled.with_score(docs, lambda offsets, data: model.score(statistics(offsets, data))).filter(F.col("score") >= bound).select("row.*")
