"""Operator 8: toxicity by a convolutional text classifier trained in numpy.

A term's embedding is the sum of hashed rows for the term itself and for its first PREFIXES bytes, so
inflected forms share what was learnt of their stem. Filters of several widths slide over the
embeddings, a rectified maximum over all positions of the whole text pools each filter, and a
logistic layer gives the score. Filters are linear in the embeddings, so each offset of a filter is
applied once to the distinct terms of a slice and then gathered by position. A threshold for each
language is calibrated on labelled rows that the weights did not see; the language only picks the
threshold, it is no input of a score.

Every labelled row that is not held out is learnt from, whole: three in four train the weights, the rest
calibrate. Training rows are dealt by hash into shards; in each round one task a shard starts at the
common network and passes over its rows, and what the shards changed is averaged, row by row of the
embeddings over the shards that touched it. The driver holds the network and counts, never rows.

Edge cases: a null text counts as empty; a text without terms has pooled features of zero and gets a
score as any other; without labels of both classes the score is a constant; a language without enough
calibration rows, or none, uses the threshold of all languages; rows that repeat a doc_id are scored
each; rows without a doc_id are scored and never held out; extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from . import labelled, scan

#: Bytes of a block of a long text.
BLOCK = 1 << 20
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 14, 16, 12, (1, 2, 3), (4, 5, 6)
KINDS = 1 + len(PREFIXES)
EPOCHS, BATCH, STEP = 10, 32, 0.01
#: A training batch ends early beyond so many terms, and longer texts are searched in pieces of as many.
BATCH_TERMS = 30_000
#: Rows and terms that are shuffled together in a shard before they are cut into batches.
WINDOW, WINDOW_TERMS = 2_048, 2_000_000
#: About how many training rows make a shard, and how many shards there are at most: larger tables have longer ones.
SHARD_ROWS, SHARDS = 16_384, 128
#: Rows of the network that are averaged in one piece.
PIECE = 4_096
#: One in so many labelled rows calibrates thresholds instead of training weights.
CALIBRATES = 4
#: Logits are counted in cells of 1 / CELLS between -FARTHEST and FARTHEST; thresholds lie between cells.
CELLS, FARTHEST = 1_024, 64
LEAST = 20  # rows of each class that a language needs for a threshold of its own


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(KINDS buckets of each term, first term of each row)."""
    starts, ends, first = scan.terms(offsets, data)
    out = np.empty((len(starts), KINDS), np.uint16)
    mask = np.uint64(BUCKETS - 1)
    out[:, 0] = scan.hashes(data, starts, ends) & mask
    for k, size in enumerate(PREFIXES, 1):
        out[:, k] = (scan.hashes(data, starts, np.minimum(ends, starts + size)) + np.uint64(size)) & mask
    return out, first


def blocks(data: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(buckets, whether it is the last) of each block of one text in bytes [low, high); blocks end at a gap."""
    while low < high:
        end = low + BLOCK
        while end < high and not (gaps := np.flatnonzero(scan._GAP[data[end : end + BLOCK]])).size:
            end += BLOCK
        end = min(high, end + int(gaps[0]) if end < high else high)
        yield features(np.array([low, end]), data)[0], end == high
        low = end


@dataclass
class Network:
    table: np.ndarray  # (KINDS, BUCKETS, DIM)
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    shift: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0  # of calibrated scores: 0.5 stands where the classes part best
    centre: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    _seen: tuple | None = None

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return sum(self.table[k][buckets[:, k]] for k in range(KINDS))

    def responses(self, buckets: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
        """Each filter of this width at each position; windows end with their row."""
        n = len(buckets)
        inverse, e = self._distinct(buckets)
        total = np.tile(self.shift[width], (n, 1))
        for j in range(width):
            moved = (e @ self.filters[width][j])[inverse[j:]]
            for back in range(1, j + 1):  # the last positions of a row look no further
                cut = first[1:-1] - back
                moved[cut[(cut >= first[:-2]) & (cut < n - j)]] = 0
            total[: n - j] += moved
        return total

    def _distinct(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._seen is None or self._seen[0] is not buckets:
            code = np.zeros(len(buckets), np.uint64)
            for k in range(KINDS):
                code = (code << np.uint64(14)) | buckets[:, k]
            _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
            self._seen = (buckets, inverse, self.embed(buckets[at]))
        return self._seen[1:]

    def pool(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The rectified maximum of every filter over each row; a row without terms: zeros."""
        out = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(np.diff(first))
        for w, width in enumerate(WIDTHS):
            if len(full):
                best = np.maximum.reduceat(self.responses(buckets, first, width), first[:-1][full], axis=0)
                out[full, w * FILTERS : (w + 1) * FILTERS] = np.maximum(best, 0)
        self._seen = None
        return out

    def pool_long(self, data: np.ndarray, low: int, high: int) -> np.ndarray:
        """pool() of one text in bytes [low, high), block by block: memory follows a block, not the text.

        The last terms of a block open the next one, so every window is seen.
        """
        best, back, held = np.zeros((1, len(WIDTHS) * FILTERS), np.float32), max(WIDTHS) - 1, np.zeros((0, KINDS), np.uint16)
        for found, last in blocks(data, low, high):
            held = np.concatenate([held, found])
            n = len(held) if last else len(held) - back  # windows from here on are whole
            for w, width in enumerate(WIDTHS):
                if n > 0:
                    at = slice(w * FILTERS, (w + 1) * FILTERS)
                    best[0, at] = np.maximum(best[0, at], self.responses(held, np.array([0, len(held)]), width)[:n].max(axis=0))
            self._seen, held = None, held[max(n, 0) :]
        return best

    def score_texts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Scores of the texts between the offsets."""
        if len(offsets) == 2 and offsets[1] - offsets[0] > 2 * BLOCK:
            return self._probability(self.pool_long(data, int(offsets[0]), int(offsets[1])).astype(np.float64) @ self.out + self.bias)
        return self.score(*features(offsets, data))

    def logit(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pool(buckets, first).astype(np.float64) @ self.out + self.bias

    def score(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        return self._probability(self.logit(buckets, first))

    def _probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * (logit - self.centre))


def _fresh(seed: int = 5) -> Network:
    draw = np.random.default_rng(seed)
    # nearly zero, so that terms never trained on stir no filter
    table = draw.normal(0, 0.02, (KINDS, BUCKETS, DIM)).astype(np.float32)
    filters = {w: draw.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    return Network(table, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, draw.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0)


_SHAPES = {"table": (KINDS, BUCKETS, DIM)} | {f"f{w}": (w, DIM, FILTERS) for w in WIDTHS} | {f"s{w}": (FILTERS,) for w in WIDTHS} | {"out": (len(WIDTHS) * FILTERS,), "bias": (1,)}
#: Rows of DIM numbers that hold a network: those of the embeddings, then all other parameters.
ROWS = -(-sum(int(np.prod(x)) for x in _SHAPES.values()) // DIM)


def _views(plane: np.ndarray) -> dict[str, np.ndarray]:
    flat, out, at = plane.reshape(-1), {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def winners(net: Network, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(maxima, terms, which of them are there) of the window that wins each filter in each text, by pieces."""
    pooled = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.float32)
    terms = np.zeros((*pooled.shape, max(WIDTHS), KINDS), np.uint16)
    inside = np.zeros(terms.shape[:3], bool)
    held: list[tuple[int, np.ndarray, int]] = []  # (text, terms, windows that start in the piece)

    def search() -> None:
        rows, buckets = np.array([i for i, _, _ in held]), np.concatenate([x for _, x, _ in held])
        first = np.cumsum([0, *[len(x) for _, x, _ in held]])
        for w, width in enumerate(WIDTHS):
            total = net.responses(buckets, first, width)
            win = np.array([a + total[a : a + n].argmax(axis=0) for a, (_, _, n) in zip(first, held, strict=False)])
            best = np.take_along_axis(total, win, axis=0)
            r, f = np.nonzero(best > pooled[rows, w * FILTERS : (w + 1) * FILTERS])
            at = rows[r], w * FILTERS + f
            pooled[at] = best[r, f]
            for j in range(width):
                place = win[r, f] + j
                inside[(*at, j)] = place < first[r + 1]
                terms[(*at, j)] = buckets[np.minimum(place, len(buckets) - 1)]
        net._seen = None
        held.clear()

    for i, doc in enumerate(docs):
        for a in range(0, len(doc), BATCH_TERMS):
            if held and (held[-1][0] == i or sum(len(x) for _, x, _ in held) > BATCH_TERMS):
                search()
            held.append((i, doc[a : a + BATCH_TERMS + max(WIDTHS) - 1], min(BATCH_TERMS, len(doc) - a)))
    if held:
        search()
    return pooled, terms, inside


class Learner:
    """A network and its Adam moments in one array (value and moments, ROWS, DIM), trained in place.

    Rows of embeddings that a batch did not touch stay as they are.
    """

    def __init__(self, state: np.ndarray, t: int = 0) -> None:
        self.state, self.t = state, t
        self.value, self.mean, self.square = map(_views, state)
        v = self.value
        self.net = Network(v["table"], {w: v[f"f{w}"] for w in WIDTHS}, {w: v[f"s{w}"] for w in WIDTHS}, v["out"], float(v["bias"][0]))

    @classmethod
    def fresh(cls) -> Learner:
        out, net = cls(np.zeros((3, ROWS, DIM), np.float32)), _fresh()
        for name, x in {"table": net.table, "out": net.out, **{f"f{w}": net.filters[w] for w in WIDTHS}}.items():
            out.value[name][:] = x
        return out

    def _move(self, name: str, grad: np.ndarray, at: tuple = ()) -> None:
        value, m, v = self.value[name], self.mean[name], self.square[name]
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad**2
        value[at] -= STEP * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """One update; gradients reach only the windows that won the maximum."""
        net = self.net
        pooled, found, inside = winners(net, docs)
        wide = pooled.astype(np.float64)
        error = (1 / (1 + np.exp(-(wide @ net.out + net.bias))) - y) / len(y)
        self.t += 1
        back = (error[:, None] * net.out[None, :] * (pooled > 0)).astype(np.float32)
        touched, pulls = [], []
        for w, width in enumerate(WIDTHS):
            g = back[:, w * FILTERS : (w + 1) * FILTERS]
            grad = np.zeros_like(net.filters[width])
            for j in range(width):
                row, f = np.nonzero(inside[:, w * FILTERS : (w + 1) * FILTERS, j] & (g != 0))
                terms = found[row, w * FILTERS + f, j]
                pull = g[row, f]
                np.add.at(grad[j].T, f, pull[:, None] * net.embed(terms))
                touched.append(terms)
                pulls.append(pull[:, None] * net.filters[width][j].T[f])
            self._move(f"f{width}", grad)
            self._move(f"s{width}", g.sum(axis=0))
        terms, pull = np.concatenate(touched), np.concatenate(pulls)
        for k in range(KINDS):
            rows, inverse = np.unique(terms[:, k], return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, inverse, pull)
            self._move("table", grad, (k, rows))
        self._move("out", wide.T @ error + 1e-4 * net.out)
        self._move("bias", np.array([error.sum()]))
        net.bias = float(self.value["bias"][0])

    def epoch(self, rows: Iterator[tuple[float, np.ndarray]], draw: np.random.Generator) -> None:
        """One pass over rows (label, buckets), shuffled window by window."""
        docs, y, terms = [], [], 0

        def learn() -> None:
            at, size = [], 0
            for i in draw.permutation(len(docs)).tolist():
                at.append(i)
                size += len(docs[i])
                if len(at) == BATCH or size > BATCH_TERMS:
                    self.step([docs[k] for k in at], np.array([y[k] for k in at]))
                    at, size = [], 0
            if at:
                self.step([docs[k] for k in at], np.array([y[k] for k in at]))
            docs.clear(), y.clear()

        for label, doc in rows:
            docs.append(doc)
            y.append(label)
            terms += len(doc)
            if len(docs) == WINDOW or terms > WINDOW_TERMS:
                learn()
                terms = 0
        if docs:
            learn()


def _cut(cells: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """The logit with the fewest errors, in the middle of its gap, from counts of both labels in ascending cells."""
    errors = np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([np.cumsum(good[::-1])[::-1], [0]])
    before = np.concatenate([[0], np.cumsum(bad + good)])
    best = np.flatnonzero(errors == errors.min())
    gaps = [(cells[k] - cells[k - 1] if 0 < k < len(cells) else 0, -abs(before[k] - before[-1] / 2), k) for k in best]
    k = max(gaps)[2]
    if k == 0 or k == len(cells):
        return float(cells[0] / CELLS - 1 if k == 0 else (cells[-1] + 1) / CELLS + 1)
    return float((cells[k - 1] + 1 + cells[k]) / 2 / CELLS)


def _sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their text, the last column, replaced by its buckets; long texts block by block."""
    with np.errstate(over="ignore"):
        for batch in batches:
            n, names = batch.num_columns - 1, [*batch.schema.names[:-1], "buckets"]
            offsets, data = scan.buffers(batch.column(n))
            for a, b in scan.slices(offsets):
                if b - a == 1 and offsets[b] - offsets[a] > 2 * BLOCK:
                    raw = [b"".join(found.tobytes() for found, _ in blocks(data, int(offsets[a]), int(offsets[b])))]
                else:
                    found, first = features(offsets[a : b + 1], data)
                    raw = [found[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(n)], pa.array(raw, pa.binary())], names=names)


def _buckets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, KINDS) if len(x.as_buffer()) else np.zeros((0, KINDS), np.uint16) for x in column]


def _round(rows: DataFrame, learner: Learner, number: int) -> None:
    """One pass over the training rows (shard, y, buckets), one network a shard; the learner takes their average."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((learner.state, learner.t))  # some 13 MB, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, float, np.ndarray]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _buckets(batch.column(2)), strict=True)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, t = shared.value
        for shard, own in groupby(each(batches), key=lambda x: x[0]):
            mine = Learner(state.copy(), t)
            mine.epoch(((y, doc) for _, y, doc in own), np.random.default_rng([9, number, shard]))
            new = np.flatnonzero((mine.state != state).any(axis=(0, 2)))
            for piece in range(-(-ROWS // PIECE)):
                at = new[new // PIECE == piece]
                if len(at):
                    yield pa.RecordBatch.from_pylist([{"piece": piece, "shard": shard, "t": mine.t, "at": at.astype(np.int32).tobytes(), "x": mine.state[:, at].tobytes()}], schema)

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, parts in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["piece"]):
            total, count, last = np.zeros((3, PIECE, DIM)), np.zeros(PIECE), 0
            for r in parts:
                at = np.frombuffer(r["at"], np.int32) - piece * PIECE
                total[:, at] += np.frombuffer(r["x"], np.float32).reshape(3, -1, DIM)
                count[at] += 1
                last = max(last, r["t"])
            at = np.flatnonzero(count)
            mean = (total[:, at] / count[at, None]).astype(np.float32)
            yield pa.RecordBatch.from_pylist([{"piece": piece, "shard": -1, "t": last, "at": (at + piece * PIECE).astype(np.int32).tobytes(), "x": mean.tobytes()}], schema)

    schema = pa.schema([("piece", pa.int32()), ("shard", pa.int32()), ("t", pa.int64()), ("at", pa.binary()), ("x", pa.binary())])
    kind = "piece int, shard int, t long, at binary, x binary"
    parts = rows.select("shard", "y", "buckets").mapInArrow(learnt, kind)
    # in the order of the shards, so that sums round alike however the parts arrive
    means = parts.repartition(-(-ROWS // PIECE), "piece").sortWithinPartitions("piece", "shard").mapInArrow(averaged, kind).toArrow().to_pylist()
    shared.destroy()
    for r in means:
        learner.state[:, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32).reshape(3, -1, DIM)
        learner.t = max(learner.t, r["t"])


def _calibrate(rows: DataFrame, net: Network) -> None:
    """Centre, scale and thresholds from all the rows (lang, y, buckets): their logits are counted by cell."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net = shared.value
            z = winners(net, _buckets(batch.column(2)))[0].astype(np.float64) @ net.out + net.bias
            cells = np.floor(np.clip(z, -FARTHEST, FARTHEST) * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells), batch.column(1)], names=["lang", "cell", "y"])

    def cut(part: pa.Table) -> pa.Table:
        part = part.sort_by("cell")
        cells, bad, good = (part.column(c).to_numpy() for c in ("cell", "bad", "good"))
        enough = min(bad.sum(), good.sum()) >= LEAST
        return pa.table({"lang": part.column("lang").slice(0, int(enough)), "cut": pa.array([_cut(cells, bad, good)] * int(enough), pa.float64())})

    count = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    found = rows.select("lang", "y", "buckets").mapInArrow(counted, "lang string, cell int, y int").select("lang", "cell", F.col("y").cast("long").alias("bad"), (1 - F.col("y")).cast("long").alias("good"))
    found = found.groupBy("lang", "cell").agg(*count).persist(StorageLevel.DISK_ONLY)
    whole = found.groupBy("cell").agg(*count).toArrow().sort_by("cell")  # 2 * FARTHEST * CELLS rows at most
    cells, bad, good = (whole.column(c).to_numpy() for c in ("cell", "bad", "good"))
    net.centre = _cut(cells, bad, good)
    far = np.abs((cells + 0.5) / CELLS - net.centre)
    order = np.argsort(far, kind="stable")
    reach = np.cumsum((bad + good)[order])
    gap = float(far[order][np.searchsorted(reach, reach[-1] / 2)])
    net.scale = float(np.clip(4 / max(gap, 1e-6), 0.2, 5))
    for r in found.filter("lang != ''").groupBy("lang").applyInArrow(cut, "lang string, cut double").orderBy("lang").collect():
        net.thresholds[r.lang] = float(_sigmoid(net.scale * (r.cut - net.centre)))
    found.unpersist()
    shared.destroy()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network:
    """A network for the label from every labelled row that is not held out; lang only sorts calibration rows."""
    lang = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    calibrates = F.abs(F.xxhash64("doc_id", F.lit(3)) % 1_000_003) % CALIBRATES == 0
    rows, known = labelled.rows(lang, labels, label, ("lang",))
    sizes = {(r.calibrates, r.y): r["count"] for r in rows.groupBy(calibrates.alias("calibrates"), "y").count().collect()}
    if not all(sizes.get((False, y)) for y in (0, 1)):
        net, ones, n = _fresh(), sum(k for (_, y), k in sizes.items() if y), sum(sizes.values())
        share = np.clip(ones / max(n, 1), 0.01, 0.99)
        net.out[:], net.bias = 0, float(np.log(share / (1 - share))) if n else 0.0
        known.unpersist()
        return net
    shards = min(max(1, -(-(sizes[False, 0] + sizes[False, 1]) // SHARD_ROWS)), SHARDS)
    order = F.xxhash64("doc_id", "text", F.lit(23))
    dealt = rows.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"), calibrates.alias("calibrates"), "y", "lang", "text")
    dealt = dealt.mapInArrow(_packed, "shard int, order long, calibrates boolean, y int, lang string, buckets binary")
    # the same network however the rows arrive; kept on disk for all rounds
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "order").persist(StorageLevel.DISK_ONLY)
    learner = Learner.fresh()
    for number in range(EPOCHS):
        _round(dealt.filter("not calibrates"), learner, number)
    net = learner.net
    net.bias = float(learner.value["bias"][0])
    _calibrate(dealt.filter(F.col("calibrates") == all(sizes.get((True, y)) for y in (0, 1))), net)
    dealt.unpersist()
    known.unpersist()
    # without the moments, which the array behind the learner's network holds too
    return Network(net.table.copy(), {w: x.copy() for w, x in net.filters.items()}, {w: x.copy() for w, x in net.shift.items()}, net.out.astype(np.float64), net.bias, net.scale, net.centre, net.thresholds)


def scored(docs: DataFrame, net: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, *keep) of every row."""
    fields = [f for f in docs.schema if f.name in keep]
    kind = "doc_id long, score double" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in fields)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 4 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                offsets, data = scan.buffers(batch.column(1))
                for a, b in scan.slices(offsets):
                    score = model.score_texts(offsets[a : b + 1], data)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), *[batch.column(2 + k).slice(a, b - a) for k in range(len(fields))]], names=["doc_id", "score", *[f.name for f in fields]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"), *[F.col(f.name) for f in fields]).mapInArrow(run, kind)


def bound(net: Network, lang: Column) -> Column:
    """The calibrated threshold of a language."""
    out = F.lit(net.threshold)
    for name, cut in net.thresholds.items():
        out = F.when(lang == name, F.lit(cut)).otherwise(out)
    return out


def classify(docs: DataFrame, labels: DataFrame, fixed: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged): predicted by ``fixed``, flagged by the language's threshold."""
    net = train(docs, labels)
    rows = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    out = scored(rows, net, ("lang",)).withColumn("threshold", bound(net, F.col("lang")))
    return out.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= fixed).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def keep(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays below their language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = labelled.with_score(docs, lambda offsets, data: shared.value.score_texts(offsets, data))
    lang = F.col("row.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return rows.filter(F.col("score") < bound(net, lang)).select("row.*")
