"""Operator 6: near-duplicate classes by b-bit MinHash.

Per document: the set of distinct shingles, PERMUTATIONS minima, their low B bits packed into bit
planes, and one key per band. Documents with equal sets form a class first, so copies are never
paired. In two rounds a few hubs of each band bucket are compared with all its members, by one-way
broadcast where a bucket is hot; the similarity is estimated from bit counts, corrected for chance
collisions, and survivors are confirmed on full sets, the likeliest first. A hub leaves its bucket
only after all members were compared with it, and a bucket is done when all its members lie in one
component.
What is left in small buckets (up to SMALL members) is compared there. Large buckets hold texts that
share a passage and little else; their members are joined on the rarest of their shingles instead: two
sets of the wanted similarity must share one among their first (100 - p) / (100 + p) and (100 - p) / 100
parts in order of frequency. So no link between candidates is lost, and no pairs of a large bucket are
listed.

Edge cases: null or wordless texts have the empty set and link with nothing; fewer words than the
shingle width count as one shingle; ties cannot occur (doc_id decides); rows that repeat a doc_id
give repeated results, each by its own text; rows without a doc_id cannot be named and are left out, as are extra
columns; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom, scan
from ._spark import BROADCAST_ROWS, BY_WORKERS, HOT_SHARE, WIDE, forget, join_groups, new_folder, opened, small, written
from .components import components

BANDS, ROWS, B = 32, 5, 2
PERMUTATIONS = 192  # the bands' and more for the estimate
SIGNATURE = [f"s{j}" for j in range(B * PERMUTATIONS // 64)]  # B planes of one bit a minimum
#: Pairs whose estimate lies this much below the threshold are not confirmed: over 4.5 standard
#: deviations of the estimate at the threshold, sqrt(C (1 - C) / PERMUTATIONS) / (1 - 2 ** -B).
MARGIN = 0.16
#: So few candidates are confirmed at once.
FEW = 200_000
#: Members of a bucket that are compared with each other after the hub rounds.
SMALL = 64
#: Shingles in more sets than this are put last.
LIGHT = 2
#: So many frequent shingles are broadcast, 16 bytes each; more are joined.
MOST_FREQUENT = 1 << 19

_SEEDS = scan.stream(101, 2 * PERMUTATIONS)
_A = (_SEEDS[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_C = (_SEEDS[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


def minima(x: np.ndarray, a: np.ndarray = _A, c: np.ndarray = _C) -> np.ndarray:
    """The minima of one set of 64-bit hashes, one for each (a, c)."""
    y = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 19) // len(a))
    for at in range(0, len(y), step):
        np.minimum(out, (a[:, None] * y[None, at : at + step] + c[:, None]).min(axis=1), out=out)
    return out


def _mixed(minimum: np.ndarray) -> np.ndarray:
    return scan.mix(minimum.astype(np.uint64) + np.arange(PERMUTATIONS, dtype=np.uint64)[None, :] * np.uint64(1 << 32))


def packed(minimum: np.ndarray) -> np.ndarray:
    """Low B bits of the mixed minima of each row, as planes: (rows, 6) int64."""
    m = _mixed(minimum)
    planes = [np.packbits(((m >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for j in range(B)]
    return np.concatenate(planes, axis=1)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row."""
    m = _mixed(minimum)[:, : BANDS * ROWS]
    return scan.mix(m.reshape(len(m), BANDS, ROWS).sum(axis=2, dtype=np.uint64) ^ scan.stream(55, BANDS)[None, :]).view(np.int64)


def _sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    offsets, data = scan.buffers(batch.column(batch.schema.get_field_index(text)))
    for a, b in scan.slices(offsets):
        starts, ends, first = scan.words(offsets[a : b + 1], data)
        yield a, b, scan.shingle_sets(scan.hashes(data, starts, ends), first, width)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(k1, k2) of each set: 128 bits that name it."""
    return np.array([[scan.mix(x).sum(dtype=np.uint64), scan.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)


_SIGNED = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, " + "".join(f"{x} long, " for x in SIGNATURE) + "bands array<long>"


def signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, sets in _sets(batch, "text", width):
                    n = np.array([len(x) for x in sets], np.int64)
                    mins = np.stack([minima(x) for x in sets])
                    keys = set_keys(sets)
                    sig, bands = packed(mins), band_keys(mins)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                    own = [batch.column(batch.schema.get_field_index(x)).slice(a, b - a) for x in ("doc_id", "text_hash")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), *[pa.array(np.ascontiguousarray(sig[:, j])) for j in range(len(SIGNATURE))], lists], names=["doc_id", "text_hash", "n_shingles", "k1", "k2", *SIGNATURE, "bands"])

    return run


#: Minima of the finer signature, one low bit each, that candidates of later rounds must pass.
FINE = 2048
FINE_SIGNATURE = [f"f{j}" for j in range(FINE // 64)]
BAND_KEYS = [f"b{j}" for j in range(BANDS)]
FINE_MARGIN = 0.06  # over 4.5 standard deviations, sqrt(C (1 - C) / FINE) / (1 - 1 / 2)
_FINE_SEEDS = scan.stream(202, 2 * FINE)
_FA = (_FINE_SEEDS[:FINE] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FC = (_FINE_SEEDS[FINE:] >> np.uint64(32)).astype(np.uint32)
_PLACE = "doc_id long, k1 long, k2 long, path string, at long, size long, "
_SET_ROW = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), *[(x, pa.int64()) for x in FINE_SIGNATURE]])


def _fine(x: np.ndarray) -> np.ndarray:
    """FINE low bits of one set's minima, packed into longs."""
    m = minima(x, _FA, _FC).astype(np.uint64) + np.arange(FINE, dtype=np.uint64) * np.uint64(1 << 32)
    return np.packbits((scan.mix(m) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def storer(width: int, words, folder: str):
    """Write the full sets of the documents that the Bloom filter lets through to a file of this
    task's attempt in the shared folder; a row for each tells where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, out, path, at = words.value, None, "", 0
        with np.errstate(over="ignore"):
            for batch in batches:
                batch = batch.filter(pa.array(bloom.test(bits, batch.column(0).to_numpy(zero_copy_only=False))))
                for a, b, sets in _sets(batch, "text", width):
                    if out is None:
                        path = f"{folder}/sets-{uuid.uuid4().hex}"
                        files, name = opened(path)
                        files.create_dir(name.rpartition("/")[0], recursive=True)
                        out = files.open_output_stream(name)
                    keys = set_keys(sets)
                    rows = {"doc_id": batch.column(0).slice(a, b - a).to_pylist(), "k1": keys[:, 0], "k2": keys[:, 1], "path": [path] * (b - a), "at": [], "size": [len(x) for x in sets]}
                    for x in sets:
                        rows["at"].append(at)
                        out.write(x.tobytes())
                        at += 8 * len(x)
                    fine = np.stack([_fine(x) for x in sets])
                    rows |= {f: fine[:, j] for j, f in enumerate(FINE_SIGNATURE)}
                    yield pa.RecordBatch.from_pydict(rows, schema=_SET_ROW)
        if out is not None:
            out.close()

    return run


class _Files:
    """Sets read from the files of storer()."""

    def __init__(self) -> None:
        self.open = {}

    def get(self, path: str, at: int, size: int) -> np.ndarray:
        if path not in self.open:
            store, name = opened(path)
            self.open[path] = store.open_input_file(name)
        return np.frombuffer(self.open[path].read_at(8 * size, at), np.uint64)

    def close(self) -> None:
        for f in self.open.values():
            f.close()


#: Bytes of sets that a worker keeps while it confirms pairs.
HELD = 32 << 20


def confirmer(percent: int):
    """Adds ``linked``: the exact test on full sets, read from their files; recent sets are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple[str, int], np.ndarray] = OrderedDict()
        files, total = _Files(), 0

        def get(path: str, at: int, size: int) -> np.ndarray:
            nonlocal total
            if (path, at) in held:
                held.move_to_end((path, at))
                return held[path, at]
            held[path, at] = x = files.get(path, at, size)
            total += 8 * size
            while total > HELD and len(held) > 1:
                total -= 8 * len(held.popitem(last=False)[1])
            return x

        for batch in batches:
            ends = [batch.column(batch.schema.get_field_index(f"{e}_{c}")).to_pylist() for e in "ab" for c in ("path", "at", "size")]
            linked = []
            for k in range(len(batch)):
                x, y = get(*[c[k] for c in ends[:3]]), get(*[c[k] for c in ends[3:]])
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "ca", "cb")], pa.array(linked, pa.bool_())], names=["a", "b", "ca", "cb", "linked"])
        files.close()

    return run


#: Rows of a batch of single shingles.
_STEP = 1 << 16


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, x): every shingle of the sets at (rep, path, at, size)."""
    files = _Files()
    for batch in batches:
        for rep, path, at, size in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            x = files.get(path, at, size).view(np.int64)
            for k in range(0, size, _STEP):
                some = x[k : k + _STEP]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), rep)), pa.array(some)], names=["rep", "x"])
    files.close()


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, c): how many of these sets hold each shingle, summed over some sets at a time."""
    held, total = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        x, c = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
        for k in range(0, len(x), _STEP):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + _STEP]), pa.array(c[k : k + _STEP].astype(np.int64))], names=["x", "c"])

    for batch in _shingles(batches):
        held.append(batch.column(1).to_numpy())
        total += len(batch)
        if total >= 16 * _STEP:
            yield from flush()
            held, total = [], 0
    yield from flush()


_FIRST = "x long, rep long, component long, n long, pos long, short boolean"


def prefixes(percent: int, known=None):
    """(x, rep, component, n, pos, short) of the first shingles of each set, rare ones in front.

    Rows come as (rep, component, path, at, size[, heavy]): heavy lists the set's frequent shingles in order
    of frequency; or known, a broadcast (sorted shingles, counts), tells them. All others stand before them.
    Of two linked sets the first common shingle stands among the smaller one's ``short`` rows and among the
    larger one's rows.
    """

    def order(x: np.ndarray, heavy: list[int] | None) -> np.ndarray:
        if known is None:
            last = np.array(heavy or [], np.int64)
            return np.concatenate([x[~np.isin(x, last)], last])
        names, counts = known.value
        if not len(names):
            return x
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return x[np.lexsort((x, np.where(names[at] == x, counts[at], 0)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(5)], batch.column(5).to_pylist() if known is None else [None] * len(batch), strict=True)
            for rep, component, path, at, n, heavy in rows:
                most, least = n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1
                x = order(files.get(path, at, n).view(np.int64), heavy)[:most]
                for k in range(0, len(x), _STEP):
                    some = x[k : k + _STEP]
                    pos = np.arange(k, k + len(some))
                    same = [pa.array(np.full(len(some), v)) for v in (rep, component, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(some), *same, pa.array(pos), pa.array(pos < least)], names=["x", "rep", "component", "n", "pos", "short"])
        files.close()

    return run


def passage_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): pairs of the sets at (rep, component, path, at, size) that may be linked, each once.

    Every pair of the similarity is among them: shingles are ordered by how many of these sets hold them,
    and the first that a pair has in common lies within both sets' prefixes. Texts whose own words are more
    than the prefix meet on those alone, however many share a passage.
    """
    places = hot.select("rep", "path", "at", "size")
    counts = places.mapInArrow(_tallied, "x long, c long").groupBy("x").agg(F.sum("c").alias("c")).filter(F.col("c") > LIGHT)
    counts, own = written(counts, "frequent"), None
    if (n := counts.count()) <= MOST_FREQUENT:
        known = counts.orderBy("x").toArrow()
        own = hot.sparkSession.sparkContext.broadcast([known.column(k).to_numpy() for k in range(2)])
        first, order = hot.select("rep", "component", "path", "at", "size"), prefixes(percent, own)
    else:
        rows = places.mapInArrow(_shingles, "rep long, x long")
        total = hot.agg(F.sum("size")).first()[0]
        frequent = counts.withColumn("group_size", F.col("c"))
        heavy = join_groups(rows, frequent, ["x"], ["c"], total, F.xxhash64("rep"), "inner").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("heavy"))
        first = hot.join(heavy, "rep", "left").select("rep", "component", "path", "at", "size", F.transform("heavy", lambda h: h["x"]).alias("heavy"))
        order = prefixes(percent)
    first = prefix = written(first, "prefixes", None, order, _FIRST)
    n = first.count()
    # of each shingle the component with most rows is its lead: its rows need not meet each other
    state = first.groupBy("x", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("x").agg(F.max(F.struct("c", "component"))["component"].alias("lead"), F.count(F.lit(1)).alias("several"), F.sum("c").alias("group_size"))
    first = join_groups(first, state.filter("several > 1").drop("several"), ["x"], ["lead"], n, F.xxhash64("rep"), "inner").withColumn("leads", F.col("component") == F.col("lead"))
    s = first.filter("short").withColumn("meets", F.explode(F.when(F.col("leads"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).alias("s")
    y = first.alias("y")
    ordered = (F.col("s.n") < F.col("y.n")) | ((F.col("s.n") == F.col("y.n")) & (F.col("s.rep") < F.col("y.rep")))
    room = F.least(F.col("s.n") - F.col("s.pos"), F.col("y.n") - F.col("y.pos")) * (100 + percent) >= percent * (F.col("s.n") + F.col("y.n"))
    met = s.join(y, (F.col("s.x") == F.col("y.x")) & (F.col("s.meets") == F.col("y.leads")) & (F.col("s.component") != F.col("y.component")) & ordered & (100 * F.col("s.n") >= percent * F.col("y.n")) & room)
    turned = F.col("s.rep") > F.col("y.rep")
    pairs = met.select(F.least("s.rep", "y.rep").alias("a"), F.greatest("s.rep", "y.rep").alias("b"), F.when(turned, F.col("y.component")).otherwise(F.col("s.component")).alias("ca"), F.when(turned, F.col("s.component")).otherwise(F.col("y.component")).alias("cb"))
    out = written(pairs.dropDuplicates(["a", "b"]), "pairs")
    forget(counts, prefix)
    if own is not None:
        own.unpersist()
    return out


def estimate(a: str, b: str, signature: list[str], bits: int) -> Column:
    """Collision-corrected similarity of two packed signatures (column prefixes a and b), from bit counts."""
    each = len(signature) // bits
    differ = F.lit(0)
    for j in range(each):
        any_bit = None
        for plane in range(bits):
            c = signature[plane * each + j]
            x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
            any_bit = x if any_bit is None else any_bit.bitwiseOR(x)
        differ += F.bit_count(any_bit)
    return (1 - differ / F.lit(64 * each) - 2.0**-bits) / (1 - 2.0**-bits)


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable.

    Links join documents whose shingle sets have ``100 * intersection >= percent * union``. The
    banding finds a pair of similarity 0.8 with probability 1 - 3e-6; percent under 80 lowers that.
    """
    return _classes(docs, width, percent).drop("text_hash")


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """classes() with text_hash, which tells the texts of one doc_id apart."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).filter("doc_id is not null")
    signed = written(texts, "signed", None, signer(width), _SIGNED)
    keys = ["n_shingles", "k1", "k2"]
    n_docs = signed.count()
    full = signed.filter("n_shingles > 0").drop("text_hash")
    # a group has a number of its own: its smallest doc_id may stand in another group too
    groups = full.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("group_size")).withColumn("rep", F.monotonically_increasing_id())
    groups = written(groups, "groups", n_docs)
    reps = small(groups.select("rep", F.col("least").alias("doc_id"), *[F.col(k).alias(f"own_{k}") for k in keys]), n_docs).join(full, "doc_id").filter(" and ".join(f"{k} = own_{k}" for k in keys)).dropDuplicates(["rep"])
    reps = written(reps.select("rep", "doc_id", F.col("n_shingles").alias("n"), "k1", "k2", *SIGNATURE, "bands"), "reps", n_docs)
    roots = groups.select("rep", "least").join(small(_links(spark, texts.drop("text_hash"), reps, width, percent), n_docs), "rep")
    named = roots.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("group_size"))
    roots = join_groups(roots, named, ["component"], ["component_id"], n_docs, F.xxhash64("rep")).select("rep", "component_id")
    groups = written(groups.join(small(roots, n_docs), "rep", "left").select(*keys, F.coalesce("component_id", "least").alias("component_id"), "group_size"), "named", n_docs)
    out = join_groups(signed.select("doc_id", "text_hash", *keys), groups, keys, ["component_id"], n_docs, F.xxhash64("doc_id"))
    out = out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, all columns as they are: that with the smallest doc_id; rows without a
    doc_id stay.

    Its tables go by staged(): executors that have run other stages were at the limit of their memory with written().
    """
    token = BY_WORKERS.set(False)
    try:
        gone = written(_classes(docs, width, percent).filter(~F.col("kept")).select("doc_id", F.col("text_hash").alias("mark")).distinct(), "gone")
    finally:
        BY_WORKERS.reset(token)
    return bloom.rows_left(docs, gone, F.xxhash64("text"), gone.count())


def _links(spark, texts: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, component) of all representatives that share a bucket: the components of all confirmed links.

    Two rounds compare hubs of each unfinished bucket with its members: one hub, then up to 64 of as many
    components. The last takes what is left, members of small buckets with each other and those of large
    ones by passage_pairs(). After the first round a pair is looked at in its first common bucket only.
    """
    n_reps = reps.count()
    total = n_reps * BANDS
    members = reps.select("rep", F.posexplode("bands").alias("k", "band")).withColumn("component", F.col("rep"))
    found, sets, keyed, n_sets, last = None, None, None, 0, None
    for hubs_each in (1, 64, 0):
        state = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("group_size")).filter("lo < hi")
        members = written(join_groups(members, state.withColumn("held", F.col("group_size")), ["band"], ["held"], total, F.xxhash64("rep"), "inner"), "members", total)
        forget(last)
        total, last = members.count(), members
        if found is None:
            found = written(members.select("rep", "component").distinct(), "components", total)
        if not total:
            return found
        if sets is None:
            n_sets = found.count()
            wanted = written(reps.select("rep", "doc_id", F.col("n").alias("size"), "k1", "k2").join(small(found.select("rep"), n_sets), "rep"), "wanted", n_sets)
            sets = _stored(spark, texts, wanted, n_sets, width)
            keyed = written(small(sets, WIDE * n_sets).join(reps.select("rep", *[F.col("bands")[j].alias(b) for j, b in enumerate(BAND_KEYS)]), "rep").withColumnRenamed("size", "n"), "keyed", n_sets)
            forget(wanted)
        if hubs_each:  # of a cell the smallest component's first member
            sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep"), F.first("held").alias("held"))
            hubs = sizes.groupBy("band", F.pmod(F.xxhash64("component"), F.lit(hubs_each)).alias("cell")).agg(F.min(F.struct("c", "rep", "component")).alias("hub"), F.first("held").alias("held"))
            hubs = written(hubs.select("band", F.col("hub.rep").alias("hub"), F.col("hub.component").alias("hub_component"), "held"), "hubs", total)
            pool = _near(hubs, members, total, *((reps, n_reps) if hubs_each == 1 else (keyed, n_sets)), percent, hubs_each == 1)
        else:
            few = members.filter(F.col("held") <= SMALL)
            pool = _near(few.select("band", F.col("rep").alias("hub"), F.col("component").alias("hub_component"), "held"), few, total, keyed, n_sets, percent, False, behind=True)
            hot = members.filter(F.col("held") > SMALL).select("rep", "component").distinct().join(small(sets.select("rep", "path", "at", "size"), 2 * n_sets), "rep")
            hot = written(hot, "hot", n_sets)
            if not hot.isEmpty():
                pool = pool.unionByName(_estimated(passage_pairs(hot, percent), keyed, percent)).dropDuplicates(["a", "b"])
        found = _decided(written(pool, "pool", total), sets, found, percent, n_sets)
        if hubs_each:  # the hubs have met all members of their buckets and leave them
            rest = members.join(small(hubs.select("band", F.col("hub").alias("rep")), total), ["band", "rep"], "left_anti").select("rep", "k", "band")
            members = rest.join(small(found, n_sets), "rep")
    return found


def _near(hubs: DataFrame, members: DataFrame, total: int, signed: DataFrame, n_signed: int, percent: int, coarse: bool, behind: bool = False) -> DataFrame:
    """(a, b, ca, cb, guess) of hubs and members of a bucket with an estimate near the threshold.

    Hubs of hot buckets (at most 1/HOT_SHARE of them, up to 64 hubs each) are broadcast, so their members
    stay where they are; of few members, total in all, all hubs are. behind: only members behind the hub, and
    no bucket is hot.
    """
    signature, bits, margin, own = (SIGNATURE, B, MARGIN, []) if coarse else (FINE_SIGNATURE, 1, FINE_MARGIN, BAND_KEYS)
    signed = small(signed.select("rep", "n", *signature, *own), WIDE * n_signed)
    hub_side = hubs.join(small(signed.withColumnsRenamed({"rep": "hub", "n": "hub_n"}), WIDE * n_signed), "hub")
    guess = estimate("h", "m", signature, bits)
    near = (F.col("h.band") == F.col("m.band")) & (F.col("h.hub_component") != F.col("m.component")) & (100 * F.least("h.hub_n", "m.n") >= percent * F.greatest("h.hub_n", "m.n")) & (guess >= percent / 100 - margin)
    if behind:
        near &= F.col("h.hub") < F.col("m.rep")
    if own:  # the first band that both share
        at = F.lit(BANDS)
        for j in reversed(range(BANDS)):
            at = F.when(F.col(f"h.b{j}") == F.col(f"m.b{j}"), F.lit(j)).otherwise(at)
        near &= at == F.col("m.k")
    few = WIDE * total <= BROADCAST_ROWS
    cut = None if behind or few else max(2, int(total * HOT_SHARE))
    out = None
    for hot in (None,) if cut is None else (True, False):
        part = lambda df, hot=hot: df if hot is None else df.filter(F.col("held") >= cut if hot else F.col("held") < cut)
        left = part(hub_side).drop("held").alias("h")
        met = (F.broadcast(left) if hot or few else left).join(part(members).join(signed, "rep").alias("m"), near)
        turned = F.col("hub") > F.col("rep")
        rows = met.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"), F.when(turned, F.col("component")).otherwise(F.col("hub_component")).alias("ca"), F.when(turned, F.col("hub_component")).otherwise(F.col("component")).alias("cb"), guess.alias("guess"))
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["a", "b"])


def _estimated(pairs: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """pairs with their guess: those that share a band and whose estimate is near the threshold."""
    for end, side in (("a", "h"), ("b", "m")):
        own = keyed.select(F.col("rep").alias(end), F.struct(*FINE_SIGNATURE, *BAND_KEYS).alias(side))
        pairs = pairs.join(own, end)
    shared = F.lit(False)
    for b in BAND_KEYS:
        shared |= F.col(f"h.{b}") == F.col(f"m.{b}")
    guess = estimate("h", "m", FINE_SIGNATURE, 1)
    return pairs.filter(shared & (guess >= percent / 100 - FINE_MARGIN)).select("a", "b", "ca", "cb", guess.alias("guess"))


def _decided(pool: DataFrame, sets: DataFrame, found: DataFrame, percent: int, n_sets: int) -> DataFrame:
    """found after all candidates of the pool are decided.

    The most similar pairs of each component are confirmed first, 1, then 32, then 1024 at a time; pairs
    whose ends a confirmed link has joined meanwhile need no test.
    """
    picked = 1
    while waiting := pool.count():
        if waiting <= FEW:
            picked = waiting  # one job is cheaper than the tests it may save
        best = F.max(F.struct("guess", "a", "b", "ca", "cb")).alias("best")
        cell = F.pmod(F.xxhash64("a", "b"), F.lit(picked)).alias("cell")
        pick = pool
        if picked < waiting:
            pick = pool.groupBy("ca", cell).agg(best).select("best.*").unionByName(pool.groupBy("cb", cell).agg(best).select("best.*")).dropDuplicates(["a", "b"])
        tested = _confirmed(sets, pick.drop("guess"), percent, waiting, n_sets)
        moved = components(tested.filter("linked"), "ca", "cb", waiting)
        before, found = found, written(_moved(found, moved, "component", waiting), "components", n_sets)
        old = (before, tested, moved, pool)
        if pick is not pool:
            rest = _moved(_moved(pool.join(tested.select("a", "b"), ["a", "b"], "left_anti"), moved, "ca", waiting), moved, "cb", waiting)
            pool, picked = written(rest.filter("ca <> cb"), "pool", waiting), picked * 32
        forget(*old)
        if pick is old[3]:
            break
    return found


def _moved(rows: DataFrame, moved: DataFrame, column: str, most: int) -> DataFrame:
    """rows with the column's components replaced by those that they joined; moved has ``most`` rows at most."""
    return rows.join(small(moved.select(F.col("node").alias(column), F.col("component").alias("__to")), most), column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(*rows.columns)


def _stored(spark, texts: DataFrame, wanted: DataFrame, n: int, width: int) -> DataFrame:
    """Where the full sets of the wanted (rep, doc_id, size, k1, k2) lie, with fine signatures, from a second reading."""
    words = spark.sparkContext.broadcast(bloom.build(wanted, "doc_id", n))
    rows = texts.mapInArrow(storer(width, words, new_folder(spark, "sets")), _PLACE + ", ".join(f"{x} long" for x in FINE_SIGNATURE))
    names = ["doc_id", "size", "k1", "k2"]  # one doc_id may have several texts
    out = written(rows.dropDuplicates(names).join(small(wanted, n), names).select("rep", "path", "at", "size", *FINE_SIGNATURE), "sets", n)
    words.unpersist()
    return out


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int, rows: int, n_sets: int) -> DataFrame:
    """pairs with linked; n_sets counts the sets, filter's extras aside."""
    for end in "ab":
        place = sets.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("path", "at", "size")])
        pairs = pairs.join(small(place, 2 * n_sets), end)
    return written(pairs, "tested", rows, confirmer(percent), "a long, b long, ca long, cb long, linked boolean")
