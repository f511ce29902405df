"""Operator 3: exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are hashed in chunks, independent of each other, modulo two primes below 2**31;
chunk hashes combine by length-shifted arithmetic, H(AB) = H(A) * r**len(B) + H(B). Texts longer than
HUGE bytes are cut into pieces that are hashed as rows of their own, on any executor, and combined
after a shuffle of piece hashes only. Equal fingerprints then undergo a chunkwise comparison of the
texts themselves: chunk by chunk, the smallest and the largest text of a group must agree, which is
a partial aggregation however large the group. A group that disagrees is split by content.

Edge cases: null counts as the empty text, and empty texts are copies of each other; rows that repeat
a doc_id are copies like any others, of which one row is marked as kept; a row without a doc_id takes
part and loses against any row with one; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bloom, scan
from ._spark import forget, join_groups, staged
from .bloom import rows_left, rows_named

PRIMES = (2147483647, 2147483629)
RADIX = (911382323, 972663749)
CHUNK = 1 << 14
#: Texts beyond this many characters are cut into pieces of as many characters and hashed as rows.
HUGE = 1 << 22
#: Characters a chunk in the comparison.
COMPARED = 1 << 18


def _powers(prime: int, radix: int, n: int) -> np.ndarray:
    """radix ** (n - 1), ..., radix, 1 modulo prime."""
    out, block = np.ones(1, np.uint64), 1
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(radix, block, prime)) % np.uint64(prime), out])
        block = len(out)
    return out[len(out) - n :]


def combine(a: int, b: int, length_b: int, prime: int, radix: int) -> int:
    """The hash of AB from the hashes of A and B: shift A by B's length, then add."""
    return (a * pow(radix, length_b, prime) + b) % prime


def chunk_hash(block: np.ndarray, powers: np.ndarray, prime: int) -> int:
    """The polynomial hash of at most CHUNK bytes; bytes count from 1, so leading zeros tell."""
    return int(((block.astype(np.uint64) + np.uint64(1)) * powers[len(powers) - len(block) :]).sum(dtype=np.uint64) % np.uint64(prime)) if len(block) else 0


def fingerprint(data: np.ndarray, primes=PRIMES, radix=RADIX) -> tuple[int, ...]:
    """Fingerprints of all bytes, chunk by chunk."""
    out = []
    for p, r in zip(primes, radix, strict=True):
        powers, shift, total = _table(p, r), pow(r, CHUNK, p), 0
        for at in range(0, len(data), CHUNK):
            block = data[at : at + CHUNK]
            total = (total * (shift if len(block) == CHUNK else pow(r, len(block), p)) + chunk_hash(block, powers, p)) % p
        out.append(total)
    return tuple(out)


_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _table(prime: int, radix: int) -> np.ndarray:
    if (prime, radix) not in _TABLES:
        _TABLES[prime, radix] = _powers(prime, radix, CHUNK)
    return _TABLES[prime, radix]


def _hasher(primes, radix):
    """All columns but ``text``, then f1, f2 and the number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = scan.buffers(batch.column(batch.schema.get_field_index("text")))
            found = np.array([fingerprint(data[a:b], primes, radix) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, len(primes))
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.diff(offsets))], names=[*names, "f1", "f2", "n_bytes"])

    return run


def _combined(parts: DataFrame, primes, radix) -> DataFrame:
    """Piece hashes of huge texts, folded in order; a text of 1 TB has some 250,000 pieces."""

    def fold(rows):
        for x in rows:
            out = [[], []]
            for pieces in x["pieces"]:
                for k, (p, r) in enumerate(zip(primes, radix, strict=True)):
                    total = 0
                    for piece in sorted(pieces, key=lambda y: y["no"]):
                        total = combine(total, piece["f1" if k == 0 else "f2"], piece["n_bytes"], p, r)
                    out[k].append(total)
            x = x.drop(columns="pieces")
            x["f1"], x["f2"] = out
            yield x[["row", "doc_id", "sha", "f1", "f2", "n_bytes"]]

    grouped = parts.groupBy("row", "doc_id", "sha").agg(F.collect_list(F.struct("no", "f1", "f2", "n_bytes")).alias("pieces"), F.sum("n_bytes").alias("n_bytes"))
    return grouped.mapInPandas(fold, "row long, doc_id long, sha string, f1 long, f2 long, n_bytes long")


def fingerprints(docs: DataFrame, primes=PRIMES, radix=RADIX, huge: int = HUGE) -> DataFrame:
    """(doc_id, sha, f1, f2, n_bytes) of every row; text null counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    hasher = _hasher(primes, radix)
    plain = rows.filter(F.length("text") <= huge).select("doc_id", "sha", "text").mapInArrow(hasher, "doc_id long, sha string, f1 long, f2 long, n_bytes long")
    n = F.ceil(F.length("text") / F.lit(huge)).cast("int")
    pieces = rows.filter(F.length("text") > huge).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "sha", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * huge + 1, F.lit(huge)))).alias("no", "text"))
    pieces = pieces.repartition("row", "no").mapInArrow(hasher, "row long, doc_id long, sha string, no int, f1 long, f2 long, n_bytes long")
    return plain.unionByName(_combined(pieces, primes, radix).drop("row"))


KEYS = ["f1", "f2", "n_bytes", "content"]


def groups(docs: DataFrame, primes=PRIMES, radix=RADIX, huge: int = HUGE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document, dropped ones too."""
    out = _verdicts(docs, primes, radix, huge).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def _verdicts(docs: DataFrame, primes=PRIMES, radix=RADIX, huge: int = HUGE) -> DataFrame:
    """(doc_id, sha, times, keep_id, size) of each doc_id and text."""
    prints = staged(fingerprints(docs, primes, radix, huge).groupBy("doc_id", "sha", "f1", "f2", "n_bytes").agg(F.count(F.lit(1)).alias("times")), "prints")
    total = prints.count()
    split = _unequal(docs, prints, total, primes, radix, huge)
    if split.isEmpty():
        keyed = prints.withColumn("content", F.lit(""))
    else:
        mark = split.select("f1", "f2", "n_bytes", F.lit(True).alias("split"), "group_size")
        keyed = join_groups(prints, mark, ["f1", "f2", "n_bytes"], ["split"], total, F.xxhash64("doc_id", "sha"))
        keyed = keyed.withColumn("content", F.when(F.col("split"), F.col("sha")).otherwise(F.lit(""))).drop("split")
    found = keyed.groupBy(*KEYS).agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("size"), F.count(F.lit(1)).alias("group_size"))
    return join_groups(keyed, found, KEYS, ["keep_id", "size"], total, F.xxhash64("doc_id", "sha")).select("doc_id", "sha", "times", "keep_id", "size")


def _unequal(docs: DataFrame, prints: DataFrame, total: int, primes, radix, huge: int) -> DataFrame:
    """Fingerprints shared by texts that differ, found by comparing the texts chunk by chunk."""
    spark = docs.sparkSession
    keys = ["f1", "f2", "n_bytes"]
    many = staged(prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").withColumn("many", F.lit(True)), "many")
    members = join_groups(prints.select("doc_id", "sha", *keys), many, keys, ["many"], total, F.xxhash64("doc_id", "sha"), "inner").drop("many")
    members = staged(members.select(F.xxhash64("doc_id", "sha").alias("row"), *keys, "sha", "doc_id"), "members")
    # the texts of these rows only: the filter is bounded and merely saves reading others
    words = spark.sparkContext.broadcast(bloom.build(members, "row", members.count()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", F.sha2("text", 256)).alias("row"))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["text", "row"]).filter(pa.array(bloom.test(words.value, batch.column(2).to_numpy(zero_copy_only=False))))

    near = rows.mapInArrow(sieve, "text string, row long")
    texts = near.join(members.select("row", *keys).dropDuplicates(["row"]), "row")
    n = F.greatest(F.ceil(F.length("text") / F.lit(COMPARED)).cast("int"), F.lit(1))
    chunks = texts.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * COMPARED + 1, F.lit(COMPARED)))).alias("no", "chunk"))
    compared = chunks.groupBy(*keys, "no").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    bad = compared.filter("low <> high").select(*keys).distinct()
    out = staged(bad.join(many.select(*keys, "group_size"), keys), "split")
    forget(many, members)
    words.unpersist()
    return out


def keep(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all columns as they are: that with the largest doc_id, and of
    rows that share that too the one whose other columns have the smallest hash."""
    found = staged(_verdicts(docs), "verdicts")
    named = found.select("doc_id", F.col("sha").alias("mark"), "times", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
    gone, again = (named.filter(x).select("doc_id", "mark") for x in ("not stays", "stays and times > 1"))
    n_gone, n_again = named.agg(F.expr("count_if(not stays)"), F.expr("count_if(stays and times > 1)")).first()
    mark = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    if not n_again:
        return rows_left(docs, gone, mark, n_gone)
    out = rows_left(docs, gone.unionByName(again), mark, n_gone + n_again)
    rows = rows_named(docs, again, mark, n_again)
    order = F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))
    return out.unionByName(rows.groupBy("id", "mark").agg(F.min_by("row", order).alias("row")).select("row.*"))
