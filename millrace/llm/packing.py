"""Operator 7: packing token sequences shortest-pack-first over the histogram of lengths.

Each document is cut into full pieces of ``capacity`` ids and a rest. Only the histogram of piece
lengths (at most ``capacity`` rows) reaches the driver: lengths are placed longest first, each into
the pattern with the fewest ids so far, patterns being kept with counts. The patterns become blocks
of ranks per length, and pieces meet them by their rank among the pieces of their length. Ranks are
counted in cells of bounded size, so a length that holds most pieces is dealt out.

Edge cases: a null text is empty, and a document without ids still has its end id; rows that repeat a
doc_id are packed each; rows without a doc_id as well; ties are broken by doc_id, start and checksum;
extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import scan, tokens
from ._spark import staged

CAPACITY = 2048
#: Pieces a cell aims at; a cell is the unit in which ranks are counted.
CELL = 10_000

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str = tokens.WORD_BPE, end_id: int = 1, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens[, ids])."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            offsets, _ = scan.buffers(texts)
            for a, b in scan.slices(offsets, 1 << 21):
                rows, starts, sums, sizes, whole, kept = [], [], [], [], [], []
                for row, raw in enumerate(encoder.encode(texts.slice(a, b - a).to_pylist()), a):
                    raw += end
                    for at in range(0, len(raw), 4 * capacity):
                        piece = raw[at : at + 4 * capacity]
                        rows.append(row)
                        starts.append(at // 4)
                        sizes.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                        whole.append(len(raw) // 4)
                        if ids:
                            kept.append(np.frombuffer(piece, "<u4").astype(np.int64))
                extra = [pa.array(kept, pa.list_(pa.int64()))] if ids else []
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), *[pa.array(x, pa.int64()) for x in (starts, sizes, sums, whole)], *extra], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _PIECE + ", ids array<long>" * ids)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, longest first; number of such packs) that hold the whole histogram."""
    packs: Counter[tuple[int, ...]] = Counter()
    totals: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if totals and totals[0][0] + length <= capacity:
                total, pack = heapq.heappop(totals)
                have = packs.pop(pack)
                used = min(have, left)
                if have > used:
                    packs[pack] = have - used
                    heapq.heappush(totals, (total, pack))
                grown = (*pack, length)
            else:
                total, grown, used = 0, (length,), left
            if grown not in packs and total + length < capacity:
                heapq.heappush(totals, (total + length, grown))
            packs[grown] += used
            left -= used
    return sorted(packs.items(), reverse=True)


def blocks(found: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset); ranks of a block map to sequences in a row."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for pack, count in found:
        offset = 0
        for length in pack:
            out[length].append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    found = staged(found, "pieces")
    counts = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    total = sum(x["count"] for x in counts)
    table = blocks(patterns({x["length"]: x["count"] for x in counts}, capacity))
    cells = max(1, -(-total // CELL))
    celled = found.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)))
    sizes = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "cell", before.alias("before"))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = celled.withColumn("rank", F.row_number().over(order)).join(sizes, ["length", "cell"])
    ranked = ranked.select(*found.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))
    names = found.columns
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, block = np.flatnonzero(length == x), table[int(x)]
                k = np.searchsorted(block[:, 0], rank[at], "right") - 1
                sequence[at] = block[k, 1] + rank[at] - block[k, 0]
                offset[at] = block[k, 2]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, kind)


def pack(docs: DataFrame, tokenizer: str = tokens.WORD_BPE, end_id: int = 1, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every document's pieces with their places."""
    return packed(pieces(docs, tokenizer, end_id, capacity, ids), capacity)
