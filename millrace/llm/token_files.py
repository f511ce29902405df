"""Operator 2: token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of whole documents in ascending doc_id order, as little-endian unsigned 32-bit
integers, cut into zstandard frames of FRAME bytes. Two skippable frames follow: the document index
(doc_id, first byte, bytes), and the seek table (compressed size, size and xxh64 checksum of each
frame) with a nine-byte footer. Any zstandard tool can unpack a file; a reader that wants some
documents reads the tail and then only their frames.

Files are written under names of their own per attempt, and only the manifest of successful tasks
names files, so a lost executor leaves nothing half-written in a result.

Edge cases: a null text is empty and has the end id alone; rows that repeat a doc_id come in order of
their text's hash; rows without a doc_id come first; extra columns are left out; an empty table gives
no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import scan, tokens
from ._spark import new_folder, opened

FRAME = 1 << 18
LEVEL = 1
# Magic numbers of the seekable zstandard format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
_ENTRY, _FOOT, _HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
_DOC = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("first", "<i8"), ("size", "<i8")])


class Writer:
    """Appends documents to one open binary file."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL) -> None:
        self.out, self.frame = out, frame
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.waiting, self.held, self.total = [], 0, 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, self.total, len(raw)))
        self.total += len(raw)
        at = 0
        while at < len(raw):
            piece = raw[at : at + self.frame - self.held]
            self.waiting.append(piece)
            self.held += len(piece)
            at += len(piece)
            if self.held == self.frame:
                self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.waiting)
        done = self.pack.compress(raw)
        self.out.write(done)
        self.frames.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.pack.compress(np.array(self.docs, _DOC).tobytes())
        self.out.write(_HEAD.pack(SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(_ENTRY.pack(*x) for x in self.frames)
        self.out.write(_HEAD.pack(SKIPPABLE_SEEK, len(table) + _FOOT.size) + table + _FOOT.pack(len(self.frames), 0x80, SEEKABLE))


class Reader:
    """Random access to the documents of one file; ``src`` can seek."""

    def __init__(self, src, size: int) -> None:
        self.src = src
        src.seek(size - _FOOT.size)
        n, _, magic = _FOOT.unpack(src.read(_FOOT.size))
        if magic != SEEKABLE:
            raise ValueError("not a file of seekable frames")
        start = size - _FOOT.size - n * _ENTRY.size
        src.seek(start)
        table = np.frombuffer(src.read(n * _ENTRY.size), "<u4").reshape(n, 3)
        self.packed_at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.at = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        self.sums = table[:, 2]
        src.seek(int(self.packed_at[-1]))
        magic, length = _HEAD.unpack(src.read(_HEAD.size))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the document index is missing")
        self.unpack = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpack.decompress(src.read(length)), _DOC)
        self.frames_read, self._last = 0, (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.src.seek(int(self.packed_at[k]))
            raw = self.unpack.decompress(self.src.read(int(self.packed_at[k + 1] - self.packed_at[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.sums[k]):
                raise ValueError(f"frame {k} fails its checksum")
            self.frames_read += 1
            self._last = (k, raw)
        return self._last[1]

    def document(self, k: int) -> bytes:
        """The raw ids of the k-th document; only the frames that hold it are unpacked."""
        a = int(self.docs["first"][k])
        b, out = a + int(self.docs["size"][k]), []
        f = int(np.searchsorted(self.at, a, "right")) - 1
        while a < b:
            raw = self._frame(f)
            low = a - int(self.at[f])
            out.append(raw[low : low + b - a])
            a += len(out[-1])
            f += 1
        return b"".join(out)


_ROW = pa.schema([("path", pa.string()), ("lowest", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32())])
_MANIFEST = "path string, lowest long, n_docs long, n_tokens long, part int"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Encode and write every document; the manifest: one row per file, in order of ``part``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    end = struct.pack("<I", end_id)

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokenizer)
        writer, path, lowest, count, part, out = None, "", None, 0, 0, None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            offsets, _ = scan.buffers(texts)
            for a, b in scan.slices(offsets, 1 << 21):
                for doc_id, raw in zip(ids.slice(a, b - a).to_pylist(), encoder.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    if writer is None:
                        part = batch.column(2)[0].as_py()
                        path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex[:12]}.zst"
                        files, at = opened(path)
                        files.create_dir(at.rpartition("/")[0], recursive=True)
                        out = files.open_output_stream(at, compression=None)
                        writer, lowest = Writer(out), doc_id
                    writer.add(doc_id, raw + end)
                    count += 1
        if writer is not None:
            writer.close()
            out.close()
            row = {"path": path, "lowest": lowest, "n_docs": count, "n_tokens": writer.total // 4, "part": part}
            yield pa.RecordBatch.from_pylist([row], schema=_ROW)

    return dealt.mapInArrow(run, _MANIFEST)


def read(spark: SparkSession, manifest: Iterable, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents, read back from the files.

    manifest: the collected rows of write(), one per file, whatever the number of documents.
    """
    files, start = [], 0
    for x in sorted(manifest, key=lambda x: x["part"]):
        files.append((x["path"], start))
        start += x["n_tokens"]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    if not files:
        return spark.createDataFrame([], kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                store, at = opened(path)
                with store.open_input_file(at) as src:
                    reader = Reader(src, src.size())
                    for low in range(0, len(reader.docs), 2000):
                        some = reader.docs[low : low + 2000]
                        raws = [reader.document(k) for k in range(low, low + len(some))] if ids else None
                        sums = [zlib.crc32(x) for x in raws] if ids else [zlib.crc32(reader.document(k)) for k in range(low, low + len(some))]
                        out = pd.DataFrame({"doc_id": pd.array(some["doc_id"], "Int64"), "start": base + some["first"] // 4, "n_tokens": some["size"] // 4, "ids_crc32": np.array(sums, np.int64)})
                        out.loc[some["known"] == 0, "doc_id"] = pd.NA
                        if ids:
                            out["ids"] = [np.frombuffer(x, "<u4").astype(np.int64) for x in raws]
                        yield out

    return spark.createDataFrame(files, "path string, base long").repartition(len(files)).mapInPandas(run, kind)


def round_trip(docs: DataFrame, tokenizer: str = tokens.WORD_BPE, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write all documents, then return what the files hold."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    return read(spark, write(docs, folder, tokenizer, end_id).collect())
