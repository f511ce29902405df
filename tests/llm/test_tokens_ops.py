"""Token files, packing and merge-dropout."""

import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from millrace.llm import merge_dropout, packing, token_files, tokens

DOCS = "doc_id long, text string"
ODD = ["", None, " lead\n\ntwo  spaces ", "a<|endoftext|> B<|ENDOFTEXT|>", "don't WE'LL 12 345 x1y2", "É́ ΟΔΟΣ İ ß ﬁ 가", "tab\tx\x0by\x1cz w\r\n", "Ärger, Straße!! ***", "日本語 🙂", "x" * 5000, "!!", "J̌ ǰ", "naïve-café.,;:", "ÀÖØöøÿ µª"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tokens.WORD_BPE))


def test_encoder(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PARTS", 30)  # the cache starts anew again and again
    encoder = tokens.Encoder(public_tokenizers.path(tokens.WORD_BPE))
    for some in (ODD[:7], ODD[7:], ODD, [" ".join(x or "" for x in ODD)]):
        for text, raw in zip(some, encoder.encode(some), strict=True):
            assert tokens.ids(raw).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_other_tokenizers_are_refused():
    for name in ("byte_bpe_50k.json",):
        with pytest.raises(ValueError):
            tokens.Encoder(public_tokenizers.path(name))


def test_whole_tables_have_the_librarys_ids(spark, tokenizer):
    encoder = tokens.Encoder(public_tokenizers.path(tokens.WORD_BPE))
    for table, column in (("documents", "text"), ("pages", "html"), ("conversations", "text"), ("benchmark", "text")):
        texts = [r[0] or "" for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(column).collect()]
        for text, raw, want in zip(texts, encoder.encode(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert tokens.ids(raw).tolist() == want.ids, text[:80]


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = packing.pack(docs).selectExpr("sum(length) as used", "max(sequence_id) + 1 as n").first()
    assert r.n > 10 and r.used >= 0.98 * r.n * packing.CAPACITY


def docs_of(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "some words here " * k) for k in range(40)] + [(7777, "word " * 9000)]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", start int").repartition(5)


def test_files(spark, tokenizer, tmp_path):
    rows, docs = docs_of(spark)
    manifest = token_files.write(docs, f"file://{tmp_path}/t", tokens.WORD_BPE, 2, partitions=3).collect()
    got = sorted(token_files.read(spark, manifest, ids=True).collect())
    start = 0
    for r, (i, text) in zip(got, sorted(rows), strict=True):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want), zlib.crc32(want.tobytes())) and r.ids == want.tolist()
        start += len(want)
    again = sorted(token_files.round_trip(spark.createDataFrame([(None, "b"), (1, "x"), (1, "x"), (1, "y")], DOCS)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in again] == [None, 1, 1, 1]
    assert token_files.round_trip(docs.limit(0)).count() == 0


def test_file_format():
    out = io.BytesIO()
    writer = token_files.Writer(out, frame=100)
    parts = [bytes([k]) * (k * 8) for k in range(30)]
    for k, p in enumerate(parts):
        writer.add(k, p)
    writer.close()
    raw = out.getvalue()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(parts)
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert [reader.document(k) for k in (29, 0, 12)] == [parts[29], b"", parts[12]]
    lazy = token_files.Reader(io.BytesIO(raw), len(raw))
    lazy.document(3)
    assert lazy.frames_read <= 2 < len(writer.frames)
    bad = bytearray(raw)
    bad[12] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(io.BytesIO(bytes(bad)), len(bad)).document(1)


def test_patterns():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 200) for _ in range(rng.randrange(1, 30))}
        found = packing.patterns(histogram, 100)
        held = Counter()
        for pack, count in found:
            assert sum(pack) <= 100 and list(pack) == sorted(pack, reverse=True)
            for x in pack:
                held[x] += count
        assert held == Counter(histogram)
        places = packing.blocks(found)
        assert sum(len(b) for b in places.values()) == sum(len(p) for p, _ in found)
    assert packing.patterns({}, 100) == []
    assert packing.patterns({60: 2, 40: 3}, 100) == [((60, 40), 2), ((40,), 1)]


def test_pack(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 7)
    rows, docs = docs_of(spark)
    got = packing.pack(docs, capacity=64, ids=True).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, ids in want.items():
        assert [x for r in sorted(by_doc[i], key=lambda r: r.start) for x in r.ids] == ids
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], DOCS)).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


MARKED = ["", "  lead", "a   b ", "a\nb\n\n  c", "日本語です 🙂", "x" * 200 + " y", "▁a ▁", "\t tab", "a" + " " * 30 + "b", " ", "the theory of thermal things " * 20]


def test_plain_encoding_is_the_librarys():
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(merge_dropout.MODEL))
    encoder = merge_dropout.Encoder(public_tokenizers.path(merge_dropout.MODEL), 0.0, 1, 4)
    for text, ids in zip(MARKED, encoder.encode(list(range(len(MARKED))), MARKED), strict=True):
        assert encoder.decode(ids) == text.encode()
        if "▁" not in text:
            assert ids.tolist() == own.encode(text)


def test_dropout(spark):
    rows = [(k, t) for k, t in enumerate(MARKED)] + [(50, None), (None, "the theory")]
    docs = spark.createDataFrame(rows, DOCS)
    plain = {r.doc_id: r for r in merge_dropout.encode(docs, rate=0.0).collect()}
    varied = {r.doc_id: r for r in merge_dropout.encode(docs, rate=0.4, variants=5, ids=True).collect()}
    same = {r.doc_id: r for r in merge_dropout.encode(docs.repartition(3), rate=0.4, variants=5, ids=True).collect()}
    other = {r.doc_id: r for r in merge_dropout.encode(docs, rate=0.4, variants=5, seed=2).collect()}
    assert all(r.lossless for x in (plain, varied, other) for r in x.values()) and varied == same
    assert varied[10].n_pieces > plain[10].n_pieces and varied[10].ids_crc32 != other[10].ids_crc32
    words = {tuple(varied[10].ids[k : k + 3]) for k in range(0, len(varied[10].ids) - 3)}
    assert len(words) > 20  # the repeated sentence is cut in several ways
    assert merge_dropout.encode(docs.limit(0)).count() == 0


_64 = (1 << 64) - 1


def spread(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor & _64
    return x


def slowly(own, part, rate, doc_id, number, seed=1):
    """The pieces of one occurrence by scanning all neighbours for each merge, from the library's scores."""
    golden = 0x9E3779B97F4A7C15
    who = spread((doc_id * golden + seed) & _64)
    key = spread(spread((who + number) & _64) ^ who)

    def score(a, b):
        name = a[0] + b[0]
        i = own.piece_to_id(name)
        if own.is_unknown(i) or own.is_byte(i) or own.is_control(i) or a[0][0] == "<" == b[0][0]:
            return None
        place = spread((((a[1] << 42) ^ (b[1] << 21) ^ b[2]) + 1) * golden & _64)
        return None if spread((key + place) & _64) >> 11 < rate * 2.0**53 else own.get_score(i)

    row = [(x.replace(" ", "▁"), k, k + 1) for k, x in enumerate(part)]
    while True:
        found = [(-s, k) for k, (a, b) in enumerate(zip(row, row[1:], strict=False)) if (s := score(a, b)) is not None]
        if not found:
            return [x[0] for x in row]
        k = min(found)[1]
        row[k : k + 2] = [(row[k][0] + row[k + 1][0], row[k][1], row[k + 1][2])]


def test_dropout_equals_a_plain_scan():
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(merge_dropout.MODEL))
    rng = random.Random(12)
    words = ["".join(rng.choice("theraingosul") for _ in range(rng.choice([1, 3, 8, 10, 11, 17, 30, 47, 48, 70, 200]))) for _ in range(60)]
    for rate in (0.1, 0.5):
        encoder = merge_dropout.Encoder(public_tokenizers.path(merge_dropout.MODEL), rate, 1, 0)
        texts = [" ".join(rng.choices(words, k=25)) for _ in range(8)]
        for _ in range(2):  # fresh, then from the trees
            for doc_id, ids in enumerate(encoder.encode(list(range(8)), texts)):
                want = [x for n, w in enumerate(texts[doc_id].split(" ")) for x in slowly(own, " " + w, rate, doc_id, n)]
                assert [own.id_to_piece(int(i)) for i in ids] == want


def test_side_by_side_equals_the_heap(monkeypatch):
    path = public_tokenizers.path(merge_dropout.MODEL)
    parts = ["".join(random.Random(k).choice("theraingos é🙂") for _ in range(k % 47 + 1)) for k in range(300)]
    texts = [" ".join(parts), "a" * 700, "".join(parts).replace(" ", ""), "日本語" * 99]
    for rate in (0.0, 0.3):
        beside = merge_dropout.Encoder(path, rate, 1, 0).encode([1, 2, 3, 4], texts)
        monkeypatch.setattr(merge_dropout, "WIDE", 28)  # the widest runs go to the heap
        heap = merge_dropout.Encoder(path, rate, 1, 0).encode([1, 2, 3, 4], texts)
        monkeypatch.undo()
        assert [x.tolist() for x in beside] == [x.tolist() for x in heap]


def test_long_texts_in_blocks(spark, monkeypatch):
    texts = [" lead and  two " * 40 + "   ", "x" * 900 + " y z", " " * 500, "a" + " " * 300, " b", *MARKED]
    for text in texts:
        for size in (1, 7, 64):
            monkeypatch.setattr(merge_dropout, "BLOCK", size)
            some = list(merge_dropout.blocks(text))
            assert "".join(x for x, _ in some) == " " + text
            assert [p for x, _ in some for p in merge_dropout._split(x[1:])] == merge_dropout._split(text)
            encoder = merge_dropout.encoder()
            assert [i for x, n in some for i in encoder.encode([5], [x], [n])[0].tolist()] == encoder.encode([5], [text])[0].tolist() or not text
    monkeypatch.undo()
    big = "the theory of thermal things, 日本語 and more. " * 90_000 + "0123456789abcdef" * 30_000  # 5 MB
    rows = [(1, big), (2, "small"), (1, big[: merge_dropout.BLOCK + 9])]
    got = merge_dropout.encode(spark.createDataFrame(rows, DOCS).repartition(1), ids=True).collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got) and len(got) == 3
    whole = merge_dropout.encoder().encode([1], [big])[0]
    assert max(got, key=lambda r: r.n_pieces).ids == whole.tolist()


def test_skips_come_at_the_rate():
    """One word of a single merge in 300 documents: it stays whole but for the share of the rate."""
    encoder = merge_dropout.encoder()
    pieces = encoder.pieces
    word = next(x[1:] for x in pieces.names if len(x) == 2 and x[0] == "▁" and x[1].isalpha())
    found = encoder.encode(list(range(300)), [" ".join([word] * 20)] * 300)
    whole = sum(x.tolist().count(pieces.ids["▁" + word]) for x in found)
    assert abs(1 - whole / 6000 - merge_dropout.RATE) < 0.02
    long = encoder.encode(list(range(300)), ["internationalisation"] * 300)
    assert len({tuple(x.tolist()) for x in long}) > 40


def test_each_occurrence_draws_anew(monkeypatch):
    encoder = merge_dropout.encoder()  # the production parameters
    text = " ".join(["theory"] * 50 + ["internationalisation"] * 50 + ["日本語"])
    many = encoder.encode(list(range(100)), [text] * 100)
    assert all(encoder.decode(x) == text.encode() for x in many)
    short, long = Counter(), Counter()
    for ids in many:
        names = [encoder.pieces.names[i] for i in ids]
        starts = [k for k, x in enumerate(names) if x.startswith("▁")]
        cuts = [tuple(names[a:b]) for a, b in zip(starts, [*starts[1:], len(names)], strict=True)]
        assert len(cuts) == 101
        short.update(cuts[:50])
        long.update(cuts[50:100])
    assert len(short) > 10 and len(long) > 50  # two keys a part gave two at most
    plain = merge_dropout.Encoder(public_tokenizers.path(merge_dropout.MODEL), 0.0, 1, 0).encode([0], ["theory"])[0]
    share = short[tuple(encoder.pieces.names[i] for i in plain)] / 5000
    assert 0.3 < share < 0.95
    # cached and direct runs agree, whatever the cache holds
    monkeypatch.setattr(merge_dropout, "TREE", 0)
    direct = merge_dropout.Encoder(public_tokenizers.path(merge_dropout.MODEL), merge_dropout.RATE, merge_dropout.SEED, merge_dropout.VARIANTS)
    rows = [*MARKED, text]
    assert [x.tolist() for x in encoder.encode(list(range(len(rows))), rows)] == [x.tolist() for x in direct.encode(list(range(len(rows))), rows)]
    monkeypatch.undo()
    monkeypatch.setattr(merge_dropout, "MOST_CANDIDATES", 10)  # the cache starts anew again and again
    assert [encoder.encode([k], [x])[0].tolist() for k, x in enumerate(rows)] == [x.tolist() for x in direct.encode(list(range(len(rows))), rows)]
