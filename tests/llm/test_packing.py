import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loanlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_places_every_piece_once_and_packs_as_well_as_best_fit():
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 50, 64):
        lengths = [int(x) for x in rng.integers(1, capacity + 1, 700)]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used, ranks = {}, {n: [] for n in counts}
        for n, first, count, each, sequence, offset in packing.plan_best_fit(counts, capacity):
            for k in range(count):
                ranks[n].append(first + k)
                used.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
        assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
        for spans in used.values():
            spans.sort()
            at = 0
            for offset, n in spans:
                assert offset == at
                at += n
            assert at <= capacity
        assert len(used) <= brute_best_fit(lengths, capacity) + 1


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)] and packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


TEXTS = [None, "", "Hello world", "Hello world", "a  b\n\n c", "<|endoftext|> x", "long text here " * 3000, "é😀", "x" * 9000]


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, length string")
    rows = packing.pack_documents(docs, PATH, pattern=public_tokenizers.PATTERN).collect()
    tok = Tokenizer.from_file(PATH)
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert None in by and len(by) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = sorted(by[i or None], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    docs = spark.createDataFrame([(i % 900, "same text") for i in range(1000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    n = rows[0].length
    assert len(rows) == 1000 and len({(r.sequence_id, r.offset) for r in rows}) == 1000
    assert len({r.sequence_id for r in rows}) == -(-1000 // (2048 // n))


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
