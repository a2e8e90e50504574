import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from catalogspark.llm import byte_pairs, packing


def check(rows, texts, limit=1024, segments=packing.MAX_SEGMENTS):
    lib = Tokenizer.from_file(byte_pairs.path_of(packing.VOCABULARY))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit and at & (at - 1) == 0 and len(pieces) <= segments


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3), packing.Limits(128, 16, 100)])
def test_every_id_lies_in_one_piece(spark, limits):
    rng = np.random.default_rng(3)
    texts = ["", None, "one", "a b c " * 3000] + ["w " * int(n) for n in rng.integers(0, 900, 60)] + [""] * 200
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    check(packing.pack(docs, limits=limits).collect(), texts, limits.tokens, limits.segments)


def test_loss_limit_of_instruction_data(spark):
    rows = [(i, "question " * (i % 50), "answer " * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "k long, q string, a string").coalesce(2)
    limits = packing.Limits(256, 8, 60)
    out = packing.pack(docs, key="k", text="a", prompt="q", limits=limits, with_ids=True).collect()
    lib = Tokenizer.from_file(byte_pairs.path_of(packing.VOCABULARY))
    loss, size, whole = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in out:
        q = len(lib.encode(rows[r.k][1], add_special_tokens=False).ids)
        loss[r.sequence_id] += max(0, min(r.start + r.length, r.doc_tokens - 1) - max(r.start, q))
        size[r.sequence_id] += r.length
        whole[r.k].append((r.start, r.ids))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert max(loss.values()) <= 60 and max(size.values()) <= 256 and all(v & (v - 1) == 0 for v in size.values())
    for k, parts in whole.items():
        want = lib.encode(rows[k][1], add_special_tokens=False).ids + lib.encode(rows[k][2], add_special_tokens=False).ids + [0]
        assert [i for _, p in sorted(parts) for i in p] == want


def test_no_rows_and_same_again(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('tok ', cast(id as int)) as text")
    assert packing.pack(docs).collect() == packing.pack(docs).collect()
