import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from catalogspark.llm import byte_pairs
from catalogspark.llm import two_tier_bpe as tt

HARD = [
    "", None, "Hello world", "it's we're I'll 'tis ''s 's't don't\n's  'x", "a  b   c\n\n d \n", "   ", "\n", " \t x y", "x<|endoftext|>y <|endoftext|>",
    "é ê ñ ç 漢字 🙂🙂 ½ ²³ 12345 1a2b", "a" * 5000, "ab" * 3000 + "?!" * 500, "!'s !'ll x'd'd'v've", "́a ​ \x1c\x1d\x85b", "Donaudampfschifffahrtsgesellschaftskapitän", "日本語のテキスト", "\x00\x01\x7f", "�\U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(tt.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def wrong(texts, library):
    own = tt.Codec(byte_pairs.path_of(tt.VOCABULARY))
    data, offsets = byte_pairs.buffers(pa.array(texts, pa.string()))
    ids, at = own.encode(data, offsets)
    back, ends = own.decode(ids, at)
    bad = [(t, ids[a:b].tolist()) for t, a, b in zip(texts, at[:-1], at[1:], strict=True) if ids[a:b].tolist() != library.encode_ordinary(t or "")]
    return bad + [t for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True) if back[a:b].tobytes() != (t or "").encode()]


def test_hard_texts_match_the_library(library):
    assert wrong(HARD, library) == []


def test_random_texts_match_the_library(library):
    rng = np.random.default_rng(1)
    pool = list("abcde  '\n\tstlvremd.!?*ABé漢12 ") + ["'s", "'ll", "the ", "<|endoftext|>", "\r\n", "schaft", "ción"]
    assert wrong(["".join(rng.choice(pool, int(n))) for n in rng.integers(0, 80, 3000)], library) == []


def test_every_character_is_classed_as_the_library_does(library):
    assert wrong([f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)] if not 0xD800 <= c < 0xE000], library) == []


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000):
        names = np.unique(np.random.default_rng(n).integers(1, 1 << 62, n).astype(np.uint64))
        found = tt.PerfectHash(names)
        assert sorted(found.places(names).tolist()) == list(range(len(names)))
    assert (found.places(np.arange(5000, dtype=np.uint64)) < 1000).all()


def test_names_that_collide_do_not_decide(library, monkeypatch):
    own = tt.Codec(byte_pairs.path_of(tt.VOCABULARY))
    real = tt.word_names
    monkeypatch.setattr(tt, "word_names", lambda d, s, e, seed: real(own.flat, own.at[:1].repeat(len(s)), own.at[:1].repeat(len(s)) + own.size[0], own.seed))
    data, offsets = byte_pairs.buffers(pa.array(HARD, pa.string()))
    ids, at = own.encode(data, offsets)
    piece_by_piece = [x for t in HARD for x in library.encode_ordinary(t or "")]
    assert ids.tolist() == piece_by_piece


def test_a_long_pretoken_takes_n_log_n(library):
    own = tt.Codec(byte_pairs.path_of(tt.VOCABULARY))
    rng = np.random.default_rng(4)
    piece = bytes(rng.integers(97, 123, 400_000).astype(np.uint8))
    began = time.perf_counter()
    ids = own.merged(piece)
    assert time.perf_counter() - began < 30
    assert ids[:200].tolist() == library.encode_ordinary(piece[:2000].decode())[:200]
    assert own.decode(ids, np.array([0, len(ids)]))[0].tobytes() == piece


def test_query_on_odd_rows(spark, library, tmp_path):
    rows = [(i, t, "x", "y") for i, t in enumerate([*HARD, "word " * 200_000])] + [(None, "twice", "x", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    got = [tuple(r) for r in tt.op12_two_tier_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    few = tt.with_ids(docs.filter("length(text) < 100")).select("text", tt.unpacked(F.col("ids")).alias("u")).collect()
    assert all(r.u == library.encode_ordinary(r.text) for r in few) and len(few) > 10
    assert tt.with_ids(docs.limit(0)).count() == 0


def test_decoding_other_ids(spark):
    packed = [(np.array([5, 300], "<u4").tobytes(),), (None,), (b"",)]
    from catalogspark.functions.session import ship_package

    ship_package(spark)
    got = [bytes(r.d) for r in spark.createDataFrame(packed, "p binary").select(tt.decoded(F.col("p")).alias("d")).collect()]
    own = tt.codec(byte_pairs.path_of(tt.VOCABULARY))
    assert sorted(got) == sorted([own.decode(np.array([5, 300]), np.array([0, 2]))[0].tobytes(), b"", b""])
    with pytest.raises(ValueError, match="no id"):
        own.decode(np.array([1 << 31]), np.array([0, 1]))
