import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from catalogspark.llm import byte_pairs, token_counts

HARD = [
    "", None, "Hello world", "it's we're I'll 'tis ''s 's't don't\n's  'x", "a  b   c\n\n d \n", "   ", "\n", " \t x y", "x<|endoftext|>y <|endoftext|>", "<|endoftext|><|endoftext|>",
    "é ê ñ ç 漢字 🙂🙂 ½ ²³ 12345 1a2b", "a" * 5000, "ab" * 3000 + "?!" * 500, "!'s !'ll x'd'd'v've", "́a ​ \x1c\x1d\x85b", "<|endof", "'", "l'l l'll", " 's 'll",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_pairs.path_of(token_counts.VOCABULARY))


def both(texts, library):
    enc = byte_pairs.Encoder(byte_pairs.path_of(token_counts.VOCABULARY))
    data, offsets = byte_pairs.buffers(pa.array(texts, pa.string()))
    ids, at = enc.ids(data, offsets)
    assert (np.diff(at) == enc.counts(data, offsets)).all()
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(t, ids[a:b].tolist(), w.ids) for t, a, b, w in zip(texts, at[:-1], at[1:], want, strict=True) if ids[a:b].tolist() != w.ids]


def test_hard_texts_match_the_library(library):
    assert both(HARD, library) == []


def test_random_texts_match_the_library(library):
    rng = np.random.default_rng(1)
    pool = list("abcde  '\n\tstlvremd.!?*ABé漢12 ") + ["'s", "'ll", "the ", "<|endoftext|>", "\r\n"]
    assert both(["".join(rng.choice(pool, int(n))) for n in rng.integers(0, 80, 3000)], library) == []


def test_words_that_rolling_hashes_confuse(library):
    texts = ["".join(two[i.bit_count() & 1] for i in range(size)) for size in (1024, 2048, 4096) for two in ("ab", "ba")]
    assert both(texts + [" ".join(texts)], library) == []


def test_pretokens_with_one_name_are_told_apart_by_their_bytes(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "word_names", lambda data, starts, ends, *_: (ends - starts).astype(np.uint64) % 3 + np.uint64(1))
    assert both(HARD, library) == []
    rng = np.random.default_rng(2)
    assert both(["".join(rng.choice(list("abcde  '\n123é"), int(n))) for n in rng.integers(0, 200, 200)], library) == []


def test_every_character_is_classed_as_the_library_does(library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert both(texts, library) == []


def test_query_on_odd_rows(spark, library, tmp_path):
    rows = [(1, t, "x") for t in HARD] + [(None, "twice", "x")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(str(tmp_path / "documents.parquet"))
    got = token_counts.op1_token_counts(spark, str(tmp_path)).collect()
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    assert sorted(r.n_tokens for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.with_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
