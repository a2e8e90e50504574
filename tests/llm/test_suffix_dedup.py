import hashlib
from collections import Counter

import numpy as np
import pytest

from catalogspark.llm import suffix_dedup as sd


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + sd.LENGTH] for t in raw for i in range(len(t) - sd.LENGTH + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - sd.LENGTH + 1):
            if seen[t[i : i + sd.LENGTH]] > 1:
                gone[i : i + sd.LENGTH] = True
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé漢"), int(rng.integers(1, 8))))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(int(rng.integers(20, 90))) for _ in range(6)]
    bases = [text(int(rng.integers(1, 300))) for _ in range(25)]
    out = ["", None, "x", "a" * 150, "a" * 500, "ab" * 300, "a" * 201 + "b", bases[3], bases[3], "é" * 130, "漢" * 140]
    for b in bases:
        words = b.split(" ")
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(words)))
            words[at:at] = [passages[int(rng.integers(0, 6))]] if rng.random() < 0.6 else [word()]
        out += [b, " ".join(words)][int(rng.integers(0, 2)) :]
    line = text(12)
    return out + [text(int(rng.integers(1, 40))) + line + text(int(rng.integers(1, 40))) for _ in range(30)] + [bases[0] * 3]


@pytest.mark.parametrize(("seed", "hot", "stretch"), [(1, 50_000, 1 << 20), (2, 0, 1 << 20), (3, 3, 700)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed, hot, stretch):
    monkeypatch.setattr(sd, "HOT", hot)
    texts = corpus(seed)
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, rid string").repartition(3).write.parquet(path)
    out = sd.deduplicated(spark.read.parquet(path), ["doc_id"], with_text=True).collect()
    want = brute(texts)
    assert len(out) == len(texts)
    assert [(r.doc.doc_id, texts[r.doc.doc_id], (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), want[r.doc.doc_id]) for r in out if (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) != want[r.doc.doc_id]] == []
    assert all(r.kept == texts[r.doc.doc_id] for r in out if r.n_removed == 0)


def test_refinement_finds_every_repeated_string():
    rng = np.random.default_rng(5)
    for length in (8, 12, 16, 40, 200):
        rows = [bytes(rng.choice(list(b"ab"), int(n))) * int(rng.integers(1, 3)) for n in rng.integers(0, 160, 30)] + [b"a" * 260, b"a" * 260]
        group = rng.integers(0, 2, len(rows))
        seen = Counter((int(g), r[i : i + length]) for g, r in zip(group, rows, strict=True) for i in range(len(r) - length + 1))
        want = [i + length <= len(r) and seen[int(g), r[i : i + length]] > 1 for g, r in zip(group, rows, strict=True) for i in range(len(r))]
        at = np.cumsum([0, *map(len, rows)])
        assert sd.refined(np.frombuffer(b"".join(rows), np.uint8), at, group, length).tolist() == want


def test_a_long_text_and_columns_that_clash(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    long = "".join(map(chr, rng.integers(97, 123, 3 << 20)))
    texts = [long, "z" + long[1000:1400] + "z", long[2_500_000:2_500_300]]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, _rid string, doc int").write.parquet(path)
    got = {r.doc.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in sd.deduplicated(spark.read.parquet(path), ["doc_id"]).collect()}
    assert got == {0: (3 << 20, 700, 2), 1: (402, 400, 1), 2: (300, 300, 1)}


def test_long_texts_are_scanned_in_stretches(monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 1000)
    offsets = np.array([0, 10, 5010, 5200])
    windows = set()
    for x, y, inner, first in sd.stretches(offsets):
        for a, b in zip(inner[:-1], inner[1:], strict=True):
            windows |= {x + s for s in range(int(a), int(b) - sd.LENGTH + 1)}
    assert windows == set(range(10, 5010 - sd.LENGTH + 1))


def test_rows_without_words_left_go(spark):
    same = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, same, 7), (2, same, 7), (3, "stays " + same, 7), (4, None, 0), (5, "", 0)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in sd.keep_unrepeated(docs, length="n_chars").collect()}
    assert got == {3: ("stays ", 6), 4: (None, 0), 5: ("", 0)}
    assert sd.keep_unrepeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
