import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import context_tree as ct


def words_of(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute(texts, train, depth=ct.DEPTH):
    """The definition: counts in dictionaries, block probabilities by recursion over contexts, mixing along the path."""
    streams = [b"\n" * depth + (" ".join(words_of(t)) + "\n").encode() for t in texts]
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(stream, i):
        for k in range(8):
            yield (k, stream[i] >> (8 - k)), stream[i] >> (7 - k) & 1

    for stream, learn in zip(streams, train, strict=True):
        for i in range(depth, len(stream)) if learn else ():
            for node, bit in decisions(stream, i):
                for d in range(depth + 1):
                    counts[node, stream[i - d : i]][bit] += 1
                    if d:
                        children[node, stream[i - d + 1 : i]].add(stream[i - d : i])

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    known = {}

    def weighted(node, context):
        if (node, context) not in known:
            e = kt(counts[node, context])
            if len(context) < depth:
                e = np.logaddexp(e, sum(weighted(node, c) for c in children[node, context])) - math.log(2)
            known[node, context] = e
        return known[node, context]

    def probability(node, stream, i, d):
        n = counts.get((node, stream[i - d : i]), [0, 0])
        estimate = (n[1] + 0.5) / (sum(n) + 1)
        if d == depth or (node, stream[i - d - 1 : i]) not in counts:
            return estimate
        share = math.exp(kt(n) - math.log(2) - weighted(node, stream[i - d : i]))
        return share * estimate + (1 - share) * probability(node, stream, i, d + 1)

    scores = [sum(math.log10(p if bit else 1 - p) for i in range(depth, len(s)) for node, bit in decisions(s, i) for p in [probability(node, s, i, 0)]) for s in streams]
    c = Counter(w for t, learn in zip(texts, train, strict=True) if learn for w in [*words_of(t), None])
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words_of(t), None]) for t in texts]
    return [(s, b, len(words_of(t)) + 1, sum(c[w] > 0 for w in [*words_of(t), None]), n) for s, b, t in zip(scores, base, texts, strict=True)]


@pytest.mark.parametrize("depth", [3, 4, 6, 7])
def test_equals_the_definition(spark, tmp_path, monkeypatch, depth):
    monkeypatch.setattr(ct, "BLOCK_BYTES", 200)
    monkeypatch.setattr(ct, "GATHERED", 50)
    rng = np.random.default_rng(4)
    texts = ["", None, "  \n", "A", "a é漢", "b\tb\nB b", "ab é " * 40, "ab é " * 40] + ["".join(rng.choice(list("abAé  \n"), int(rng.integers(0, 60)))) for _ in range(40)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(None if i == 9 else i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, rid string").repartition(2).write.parquet(path)
    got = {r.doc_id: r for r in ct.scored(spark.read.parquet(path), depth=depth).collect()}
    keys = [None if i == 9 else i for i in range(len(texts))]
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k in keys]
    want = brute(texts, [not x for x in out], depth)
    assert len(got) == len(texts) and any(out)
    for k, held, (score, base, n, n_known, total) in zip(keys, out, want, strict=True):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, n_known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_block_probabilities_are_the_same_looked_up():
    zeros, ones = (x.ravel().astype(float) for x in np.meshgrid([0, 1, 5, 62, 63, 64, 65, 1000], [0, 2, 63, 64, 900]))
    assert np.allclose(ct.log_kt(zeros, ones), ct.log_kt_of(zeros, ones), rtol=1e-13)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 33.5, 1e6])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_no_rows(spark):
    assert ct.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_beats_the_unigram_base_on_held_out_rows(spark):
    """Each half of a word follows from bytes that lie six places back, and each word mostly from the one before."""
    rng = np.random.default_rng(7)
    parts = ["".join(p) for p in zip(*(rng.choice(list("bcdefghijk"), 600) for _ in range(2)), strict=True)]
    parts = list(dict.fromkeys(parts))[:60]
    words = [f"{parts[i]}aaaa{parts[i * 7 % 60]}aaaa{parts[i * 11 % 60]}" for i in range(60)]
    texts = []
    for _ in range(300):
        at, text = int(rng.integers(60)), []
        for _ in range(30):
            text.append(words[at])
            at = at * 13 % 60 if rng.random() < 0.5 else int(rng.integers(60))
        texts.append(" ".join(text))
    rows = ct.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), depth=7).filter("held_out").collect()
    assert len(rows) > 20 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_beats_the_unigram_base_on_given_documents(spark):
    rows = ct.op4_context_tree(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_names_with_high_nearest_bytes(spark):
    """Bytes above 127 reach the sign of a 64-bit name."""
    texts = ["é漢ñ é漢ñ", "漢漢漢漢漢漢漢", "éa ñb", "ññññññññññ é"] * 3
    got = {r.doc_id: r.score for r in ct.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out=F.col("doc_id") >= 8).collect()}
    want = brute(texts, [i < 8 for i in range(len(texts))])
    assert all(math.isclose(got[i], want[i][0], rel_tol=1e-9, abs_tol=1e-9) for i in range(len(texts)))
