from collections import defaultdict

import corpus_pipeline
import numpy as np
from test_ngram_join import brute as near
from test_suffix_dedup import brute as repeats
from tokenizers import Tokenizer

from catalogspark.llm import byte_pairs, mixing, packing


def corpus():
    rng = np.random.default_rng(9)
    vocab = [f"word{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(vocab, n))
    passage, base = some(70), some(120)
    texts = [some(int(n)) for n in rng.integers(60, 200, 30)]
    texts += [base, base, base + " tail", some(80) + " " + passage + " " + some(80), passage + " " + some(90), some(10), "", None, "# " * 100, "same three words " * 40]
    return [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


def judged(t):
    """The production policy on whole texts, as plain counting."""
    t = t or ""
    w = t.split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip()]
    chars, symbols = sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>")
    return not (len(w) < 50 or 2 * len(inside) > len(w) or 2 * symbols > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * len(w) or chars > 25 * len(w))


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(path)
    docs, seen = spark.read.parquet(path), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = [r for r in rows if judged(r[1])]
    assert sorted(r.doc_id for r in seen["quality_rules"]) == [r[0] for r in kept] and len(kept) < len(rows)
    first = near([r[1] for r in kept], 5, 80, 100)
    kept = [r for r, (i, _, root) in zip(kept, first, strict=True) if i == root]
    assert sorted(r.doc_id for r in seen["ngram_jaccard"]) == [r[0] for r in kept]
    cut = repeats([r[1] for r in kept])
    got = {r.doc_id: r for r in seen["suffix_dedup"]}
    assert {i for i, r in got.items() if r.text != rows[i][1]} == {r[0] for r, c in zip(kept, cut, strict=True) if c[1]} & set(got)
    assert sum(c[1] for c in cut) == sum(len(r[1].encode()) for r in kept) - sum(len(r.text.encode()) for r in got.values())
    assert all(len(r.text) == r.n_chars for r in got.values())
    tokens = {i: len(r.text.split()) for i, r in got.items()}
    mixed = [r.doc_id for r in seen["mixing"]]
    assert set(mixed) <= set(got) and sum(tokens[i] for i in mixed) <= mixing.SHARE * sum(tokens.values()) and max(map(mixed.count, mixed)) <= mixing.MAX_EPOCHS
    lib = Tokenizer.from_file(byte_pairs.path_of(packing.VOCABULARY))
    want = defaultdict(int)
    for r in seen["mixing"]:
        want[r.doc_id] += len(lib.encode(r.text, add_special_tokens=False).ids) + 1
    have = defaultdict(int)
    for r in seen["packing"]:
        have[r.doc_id] += len(r.ids)
    assert have == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(len(r.ids) for r in out) == sum(want.values())
    assert {r.doc_id for r in out} == set(want)
