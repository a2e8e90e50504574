import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from catalogspark.llm import ngram_join as nj


def brute(texts, n, num, den):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        w = [x for x in w if x]
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(seed, n_base, copies):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = ["", None, "  \n", "a", "A", "a b", "a b c d e f g h i j k l", "A B c d e f g h i j k l", "a  b\nc d e f g h i j k l"]
    shared = list(rng.choice(vocab, 25))
    for b in range(n_base):
        base = list(rng.choice(vocab, int(rng.integers(3, 160))))
        if b % 3 == 0:
            base += shared
        now = base
        for _ in range(int(rng.integers(0, copies))):
            now = list(now if rng.random() < 0.3 else base)
            for _ in range(int(rng.integers(0, 1 + len(now) // 25))):
                at = int(rng.integers(0, len(now)))
                now[at : at + int(rng.integers(0, 2))] = list(rng.choice(vocab, int(rng.integers(0, 2))))
            texts.append(" ".join(now))
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize(("n", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (1, 70, 100, 3)])
def test_equals_brute_force(spark, tmp_path, n, num, den, seed):
    texts = corpus(seed, 60, 8)
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, class string, rid int").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted((r.key, r.n_shingles, r.component_id) for r in nj.linked(docs, n=n, num=num, den=den).collect())
    assert got == brute(texts, n, num, den)


def test_keep_one_and_odd_rows(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same), (7, same), (7, same), (9, same), (3, ""), (3, ""), (4, None), (5, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.keep_one(docs).collect()), key=str) == sorted([(7, same), (3, ""), (3, ""), (4, None), (5, "alone")], key=str)
    assert nj.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pigeonhole_budget_covers_every_pair():
    bands = nj.Bands(80, 100)
    for a in range(1, 400):
        for b in range(a, 501):
            both = -(-80 * (a + b) // 180)
            if both > a:
                continue
            k = bands.of(b)
            assert k in bands.searched(a) and a + b - 2 * both <= min(bands.apart(a, k), bands.apart(b, k)) < bands.segments(k)


def test_families_around_the_threshold_and_columns_that_clash(spark, tmp_path):
    """A large family whose members differ in their own words, a passage that all texts share, and one very long text twice."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for _ in range(150):
        now = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            now[at] = f"x{int(rng.integers(0, 6))}"
        texts.append(" ".join(now + passage * int(rng.integers(0, 2))))
    texts += [" ".join([f"q{int(x)}" for x in rng.integers(0, 9999, 60)] + passage) for _ in range(60)]
    long = [f"l{int(x)}" for x in rng.integers(0, 9999, 60_000)]
    texts += [" ".join(long), " ".join(long[:-100])]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "x", 0, "r", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, rid int, _rid string, class long").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted((r.key, r.n_shingles, r.component_id) for r in nj.linked(docs, n=3, num=90, den=100).collect())
    want = brute(texts, 3, 90, 100)
    assert got == want
    kept = nj.keep_one(docs, n=3, num=90, den=100)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def thue_morse(letters: str, size: int) -> str:
    return "".join(letters[i.bit_count() & 1] for i in range(size))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_complementary_thue_morse_words_are_not_linked(spark, size):
    rows = [(1, thue_morse("ab", size)), (2, thue_morse("ba", size)), (3, thue_morse("ab", size))]
    got = {r.key: r.component_id for r in nj.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_names_of_a_part_meet_in_bounded_memory():
    """Two million names of 2000 classes, of which neighbours share one: the working memory is that of a few names."""
    rng, each, classes = np.random.default_rng(2), 1000, 2000
    name = rng.integers(0, 1 << 45, (classes, each), dtype=np.uint64) << np.uint64(3)
    name[1::2, 7] = name[::2, 7]
    ids = rng.integers(0, 256, (classes, 16), dtype=np.uint8)
    facts = np.tile(np.array([each, each, 0], np.uint32), (classes, 1))
    short = np.ascontiguousarray(name).view(np.uint8).reshape(classes, each, 8)[:, :, :6]
    count = np.full(1, each, np.uint32)
    blobs = [np.uint32(1).tobytes() + ids[i].tobytes() + facts[i].tobytes() + count.tobytes() + short[i].tobytes() for i in range(classes)]
    batches = [pa.RecordBatch.from_arrays([pa.array(blobs[a : a + 100], pa.binary())], ["blob"]) for a in range(0, classes, 100)]
    tracemalloc.start()
    got = [x for batch in nj.meet(iter(batches)) for x in zip(*(batch.column(c).to_pylist() for c in ("name", "class")), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(got) == sorted((int(name[i, 7].view(np.int64)), ids[i].tobytes()) for i in range(classes))
    assert peak < 25 * classes * each
