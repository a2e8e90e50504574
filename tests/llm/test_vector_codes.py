import hashlib
import math

import duckdb
import numpy as np
import pytest

from catalogspark.llm import vector_codes as vc


def brute_force(rows, parts=4, entries=256, rounds=4):
    """The contract, entry by entry, in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in order[:entries]] for p in range(parts)]

    def nearest(p, own):
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(p, cut(v)[p])[1], []).append(cut(v)[p])
            for i, own in groups.items():
                books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, *zip(*[nearest(p, x) for p, x in enumerate(cut(v))], strict=True), lab) for i, v, lab in kept]
    total = {}
    for _, d, _, lab in out:
        total[lab] = total.get(lab, 0) + sum(d)
    return [(i, "".join(f"{x:02x}" for x in e), sum(d), total[lab], digest) for i, d, e, lab in out]


def write(spark, rows, path):
    spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, id int").write.parquet(f"{path}/embeddings.parquet")


def some(n, seed, spread=0.02):
    """Coarse values, so that equal distances and equal parts abound; a third of the rows are one vector."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, 8)) * spread
    v[::3] = v[0]
    ids = rng.permutation(n * 2)[:n]
    return [(int(i), [float(np.float32(a)) for a in x], [None, 1, 2][int(rng.integers(3))]) for i, x in zip(ids, v, strict=True)]


def test_query_matches_brute_force(spark, tmp_path):
    rows = some(700, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(9001, None, 1), (0, [nan] * 8, 1), (1, [1.0, inf] + [0.0] * 6, 1), (2, [None] + [0.0] * 7, 2), (None, [0.25] * 8, None), rows[5], rows[5], (rows[7][0], [-1.0] * 8, 2)]
    write(spark, rows, tmp_path)
    got = [tuple(r) for r in vc.op13_vector_codes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)


def test_few_vectors_other_lengths_and_none(spark, tmp_path):
    rows = [(5, [0.5] * 8, 1), (3, [0.0] * 8, 1), (9, [0.5] * 8, None)]
    write(spark, rows, tmp_path / "few")
    assert sorted(map(tuple, vc.op13_vector_codes(spark, str(tmp_path / "few")).collect())) == sorted(brute_force(rows))
    write(spark, [*rows, (7, [1.0] * 4, 1), (1000, [], 1), (8, [1e9] * 8, 1)], tmp_path / "odd")
    got = {r.vec_id: (r.code, r.error) for r in vc.op13_vector_codes(spark, str(tmp_path / "odd")).collect()}
    assert got == {i: (c, e) for i, c, e, _, _ in brute_force(rows)} | {7: (None, None), 1000: (None, None)}
    write(spark, [], tmp_path / "none")
    assert vc.op13_vector_codes(spark, str(tmp_path / "none")).count() == 0
    write(spark, [(1, None, 1)], tmp_path / "null")
    assert vc.op13_vector_codes(spark, str(tmp_path / "null")).count() == 0


@pytest.mark.parametrize("degree, leaf", [(8, 64), (4, 4)])
@pytest.mark.parametrize("size, dims, top", [(256, 16, 300), (256, 16, 2), (256, 3, 1 << 26), (40, 2, 5), (17, 1, 1), (1, 4, 9)])
def test_tree_finds_what_a_full_search_finds(size, dims, top, degree, leaf, monkeypatch):
    monkeypatch.setattr(vc, "DEGREE", degree)
    monkeypatch.setattr(vc, "LEAF", leaf)
    rng = np.random.default_rng(size * dims)
    entries = rng.integers(-top, top + 1, (size, dims))
    queries = np.concatenate([rng.integers(-top, top + 1, (3000, dims)), entries, entries[:5] + 1])
    at, best = vc.Gnat(entries).nearest(queries)
    every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e, strict=True)) for e in entries] for q in queries[:200].tolist()])
    assert (best[:200] == every.min(1)).all() and (at[:200] == every.argmin(1)).all()
    exact = ((queries[:, None, :] - entries) ** 2).sum(2)
    assert (best == exact.min(1)).all() and (at == exact.argmin(1)).all()


def test_subtrees_are_left_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    entries = (centres[:, None, :] + rng.integers(-50, 50, (16, 16, 8))).reshape(-1, 8)
    seen, real = [0], vc.distances

    def counted(a, b):
        seen[0] += len(a) * len(b)
        return real(a, b)

    tree = vc.Gnat(entries)
    vc.distances = counted
    try:
        tree.nearest(entries.repeat(10, 0) + 1)
    finally:
        vc.distances = real
    assert seen[0] < 2560 * 256 / 5


def test_sql_twin(spark, tmp_path):
    rows = [(i, v * 2, lab) for i, v, lab in some(300, 5)]
    write(spark, rows, tmp_path)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        twin = c.execute(vc.ORACLE_SQL["op13_vector_codes"]).fetchall()
    assert sorted(twin) == sorted(brute_force(rows))
