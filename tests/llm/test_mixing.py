from collections import defaultdict

import pytest

from catalogspark.llm import mixing


def water(total, children):
    """Brute force: (name, weight, capacity) to whole-number shares, by raising the level through every saturation."""
    open_ = {n: (w, c) for n, w, c in children if w > 0}
    out, left = {n: 0 for n, _, _ in children}, total
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c / w <= level]
        if not full:
            return out | {n: min(c, int(w * level)) for n, (w, c) in open_.items()}
        n = min(full, key=lambda n: open_[n][1] / open_[n][0])
        out[n] = open_[n][1]
        left -= open_.pop(n)[1]
    return out


@pytest.mark.parametrize("share", [0.1, 0.6, 1.3, 5.0])
def test_shortages_go_to_siblings_first(spark, share):
    leaves = [("bulk", "en", "a", 900), ("bulk", "en", "b", 30), ("bulk", "fr", "a", 5), ("curated", "en", "c", 40), ("curated", "de", "c", 4), ("curated", "de", "d", 60), ("curated", "", "", 7)]
    total = int(sum(x[3] for x in leaves) * share)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, total, mixing.WEIGHTS, 2).collect()}
    weight = lambda level, v: mixing.WEIGHTS[level].get(v, 1.0)
    cap = defaultdict(int)
    for d, l, s, n in leaves:
        for k in ((d, l, s), (d, l), (d,)):
            cap[k] += 2 * n
    want = {}
    top = water(total, [(d, weight("domain", d), cap[d,]) for d in {x[0] for x in leaves}])
    for d, t in top.items():
        for l, u in water(t, [(l, weight("lang", l), cap[d, l]) for l in {x[1] for x in leaves if x[0] == d}]).items():
            for s, v in water(u, [(s, 1.0, cap[d, l, s]) for s in {x[2] for x in leaves if x[:2] == (d, l)}]).items():
                want[d, l, s] = v
    assert got == want


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_prefix_does_not_depend_on_buckets(spark, buckets, tmp_path):
    rows = [(i % 90, "w " * (i % 23), ["en", "fr", None][i % 3], "src0" if i % 3 else None, i, "x") for i in range(400)] + [(None, None, None, None, 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    base = sorted(map(str, mixing.mixed(docs, buckets=256).collect()))
    assert sorted(map(str, mixing.mixed(docs, buckets=buckets).collect())) == base
    assert sorted(map(str, mixing.keep_mixture(docs).collect())) == sorted(str(r.doc) for r in mixing.mixed(docs).collect())
    assert mixing.keep_mixture(docs).columns == docs.columns


def test_no_rows(spark):
    assert mixing.keep_mixture(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
