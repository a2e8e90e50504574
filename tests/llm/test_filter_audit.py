import itertools
import math
import re
from collections import defaultdict

from catalogspark.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, name string, mask int, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute_force(docs, labels):
    """Every order applied to every row, one filter after another."""
    out, fails = {}, []
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in docs)
        mine = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        good, toxic = (any(doc_id is not None and d == doc_id and row[k] == 1 for d, *row in labels) for k in (0, 1))
        fails.append((source or "", mine, good, toxic))
    shapley = defaultdict(int)
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {f[0] for f in fails}:
            alive = [f for f in fails if f[0] == part]
            everyone = list(alive)
            for step, c in enumerate(order, 1):
                gone, left = [f for f in alive if f[1][c]], [f for f in alive if not f[1][c]]
                shapley[part, c] += len(gone)
                unique = sum(f[1][c] and sum(f[1].values()) == 1 for f in everyone)
                redundant = sum(f[1][c] for f in everyone) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone))
                alive = left
    return {(p, o, i, *v, shapley[p, o[i - 1]]) for (p, o, i), v in out.items()}


def rows():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [long, "short", "", None, long, long + " #", "word " * 300, "WORD " * 300, long.upper(), "a | b", long, "short", "é " * 250, long + " $", "x" * 100_000 + " y" * 100_000]
    docs = [(i * 7 % 11 + i, t, ("s0", "s1", None)[i % 3]) for i, t in enumerate(texts)]
    docs += [docs[0], docs[0], (None, long, "s0"), (None, "never seen twice", "s1"), (None, None, None), (-5, "WORD " * 300, "s2")]
    labels = [(d, i % 2, i % 3 % 2) for i, (d, _, _) in enumerate(docs)] + [(docs[2][0], 1, None), (None, 1, 1), (999, 1, 1), (docs[3][0], None, None)]
    return docs, labels


def test_every_order_matches_brute_force(spark, tmp_path):
    docs, labels = rows()
    spark.createDataFrame([(*d, "x", 3, "q") for d in docs], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*x, "t") for x in labels], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = fa.op11_filter_audit(spark, str(tmp_path))
    found = [tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len(found) == len(set(found)) == 600 * 4
    assert set(found) == brute_force(docs, labels)
    assert dict(got.dtypes)["step"] == "int"


def test_empty_table(spark):
    none = fa.mask_counts(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert fa.audit(none, "ABCDE").count() == 0


def test_lattice_counts_orders():
    for n in range(1, 7):
        lattice = fa.Lattice("ABCDEF"[:n])
        assert lattice.backward[0] == lattice.forward[-1] == math.factorial(n)
        for s, f in lattice.edges:
            k = s.bit_count()
            assert lattice.weight(s, f) == math.factorial(k) * math.factorial(n - k - 1)


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a", "x"), (3, "A", "y")], "doc_id long, text string, source string")
    counts = fa.mask_counts(docs, spark.createDataFrame([], LABELS), [("s", "n_words < 2"), ("u", "n_upper > 0")])
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in fa.audit(counts, "su").collect()}
    assert got["x", "su", 1] == (1, 1, 0, 2) and got["y", "us", 2] == (0, 0, 1, 1) and got["y", "us", 1] == (0, 1, 0, 1)
