import random
import re

from catalogspark.operators import relations


def test_routine_mates_equal_all_pairs(spark):
    r = random.Random(6)
    zones = ["", None, "Rostro", "rostro, cuerpo", "Cuérpo", "pie", "cabello rostro manos", "manos", " ".join(chr(97 + i % 26) * 4 + chr(97 + i // 26) for i in range(70)), "aaaaa bbbba", " ".join(chr(97 + i) * 4 + "a" for i in range(9)) + " rostro"]
    rows = [(i, r.choice([0, 1, 2, None]), r.choice(zones)) for i in range(150)]
    plain = str.maketrans("é", "e")
    words = lambda z: {w for w in re.split("[^a-z]+", (z or "").lower().translate(plain)) if len(w) > 3}
    want = {a[0]: sum(a[1] is not None and b[1] is not None and a[1] != b[1] and (not a[2] or not b[2] or bool(words(a[2]) & words(b[2]))) for b in rows) for a in rows}
    got = {x.k: x.mates for x in relations.routine_mates(spark.createDataFrame(rows, "k int, step int, zone string"), "k", "step", "zone").collect()}
    assert got == want
