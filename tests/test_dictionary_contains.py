"""Aliases in texts: a pattern is tried once where an alias and a text meet, and finds what trying it at every step found."""

import random
import re

from catalogspark.operators import links

PLAIN_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def by_hand(text, aliases):
    """(alias, rank, at, size): longer aliases first, all their matches that touch no used character."""
    used, hits = set(), []
    for a in sorted(aliases, key=lambda a: (-len(a), a)):
        pattern = r"\s+".join(re.escape(w) for w in a.split(" "))
        spans = [m.span() for m in re.finditer(f"(?ia){PLAIN_EDGE}{pattern}{PLAIN_EDGE}", text)]
        free = [(s, e) for s, e in spans if not used & set(range(s, e))]
        used |= {i for s, e in free for i in range(s, e)}
        hits += [(a, free[0][0] + 1, free[0][1] - free[0][0])] if free else []
    return [(a, n, at, size) for n, (a, at, size) in enumerate(hits, 1)]


def test_a_pattern_is_tried_once_where_alias_and_text_meet(spark):
    texts, dictionary = spark.createDataFrame([(1, "a b")], "k int, t string"), spark.createDataFrame([("a", "A"), ("b", "B")], "alias string, canon string")
    plan = links.contained(texts, "k", "t", dictionary)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"RLIKE\(flat|flat#\d+ RLIKE|regexp_replace\(lambda|RLIKE\(lambda", plan)
    assert len(re.findall(r"regexp_replace\(flat#", plan)) == 1


def test_hard_aliases_are_found_as_by_hand(spark):
    r = random.Random(7)
    aliases = ["a", "a a", "a-a", "a a b", "x a", "Brand#1", "Brand#12", "#1", "b.", ".b", "(b)", "red ring", "ring", "red", "$0", "a\\b", "x_a", "a b a"]
    pieces = ["a", "A", "b", "x", "x_a", "Brand#1", "brand#12", "red", "RING", "ring", "string", "#1", "b.", ".b", "(b)", "$0", "a\\b", "-"]
    rows = [(i, "".join(r.choice(pieces) + r.choice([" ", " ", " ", "-", ""]) for _ in range(9)).strip()) for i in range(400)]
    texts, dictionary = spark.createDataFrame(rows, "k int, t string"), spark.createDataFrame([(a, a.upper()) for a in aliases], "alias string, canon string")
    got = {}
    for x in links.contained(texts, "k", "t", dictionary).collect():
        got.setdefault(x.k, []).append((x.alias, x["rank"], x.at, x.size))
    # an alias meets texts that have its rarest word; edges of ASCII words never part a word of these texts
    want = {k: by_hand(re.sub(r"\s+", " ", t), aliases) for k, t in rows}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert len({a for v in want.values() for a, *_ in v}) == len(aliases)


def test_case_goes_by_ascii(spark):
    rows = [(1, "un N Σ7"), (2, "\u212a 5"), (3, "K 5"), (4, "n σ7")]
    texts, dictionary = spark.createDataFrame(rows, "k int, t string"), spark.createDataFrame([("n Σ", "sigma"), ("k 5", "kelvin")], "alias string, canon string")
    got = sorted((x.k, x.canon, x.at, x.size) for x in links.contained(texts, "k", "t", dictionary).collect())
    assert got == [(1, "sigma", 4, 3), (3, "kelvin", 1, 3)]
