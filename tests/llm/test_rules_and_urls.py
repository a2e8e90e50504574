import time

import pytest

from catalogspark.llm import quality_rules as q
from catalogspark.llm import url_filters as u


def brute(t):
    t = t or ""
    for c in "\t\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.replace("\n", " ").split(" ") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(inside)


def test_measures_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a a a a", "a b c a b c a b c", "x y z\nx y z\n\n q", "\n".join(["same line here"] * 30), "# $ % é漢🙂", "a\u00a0b c", "w " * 400, "l\r\nl\r\nm"]
    got = q.ledger(spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _words string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_repeat_words) == brute(texts[r.doc_id])
    dups = {r.doc_id: r.n_dup_lines for r in got}
    assert (dups[6], dups[7], dups[11], dups[3]) == (1, 29, 1, 0)


def test_policies_and_ablations(spark):
    rows = [(1, "word number " + " ".join(f"w{i}" for i in range(60))), (2, "short"), (3, "# " * 80), (None, None)]
    led = q.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in led.filter(q.passes()).collect()] == [1]
    cost = {r.rule: (r.n_failed, r.n_only_this) for r in q.ablations(led).collect()}
    assert cost["few_words"] == (2, 2) and cost["symbols"] == (1, 0)
    assert {r.doc_id for r in q.keep_passing(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}
    assert q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/77?x#y", "http://com/en/", "http://xcom/en/", "https://net/de", "http://a.example.net/de/8", "ftp://b.org/es/?q", "http://org", "x://", "a://b.com://c/en/", "http://example.com/en/7\n8",
]


@pytest.mark.parametrize("bound", [10, 2])
def test_trie_and_join_agree_with_brute_force(spark, bound):
    rules = [*u.RULES, ("", "", "allow"), ("com", "/en/", "allow"), ("b.com:", "", "block")]
    rows = [(i, x, "host", "r") for i, x in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    for rs in (u.RULES, rules[1:]):
        for r in u.judge(pages, rs, max_broadcast_rules=bound).collect():
            rest = (URLS[r.page_id] or "").split("://", 1)
            rest = rest[1] if len(rest) == 2 else ""
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
            fits = [(u.rank_of(h, p, v), h + p, v) for h, p, v in rs if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=(None, None, "allow"))
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])
    assert u.judge(spark.createDataFrame([], "page_id long, url string"), u.RULES).count() == 0


def test_long_segments_and_many_rules_by_join(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block"), ("net", "/x/y/zz", "block"), ("com", "/en/a", "allow")]
    paths = ["en/", "en/7", "en/70/x", "en", "", "x/y/zzz", "x/y/z", "en/ab", "x/y/zz/" + "q" * 100_000]
    urls = [(f"http://{h}/{p}",) for h in ("example.com", "a.example.com", "b.net", "com", "x.org") for p in paths]
    pages = spark.createDataFrame(urls, "url string")
    began = time.perf_counter()
    by_trie = sorted(map(tuple, u.judge(pages, rules).select("url", "rule", "verdict").collect()), key=str)
    assert time.perf_counter() - began < 20
    assert by_trie == sorted(map(tuple, u.judge(pages, rules, max_broadcast_rules=1).select("url", "rule", "verdict").collect()), key=str)
    assert {r[1] for r in by_trie} == {None, "com/en/", "example.com/en/7", "a.example.com", "net/x/y/zz", "com/en/a"}


@pytest.mark.parametrize("bound", [10, 1])
def test_rules_of_the_query_are_those_of_its_contract(spark, bound):
    assert u.RULES == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = [("http://a.net/de/1",), ("http://example.net/de/7",), ("http://example.net/de/8",), ("http://net/en/",), ("http://b.com/en/",), ("http://example.com/en/7",), ("http://c.org/es/",)]
    got = u.judge(spark.createDataFrame(urls, "url string"), u.RULES, max_broadcast_rules=bound).select("rule", "verdict").collect()
    want = [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bound", [10, 1])
def test_columns_of_any_name_come_through(spark, bound):
    names = ["page_id", "link", "_url", "_match", "row", "match", "best", "a.b", "verdict"]
    pages = spark.createDataFrame([(1, "http://com/en/1", "u", "m", "r", "x", "y", "dot", "old"), (1, "http://com/en/1", "u", "m", "r", "x", "y", "dot", "old")], names)
    got = u.judge(pages, u.RULES, url="link", max_broadcast_rules=bound)
    assert got.columns == [*names[:-1], "host", "path", "rule", "verdict"]
    assert [tuple(r) for r in got.collect()] == [(1, "http://com/en/1", "u", "m", "r", "x", "y", "dot", "com", "/en/1", "com/en/", "block")] * 2


def test_very_long_texts_are_judged_whole(spark):
    rows = [(1, "w " * 300_000), (2, " ".join(f"w{i}" for i in range(200_000)) + " #"), (3, "x" * 1_000_000)]
    got = {r.doc_id: r for r in q.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[2].n_words, got[2].n_symbols, got[2].n_repeat_words, got[3].word_chars) == (300_000, 300_000, 200_001, 1, 0, 1_000_000)
