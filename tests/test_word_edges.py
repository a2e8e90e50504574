"""Edges of words: the quick patterns find what the plain definition finds, and texts are made flat once."""

import random

from pyspark.sql import functions as F

from catalogspark.operators import extraction, language

PLAIN = "[A-Za-z0-9_]"


def plain(pattern):
    return pattern.replace(r"\b", f"(?:(?<!{PLAIN})(?={PLAIN})|(?<={PLAIN})(?!{PLAIN}))").replace(r"\w", PLAIN)


def test_words_have_the_same_characters(spark):
    chars = spark.range(1, 0x11000).filter("id < 55296 OR id > 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    for flags, word in (("(?iu)", language.WORD), ("(?i)", language.ASCII_WORD)):
        assert chars.filter(F.col("c").rlike(flags + PLAIN) != F.col("c").rlike(flags + word)).count() == 0
        assert chars.filter(F.col("c").rlike(flags + word)).count() >= 63


def test_edged_patterns_match_alike(spark):
    r = random.Random(5)
    patterns = [p for _, _, p in language.TERMS] + [p for p, _, _ in extraction.FORMS] + [p for p, _ in extraction.ROUTES] + [p for rules in extraction.KINDS.values() for p, _ in rules]
    patterns += [language.COMMERCIAL, extraction.MODEL, extraction.FACTOR, *extraction.CATEGORY_WORDS.values(), r"\bs?oral\b", r"x\d\b", r"\b\d+\w*\b"]
    words = ["tab", "tabs.", "caps", "oral", "soral", "x5", "5x", "fps 50+", "omega-3", "vitamina c", "gel", "crema facial", "cura", "curas", "oferta", "envio gratis", "ſoral", "oralſ", "ıoral", "K", "ñ", "é", "s.c.", "sc"]
    texts = ["".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) + r.choice(["", " ", "_", "-", "ñ", ".", "9"]) for _ in range(6)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.to_json(F.regexp_extract_all("t", F.lit(p), 0))
    wrong = [F.count_if(found("(?iu)" + language.edged(p)) != found("(?iu)" + plain(p))) for p in patterns] + [F.count_if(found("(?i)" + language.edged(p, language.ASCII_WORD)) != found("(?i)" + plain(p))) for p in patterns]
    for a in range(0, len(wrong), 40):
        assert not any(rows.agg(*wrong[a : a + 40]).first())


def test_category_makes_a_text_flat_once(spark):
    df = spark.createDataFrame([(1, "x")], "k int, t string")
    plan = extraction.detect_category(df, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
