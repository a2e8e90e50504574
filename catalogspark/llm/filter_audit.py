"""Filter interaction audit: what each filter removes under every order of the filters, and its Shapley share.

A document is reduced to the set of filters that it fails, a mask of few bits, and documents are counted by part and
mask. The states of a run are the subsets of filters applied so far; an edge applies one more filter. Forward counting
gives the orders that reach a state, backward counting those that leave it for the full set, so an edge lies on
(orders reaching its start) * (orders leaving its end) orders. One pass over the counts gives what each edge removes; the
Shapley sum of a filter is the sum of its edges' removals by these weights, and the steps of a single order are read
from the same edges.

The filter on duplicates asks for a smaller id with the same text in the whole table. Texts are named by SHA-256, and rows
are counted by name, part, mask and labels before names meet, so a text that a third of all rows holds makes few rows.

Defined cases: a null text is an empty one, a null part is the empty string; a null id is never smaller than another and has
no labels, and no id is smaller than it; repeated rows count each, and none is a duplicate of another with its own id; repeated
labels of an id count as one that holds what any of them holds; texts of any length are measured whole; an empty table gives
no rows; only the named columns are taken, so others cannot clash.
"""

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.functions.session import written

#: White space between words: space and bytes 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Letter and failing condition over the measurements n_words, n_distinct, n_upper, n_chars, text and, for duplicates, is_copy.
FILTERS = [
    ("A", "n_words < 200"),
    ("B", "100 * n_distinct < 50 * n_words"),
    ("C", "100 * n_upper > 2 * n_chars"),
    ("D", "text rlike '[#$%&*|]'"),
    ("E", "is_copy"),
]
#: The filter that is known only when the whole table was seen.
COPIES = "is_copy"


class Lattice:
    """States (bit sets of applied filters) and edges (state, filter) with the number of orders through each."""

    def __init__(self, letters: str):
        self.letters, n = letters, len(letters)
        full = (1 << n) - 1
        self.forward, self.backward = [0] * (full + 1), [0] * (full + 1)
        self.forward[0] = self.backward[full] = 1
        self.edges = [(s, f) for s in range(full + 1) for f in range(n) if not s >> f & 1]  # states in ascending order: each is complete before it is left
        for s, f in self.edges:
            self.forward[s | 1 << f] += self.forward[s]
        for s, f in reversed(self.edges):
            self.backward[s] += self.backward[s | 1 << f]

    def weight(self, state: int, f: int) -> int:
        """Orders that take this edge."""
        return self.forward[state] * self.backward[state | 1 << f]

    def steps(self):
        """(order, step, state before, letter) of every order."""
        for order in itertools.permutations(range(len(self.letters))):
            state = 0
            for i, f in enumerate(order, 1):
                yield "".join(self.letters[x] for x in order), i, state, self.letters[f]
                state |= 1 << f


def measured(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """id, part, name and what the filters ask of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    staged = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("text"), words.alias("words"))
    return staged.select(
        "id", "part", "text", F.unhex(F.sha2("text", 256)).alias("name"),
        F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length("text").cast("long").alias("n_chars"), F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )


def _bits(filters: list) -> Column:
    """Bits of the failed filters that a text alone decides."""
    return sum((F.when(F.expr(cond), 1 << i).otherwise(0) for i, (_, cond) in enumerate(filters) if cond != COPIES), F.lit(0)).cast("int")


def _bits_of_copies(filters: list) -> int:
    return sum(1 << i for i, (_, cond) in enumerate(filters) if cond == COPIES)


def mask_counts(docs: DataFrame, labels: DataFrame, filters: list = FILTERS, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents by the set of filters that they fail."""
    rows = measured(docs, id, text, part).select("id", "part", "name", _bits(filters).alias("mask"))
    # rows without an id match no label: they are dealt out by the names of their texts
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("name"), F.lit(1024))).otherwise(-1))
    marks = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = rows.join(marks.withColumn("spread", F.lit(-1).cast("long")), ["id", "spread"], "left").fillna(False, ["good", "toxic"])
    by_id = marked.groupBy("id", "spread", "name", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))  # the smallest id of these rows, and how many have it
    texts = by_id.groupBy("name", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), first.alias("least"))
    texts = written(texts, "texts")
    found = texts.join(texts.groupBy("name").agg(F.min("least.id").alias("first")), "name")
    heads = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = found.select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(False).alias(COPIES), heads.alias("n")), F.struct(F.lit(True).alias(COPIES), (F.col("n") - heads).alias("n")))).alias("x"))
    whole = split.select("part", "good", "toxic", (F.col("mask") + F.when(F.col("x.is_copy"), _bits_of_copies(filters)).otherwise(0)).alias("mask"), F.col("x.n").alias("n")).filter("n > 0")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return whole.groupBy("part", "mask").agg(F.sum("n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from `mask_counts`: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    lattice, spark = Lattice(letters), counts.sparkSession
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(letters[f]).alias("letter"), F.lit(1 << f).alias("bit"), F.lit(lattice.weight(s, f)).alias("weight")) for s, f in lattice.edges])
    # at most 2 ** len(letters) masks a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("part", "cells", F.explode(edges).alias("e")).select("part", "cells", "e.*")

    def cells(of: str, cond) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(cond(c["mask"]), c[of]).otherwise(0))

    passed = lambda m: m.bitwiseAND(F.col("state")) == 0
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    flows = parts.select(
        "part", "state", "letter", "weight",
        cells("n", lambda m: passed(m) & ~fails(m)).alias("kept"),
        cells("n", lambda m: passed(m) & fails(m)).alias("removed"),
        cells("n", lambda m: ~passed(m) & fails(m)).alias("redundant"),
        cells("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        cells("good", lambda m: passed(m) & fails(m)).alias("good_lost"),
        cells("toxic", lambda m: passed(m) & fails(m)).alias("toxic_lost"),
    )
    # as many rows as the lattice has edges for one letter
    share = F.sum(F.col("weight") * F.col("removed")).over(Window.partitionBy("part", "letter"))
    flows = flows.withColumn("shapley", share)
    steps = spark.createDataFrame(list(lattice.steps()), "filter_order string, step int, state int, letter string")  # len(letters)! * len(letters) rows
    return flows.join(F.broadcast(steps), ["state", "letter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of `documents` under all 120 orders of the five filters."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(mask_counts(docs, labels), "".join(letter for letter, _ in FILTERS))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
      100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd, coalesce(doc_id > least, false) AS fe,
      coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END) || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS failed,
      count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, letter, n, good, toxic, failed, contains(failed, letter) AS fails, len(list_intersect(string_split(failed, ''), string_split(before, ''))) = 0 OR failed = '' OR before = '' AS alive FROM s, f),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (alive AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (alive AND fails), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (NOT alive AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (alive AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (alive AND fails), 0)::BIGINT AS toxic_lost FROM j GROUP BY part, filter_order, step, letter)
SELECT part AS part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
}
