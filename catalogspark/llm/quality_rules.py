"""Quality rules as a bitmask ledger, with DataFrame expressions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long whose bit r is set
when rule r failed. A policy is a named mask over the bits, so a new version of a policy, or the question what a rule
costs, never measures a text again: verdicts are `fail_bits & mask = 0` and ablations are bitwise aggregates.

Defined cases: a null or empty text has no words and fails rule `few_words`; a null doc_id stays null; repeated rows
are judged each; texts of any length are measured whole; no rows give no rows; only the key, the text and
the columns in `keep` are selected, so other columns of the input cannot clash with the measurements.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import written

#: White space between words: space and bytes 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rule name, failing condition over the measurements. The position is the bit.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
]
BASE = ("few_words", "repeated_words")
#: Policy name to the rules it enforces.
POLICIES = {
    "base-1": BASE,
    "prose-1": tuple(name for name, _ in RULES),
    "lenient-1": ("few_words", "repeated_words", "symbols"),
}
PRODUCTION = "prose-1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask_of(rules) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in rules)


def _repeat_words(grams: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; grams holds a hash of each window in order.

    Windows sorted with their positions put equal ones side by side; the starts of repeated ones, sorted again, cover
    min(3, distance to the next start) words each. Texts without a repeated window skip both sorts.
    """
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def neighbours(s: Column) -> Column:
        like = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    starts = F.transform(F.array(placed), neighbours)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(F.get(F.transform(starts, covered), F.lit(0)))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """One row a document: key, columns in keep, MEASURES (long) and fail_bits (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    empty = F.array().cast("array<string>")
    lines = F.when(F.contains(t, F.lit("\n")), F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")).otherwise(empty)
    staged = docs.select(
        key, *keep,
        F.when(trimmed == "", empty).otherwise(F.split(trimmed, SPLIT)).alias("_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        (trimmed != "").alias("_any"),
    )
    w = F.col("_words")
    n = F.size(w)
    grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    staged = staged.select(
        key, *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        F.when(F.size("_lines") > 0, F.size("_lines")).otherwise(F.when(F.col("_any"), 1).otherwise(0)).cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_grams"),
    )
    measured = staged.withColumn("n_repeat_words", _repeat_words(F.col("_grams")).cast("long")).drop("_grams")
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, cond) in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.select(key, *keep, *MEASURES, bits.alias("fail_bits"))


def passes(policy: str = PRODUCTION) -> Column:
    """Verdict of a policy over a ledger's fail_bits."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(ledgers: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects. One pass, no text read."""
    mask = mask_of(POLICIES[policy])
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    by_bits = ledgers.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    return (
        by_bits.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this"),
        )
    )


def keep_passing(docs: DataFrame, policy: str = PRODUCTION, text: str = "text") -> DataFrame:
    """Rows of documents that pass the policy, with the columns they came with.

    The row number keeps the optimiser from pushing the verdict below the measurements, where each would be computed
    again for every rule that uses it.
    """
    judged = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text")), key="_row")
    return judged.withColumn("_n", F.monotonically_increasing_id()).filter(passes(policy) & (F.col("_n") >= 0)).select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger and production verdict of every document, and how many documents are rejected by its one failed rule alone (0: kept, or several failed)."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    out = written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ledger")
    alone = F.broadcast(ablations(out).filter("n_only_this > 0").select(F.col("bit").alias("fail_bits"), F.col("n_only_this").alias("n_only_this_rule")))  # a row for each rule
    out = out.join(alone, "fail_bits", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes().alias("kept"), "fail_bits", F.coalesce("n_only_this_rule", F.lit(0)).alias("n_only_this_rule"))


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {
    "op8_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS pos, unnest(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:])) AS g FROM w WHERE len(w) >= 3),
h AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM h WHERE c >= 2) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM
      (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (2 * n_symbols > n_words)::INT
      + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 25 * n_words)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits,
      CASE WHEN bit_count(fail_bits) = 1 THEN count(*) OVER (PARTITION BY fail_bits) ELSE 0 END AS n_only_this_rule FROM b
"""
}
