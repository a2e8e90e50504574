"""Text keys, tests and similarity as Column expressions."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def marked_letters() -> dict[str, str]:
    """Letters that canonical decomposition takes apart into one character and marks of U+0300 to U+036F."""
    out = {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xF900, 0x10000))):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not MARKS[0] <= x <= MARKS[1])
        if bare != c and len(bare) == 1:
            out[c] = bare
    return out


MARKS = "\u0300", "\u036f"
LETTERS = marked_letters()


def field(values: Column, key: str) -> Column:
    """A captured field; missing, null and blank are the same empty text."""
    return F.coalesce(F.trim(values[key]), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case without accents and other combining marks."""
    bare = F.translate(F.coalesce(c.cast("string"), F.lit("")), "".join(LETTERS), "".join(LETTERS.values()))
    return F.lower(F.regexp_replace(bare, f"[{MARKS[0]}-{MARKS[1]}]+", ""))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def compact(c: Column) -> Column:
    return F.replace(clean(c), F.lit(" "), F.lit(""))


def identity(c: Column) -> Column:
    """Normalised value of an entity: folded, micro sign as u, only letters, digits and % . / + kept."""
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("µ"), F.lit("u")), r"[^a-z0-9%./+]+", " "))


# White space beyond ASCII, as ECMAScript has it.
WIDE_SPACE = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def tidy(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[\s{WIDE_SPACE}]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on compact forms; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


# What counts as a number with a unit, and as a negative number.
def numeric_like(c: Column) -> Column:
    return F.trim(c).rlike(r"(?i)^-?\s*\d+(?:[.,]\d+)?(?:\s*(?:mg|mcg|µg|ug|g|gr|grs|gm|kg|ml|l|ui|iu|cm|mm|%))?(?:\s*/\s*.*)?$")


def negative_number(c: Column) -> Column:
    return c.rlike(r"(^|[^\p{L}\d])-\s*\d")


def repeated_words(c: Column) -> Column:
    """Whether a word of four letters or more, not a number, stands twice."""
    words = F.filter(F.split(clean(c), " "), lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\d+$"))
    return F.size(words) > F.size(F.array_distinct(words))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619) % 4294967296)
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def signature(values: Column) -> Column:
    """Signature of a product's data: its fields that are not empty, sorted."""
    entries = F.filter(F.map_entries(values), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    return F.xxhash64(F.to_json(F.array_sort(entries)))
