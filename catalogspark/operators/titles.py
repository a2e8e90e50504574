"""Titles, short descriptions, unit spacing, kinds of store categories and the legacy charset, as Column expressions.

Missing and null texts count as empty. Lengths are in characters. Every expression reads one row: no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions import text as T

SEPARATOR = " | "
# Units as met, and as they are written; those without an entry of their own stay as they are.
UNITS = {
    "mg": "mg", "mcg": "mcg", "g": "g", "gr": "g", "grs": "g", "gm": "g", "kg": "kg", "ml": "mL", "l": "L", "lt": "L", "lts": "L", "ui": "UI", "iu": "UI", "cm": "cm", "mm": "mm",
}
KEPT_UNITS = ("ug", "µg")
# Kinds of store categories in the order in which they are tried, on folded names.
STORE_KINDS = (
    ("rx", r"\breceta\b"),
    ("sup", r"vitamin|suplement|probiot|nutri|mineral|colageno"),
    ("cos", r"dermo|cosmet|facial|solar|\bpiel\b"),
    ("dis", r"medicion|termometr|glucom|baumanom|dispositiv|equipo|nebuliz|oximetr"),
    ("otc", r"medicament|analges|gastro|antigripal|antibiot|antiacid|alergia|digestiv"),
    ("hig", r"cuidado personal|higiene|bucal|cabello|panal|toalla|desodorante|bienestar"),
)
# Counted nouns that titles have in small letters.
COUNTED = (
    r"(?<![\p{L}\d-])(\d+)\s+(tabletas?|cápsulas?|capsulas?|piezas?|sobres?|comprimidos?|parches?|pastillas?|gomitas?|unidades|unidad|ampolletas?|plumas?|tiras|lancetas?|grageas?|sachets?|toallitas?|jeringas?|perlas?"
    r"|softgels?|barras?|shots?|chicles?|porciones|viales?)(?![\p{L}])"
)
NAME_LIKE = ("producto", "modelo", "tipo", "componente")
#: What Windows-1252 has in place of the control characters from 0x80 on, and their codes.
LEGACY = {c: chr(b) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def words(c: Column) -> Column:
    return F.filter(F.split(T.fold(c), "[^a-z0-9]+"), lambda w: w != "")


def inside(big: Column, small: Column) -> Column:
    """Whether small has words, all of them words of big."""
    return (F.size(words(small)) > 0) & (F.size(F.array_except(words(small), words(big))) == 0)


def deduped(values: dict[str, Column], brand: Column) -> dict[str, Column]:
    """Name-like fields without the brand before them; of product and type, the one inside the other is emptied (type first)."""
    brand = F.coalesce(brand, F.lit(""))
    out = {k: F.coalesce(c, F.lit("")) for k, c in values.items()}
    for k in NAME_LIKE:
        if k in out:
            led = (brand != "") & F.startswith(T.fold(out[k]), F.concat(T.fold(brand), F.lit(" ")))
            out[k] = F.when(led, F.trim(F.substring(out[k], F.length(brand) + 1, F.length(out[k])))).otherwise(out[k])
    if "producto" in out and "tipo" in out:
        product, kind = out["producto"], out["tipo"]
        both = (product != "") & (kind != "")
        drop_kind = both & inside(product, kind)
        out["tipo"] = F.when(drop_kind, "").otherwise(kind)
        out["producto"] = F.when(both & ~drop_kind & inside(kind, product), "").otherwise(product)
    return out


def capital(c: Column) -> Column:
    """First letter in upper case, but for pH before a number."""
    return F.when(c.rlike(r"^pH(?=\s*\d)"), c).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))


def sentence(c: Column) -> Column:
    """A capital in front, and an end mark; nothing for an empty text."""
    t = capital(F.trim(F.coalesce(c, F.lit(""))))
    return F.when((t == "") | t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def word_count(c: Column) -> Column:
    t = T.tidy(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def small_nouns(c: Column) -> Column:
    """Counted nouns in small letters: `28 CÁPSULAS` is `28 cápsulas`."""
    pieces = F.split(F.regexp_replace(c, f"(?iu){COUNTED}", "$1 \u0002$2\u0003"), "[\u0002\u0003]")
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.lower(p)).otherwise(p)), "")


def segment(text: Column, soft: bool = False) -> Column:
    return F.struct(small_nouns(capital(F.trim(F.coalesce(text, F.lit(""))))).alias("text"), F.lit(soft).alias("soft"))


def title(segments: list[Column], limit: int = 70) -> Column:
    """(title, dropped): segments in order; soft ones go, from the right, while the title is longer than limit."""
    shown = F.filter(F.array(*segments), lambda s: s["text"] != "")
    join = lambda texts: F.array_join(texts, SEPARATOR)
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        out = s["soft"] & (acc["size"] > limit)
        return F.struct(
            F.when(out, acc["kept"]).otherwise(F.concat(F.array(s["text"]), acc["kept"])).alias("kept"),
            F.when(out, F.concat(F.array(s["text"]), acc["dropped"])).otherwise(acc["dropped"]).alias("dropped"),
            F.when(out, acc["size"] - F.length(s["text"]) - len(SEPARATOR)).otherwise(acc["size"]).alias("size"),
        )

    start = F.struct(none.alias("kept"), none.alias("dropped"), F.length(join(F.transform(shown, lambda s: s["text"]))).alias("size"))
    return F.aggregate(F.reverse(shown), start, step, lambda acc: F.struct(join(acc["kept"]).alias("title"), acc["dropped"].alias("dropped")))


def missing(required: dict[str, Column]) -> Column:
    """Labels of required parts that are empty, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(label)) for label, c in required.items()]))


def short_description(items: list[tuple[str, Column, bool]], most: int) -> Column:
    """(text, words, dropped) of (label, text, optional): fixed sentences always, each optional one if it still fits into most words."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), sentence(c).alias("text"), F.lit(optional).alias("optional")) for label, c, optional in items])
    rows = F.filter(F.transform(rows, lambda s: s.withField("n", word_count(s["text"]))), lambda s: s["text"] != "")
    fixed = F.aggregate(F.filter(rows, lambda s: ~s["optional"]), F.lit(0), lambda n, s: n + s["n"])
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        out = s["optional"] & (acc["words"] + s["n"] > most)
        return F.struct(
            F.when(s["optional"] & ~out, acc["words"] + s["n"]).otherwise(acc["words"]).alias("words"),
            F.when(out, acc["texts"]).otherwise(F.concat(acc["texts"], F.array(s["text"]))).alias("texts"),
            F.when(out, F.concat(acc["dropped"], F.array(s["label"]))).otherwise(acc["dropped"]).alias("dropped"),
        )

    start = F.struct(fixed.alias("words"), none.alias("texts"), none.alias("dropped"))
    return F.aggregate(rows, start, step, lambda acc: F.struct(F.array_join(acc["texts"], " ").alias("text"), acc["words"].alias("words"), acc["dropped"].alias("dropped")))


def spaced_units(c: Column, small_ml: bool = False) -> Column:
    """Numbers and units with one blank between them, units as they are written, a decimal comma of one or two digits as a dot. small_ml: `ml` and `l`."""
    t = F.coalesce(c, F.lit(""))
    style = {"mL": "ml", "L": "l"} if small_ml else {}
    for met, written in (*((u, style.get(w, w)) for u, w in UNITS.items()), *((u, "$2") for u in KEPT_UNITS)):
        t = F.regexp_replace(t, rf"(?iu)(\d)\s*({met})(?![\p{{L}}\d])", f"$1 {written}")
    units = "|".join((*dict.fromkeys(UNITS.values()), *KEPT_UNITS))
    t = F.regexp_replace(t, rf"(?iu)(\d),(\d{{1,2}} (?:{units})(?![\p{{L}}\d]))", "$1.$2")
    return F.regexp_replace(t, r"(?<![A-Za-z0-9_])(mg|mcg|g|kg|mL|ml|L|l|UI)\s*/\s*(\d)", "$1 / $2")


def store_kind(name: Column) -> Column:
    """Kind of a store category by its name; otro where no rule fits."""
    folded, out = T.fold(name), F.lit("otro")
    for kind, pattern in reversed(STORE_KINDS):
        out = F.when(folded.rlike(pattern), kind).otherwise(out)
    return out


def legacy_bytes(c: Column) -> Column:
    """(bytes, lost): the text in Windows-1252, with ? for each of the `lost` characters that it does not have."""
    text = F.coalesce(c, F.lit(""))
    known = rf"[\x{{00}}-\x{{7F}}\x{{A0}}-\x{{FF}}{''.join(LEGACY)}]"
    plain = F.regexp_replace(text, known.replace("[", "[^", 1), "?")
    moved = F.translate(plain, "".join(LEGACY), "".join(LEGACY.values()))
    return F.struct(F.encode(moved, "ISO-8859-1").alias("bytes"), F.length(F.regexp_replace(text, known + "+", "")).alias("lost"))
