"""Normal forms of captured fields: letter case, units, packs, misplaced quantities, and forms with their packs.

Expressions over one row. Texts are taken in one line; null and empty texts stay empty. What a text in capitals keeps in
capitals comes from a list of words (`keep`, lower case), such as brands.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.functions.session import sealed
from catalogspark.operators.language import edged
from catalogspark.operators.schema import FIELDS
from catalogspark.operators.titles import capital, spaced_units

# Words that stay small in a name, words that stay in capitals, units, and vowels.
SMALL_WORDS = ("de", "del", "la", "el", "y", "e", "o", "con", "para", "en", "por", "sin", "a", "al", "los", "las", "un", "una")
CAPITALS = ("fps", "spf", "uva", "uvb", "uv", "pao", "inci")
UNITS = ("ug", "ui", "iu", "mg", "mcg", "g", "gr", "grs", "ml", "kg", "l", "lt", "cm", "mm")
VOWEL = "(?iu)[aeiouyáéíóúü]"
# Shortened words of packs in the order in which they are written out.
SHORT_WORDS = (
    (r"\bCAJ(?:A)?\.?(?![\p{L}])", "Caja"),
    (r"\bFCO\.?(?![\p{L}])", "Frasco"),
    (r"\bTABS?\.?(?![\p{L}])", "tabletas"),
    (r"\bCAPS?\.?(?![\p{L}])", "cápsulas"),
    (r"\bCOMP\.?(?![\p{L}])", "comprimidos"),
    (r"\bAMP\.?(?![\p{L}])", "ampolletas"),
    (r"\bPZAS?\.?(?![\p{L}])", "piezas"),
    (r"\bPZ\.?(?![\p{L}])", "piezas"),
    (r"\bGRAG\.?(?![\p{L}])", "grageas"),
    (r"\bSOL\.?(?![\p{L}])", "Solución"),
    (r"\bINY\.?(?![\p{L}])", "inyectable"),
    (r"\bSUSP\.?(?![\p{L}])", "Suspensión"),
    (r"\bJBE\.?(?![\p{L}])", "Jarabe"),
    (r"\bC\/\s*(\d+)", "con $1"),
    (r"(?<!\d\s{0,8})\bX\s*(\d+)", "con $1"),
)
SINGULAR = {"piezas": "pieza", "tabletas": "tableta", "cápsulas": "cápsula", "comprimidos": "comprimido", "ampolletas": "ampolleta", "grageas": "gragea"}
COUNTED_FORM = r"^(c[aá]psulas?|tabletas?|comprimidos?|grageas?|pastillas?|perlas?|softgels?|parches?|supositorios?|[oó]vulos?|gomitas?|gomas?|sobres?|tiras?|pastillas?|chicles?)\b"
CONTAINER = "(?:caja|frasco|bl[ií]ster|bolsa|tubo|envase|estuche|blister)s?"
# A container with its quantity, a quantity alone, a carton of cans; the field that names the product by category.
CONTAINER_OF = (
    r"^((?:frasco|botella|tubo|bote|caja|sobre|bolsa|lata|tarro|estuche|pomo|dispensador|ampolleta|atomizador|spray|stick|pump|paquete|barra)s?"
    r"(?:\s+(?:con|de)\s+(?:gotero|bomba|dosificador|atomizador|aplicador|spray|pistola|v[aá]lvula|pump))?)\s*(?:de|con)?\s*(\d.*)$"
)
QUANTITY = (
    r"(?:(?:frasco|caja|botella|bolsa|sobre|lata|tubo|bote|paquete)s?\s+(?:con|de)?\s*)?\d+(?:[.,]\d+)?\s*"
    r"(?:ml|l|g|kg|piezas?|pzas?|pz|tabletas?|c[aá]psulas?|sobres?|unidades?|gomitas?|ampolletas?|tiras?)\b"
)
QUANTITY_AT_END, QUANTITY_ALONE = rf"\s*[-–,(]?\s*({QUANTITY})\s*\)?\s*$", rf"^\s*{QUANTITY}\s*$"
CARTON = r"^(caja|paquete|pack|fardo|bolsa)s?\s+(?:con|de)\s+(\d+)\s+(latas?|botellas?|botellitas?|piezas|sobres|bricks?|tetrabriks?)\s+de\s+(\d.*)$"
COUNT_WORD = r"\b(?:[uú]nic[oa]|par|kit|pieza|unidad)\b"
NAMING_FIELD = {"sup": "componente", "cos": "tipo", "beb": "tipo", "hig": "producto", "acc": "producto"}
WITH_CONTAINER = ("cos", "hig", "beb", "acc")

def _re(pattern: str) -> str:
    """Whatever the case; \\b and \\w go by ASCII and $ is the very end."""
    return "(?iu)" + edged(pattern).replace("$", r"\z")


def one_line(c: Column) -> Column:
    return T.tidy(c)


def in_capitals(c: Column) -> Column:
    return c.rlike(r"\p{L}") & (F.upper(c) == c)


def fixed_case(c: Column, keep: list[str], sentence: bool = False) -> Column:
    """A text in capitals as a name, each word with a capital, or as words of a sentence; other texts stay."""

    def word(w: Column, i: Column, parts: Column) -> Column:
        low, before, after = F.lower(w), F.coalesce(F.get(parts, i - 1), F.lit("")), F.coalesce(F.get(parts, i + 1), F.lit(""))
        stays = low.isin(*keep, *CAPITALS) | ((low == "ci") & after.rlike(r"^\s*\d")) | (low.isin(*UNITS) & before.rlike(r"\d\s*\z")) | ((F.length(w) <= 3) & ~w.rlike(VOWEL))
        small = low.isin(*SMALL_WORDS) & (i > 0)
        shaped = low if sentence else F.when(small, low).otherwise(F.concat(F.substring(w, 1, 1), F.substring(low, F.lit(2), F.length(low))))
        return F.when(~w.rlike(r"^\p{L}") | stays, w).otherwise(shaped)

    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    rebuilt = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(p, lambda w, i: word(w, i, p)), "")), F.lit(0))
    return F.when(in_capitals(c), rebuilt).otherwise(c)


def sentence_case(c: Column, keep: list[str]) -> Column:
    """A text in capitals as sentences; other texts stay."""
    pieces = F.split(fixed_case(c, keep, True), r"(?<=[.!?]\s{1,8})")
    return F.when(in_capitals(c), F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")).otherwise(c)


def expanded_pack(c: Column) -> Column:
    """A pack written out: `CAJ C/30 TAB` is `Caja con 30 tabletas`; a bare number counts pieces; one is singular."""
    s = c
    for pattern, becomes in SHORT_WORDS:
        s = F.regexp_replace(s, _re(pattern), becomes)
    s = F.regexp_replace(s, _re(r"\bcon (\d+)\s*$"), "con $1 piezas")
    s = F.get(F.transform(F.array(s), lambda x: F.when(x.rlike(_re(r"^con\b")), F.concat(F.lit("Caja "), x)).otherwise(x)), F.lit(0))
    s = F.get(F.transform(F.array(F.trim(s)), lambda x: F.when(x.rlike(r"^\d+(?:[.,]\d+)?\z"), F.concat(x, F.lit(" piezas"))).otherwise(x)), F.lit(0))
    for plural, one in SINGULAR.items():
        s = F.regexp_replace(s, _re(rf"(?<![\d.,])1\s+{plural}(?![\p{{L}}])"), f"1 {one}")
    return F.get(F.transform(F.array(F.trim(s)), capital), F.lit(0))


def pieces_of_form(form: Column, content: Column) -> Column:
    """`28 Cápsulas` for a counted form and a content that only counts pieces; empty otherwise."""
    f, c = F.trim(F.coalesce(form, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    head = F.regexp_extract(f, _re(COUNTED_FORM), 1)
    base = F.substring(F.regexp_replace(F.regexp_replace(T.fold(head), r"e?s\z", ""), r"s\z", ""), 1, 5)
    whole = F.concat(F.lit(_re(rf"^(?:{CONTAINER}\s*(?:con|de|x)?\s*)?(\d+)\s*(?:piezas?|pzas?\.?|unidades|uds?\.?|")), base, F.lit(_re(r"\w*)?\.?$").removeprefix("(?iu)")))
    n = F.when(head != "", F.call_function("regexp_extract", c, whole, F.lit(1))).otherwise("")
    one = F.regexp_replace(F.regexp_replace(head, r"(?iu)(?<=[aeiou])s\z", ""), r"(?iu)es\z", "")
    many = F.when(head.rlike(r"(?iu)s\z"), head).otherwise(F.concat(head, F.when(head.rlike(r"(?iu)[aeiou]\z"), "s").otherwise("es")))
    number = F.regexp_replace(n, r"^0+(?=\d)", "")
    return F.when((n == "") | (number == "0"), "").otherwise(F.concat(number, F.lit(" "), F.when(number == "1", one).otherwise(many), F.substring(f, F.length(head) + 1, F.length(f))))


def form_and_content(form: Column, content: Column, by_piece: bool = False, supplement: bool = False) -> Column:
    """The form and the content as a title has them together. by_piece: `28 Cápsulas`; supplement: that, and `Líquido 200 mL`."""
    f, c = F.coalesce(form, F.lit("")), F.coalesce(content, F.lit(""))
    if supplement:
        f = F.regexp_replace(f, r"(?iu)^bebibles?\z", "Líquido")
    low = F.regexp_replace(F.lower(f), r"s\z", "")
    out = F.when(F.contains(F.lower(c), low), c).otherwise(F.concat(f, F.lit(", "), c))
    if supplement:
        said = F.array_contains(F.split(low, r"\s+"), F.lower(F.trim(c)))
        out = F.when(F.trim(c).rlike(r"^\d") & ~said, F.concat(f, F.lit(" "), F.trim(c))).otherwise(out)
    if by_piece or supplement:
        counted = pieces_of_form(f, c)
        out = F.when(counted != "", counted).otherwise(out)
    return F.when(f == "", c).when(c == "", f).otherwise(out)


def _no_quantity(c: Column) -> Column:
    return ~c.rlike(r"\d") & ~c.rlike(_re(COUNT_WORD))


def placed(cat: Column, values: Column) -> Column:
    """(field, name, content, container, shown): the naming field and quantities where they belong; `field` is null where the category has none.

    A quantity in the field that names the product is its content; a content without a quantity is its name; two that are the wrong
    way round change places; strengths stay. `Frasco con gotero de 30 mL` is a container and a quantity.
    """
    raw = lambda k: F.coalesce(values[k], F.lit(""))
    naming = F.when(cat.isin("hig", "acc") & (raw("tipo") != ""), F.lit("tipo")).otherwise(F.create_map(*[F.lit(x) for pair in NAMING_FIELD.items() for x in pair])[cat])
    name, content = one_line(F.coalesce(F.element_at(values, naming), F.lit(""))), one_line(raw("contenido"))
    hit = lambda c, p: c.rlike(_re(p))

    def moved(s: Column) -> Column:
        t, n = s["t"], s["n"]
        alone, at_end = hit(t, QUANTITY_ALONE), hit(t, QUANTITY_AT_END)
        rest, quantity = F.trim(F.regexp_replace(t, _re(QUANTITY_AT_END), "")), F.trim(F.regexp_extract(t, _re(QUANTITY_AT_END), 1))
        pair = lambda a, b: F.struct(a.alias("t"), b.alias("n"))
        by_end = F.when(rest != "", pair(rest, F.when(n == "", quantity).otherwise(n))).otherwise(pair(t, n))
        by_alone = F.when(n == "", pair(F.lit(""), t)).when(_no_quantity(n), pair(n, t)).otherwise(pair(t, n))
        return F.when((t != "") & alone, by_alone).when((t != "") & at_end, by_end).when((t == "") & (n != "") & _no_quantity(n), pair(n, F.lit(""))).otherwise(pair(t, n))

    def held(s: Column) -> Column:
        n, env = s["n"], F.trim(raw("envase"))
        carton = (cat == "beb") & (env == "") & hit(n, CARTON)
        part = lambda p, i: F.regexp_extract(n, _re(p), i)
        boxed = F.concat(capital(F.lower(part(CARTON, 1))), F.lit(" con "), part(CARTON, 2), F.lit(" "), F.lower(part(CARTON, 3)))
        single = cat.isin(*WITH_CONTAINER) & (env == "") & hit(n, CONTAINER_OF)
        out = lambda n_, e: F.struct(s["t"].alias("name"), n_.alias("content"), e.alias("container"))
        return (
            F.when(carton, out(F.concat(part(CARTON, 2), F.lit(" x "), F.trim(part(CARTON, 4))), boxed))
            .when(single, out(F.trim(part(CONTAINER_OF, 2)), one_line(part(CONTAINER_OF, 1))))
            .otherwise(out(n, env))
        )

    first = F.transform(F.array(F.struct(name.alias("t"), content.alias("n"))), moved)
    found = F.get(F.transform(first, held), F.lit(0))
    show = one_line(raw("presentacion"))
    device = (cat == "dis") & (content == "") & hit(show, CONTAINER_OF)
    return F.struct(
        F.when(cat != "dis", naming).alias("field"),
        F.when(device, F.trim(F.regexp_extract(show, _re(CONTAINER_OF), 2))).when(cat == "dis", content).otherwise(found["content"]).alias("content"),
        found["name"].alias("name"),
        found["container"].alias("container"),
        F.when(device, F.trim(F.regexp_extract(show, _re(CONTAINER_OF), 1))).otherwise(show).alias("shown"),
        device.alias("device"), name.alias("was_name"), content.alias("was_content"), show.alias("was_shown"),
    )


CHANGE = "array<struct<field:string,from:string,to:string>>"


def repair_swapped_fields(products: DataFrame) -> DataFrame:
    """products (cat, v) with v repaired by `placed`, and `repairs`, what moved, as (field, from, to)."""
    p, none = F.col("placed"), F.array().cast(CHANGE)
    change = lambda when, k, a, b: F.when(when, F.struct(k.alias("field"), a.alias("from"), b.alias("to")))
    env = F.trim(F.coalesce(F.col("v")["envase"], F.lit("")))
    boxed = F.col("cat").isin(*WITH_CONTAINER) & (p["container"] != env)
    renamed, refilled = p["name"] != p["was_name"], p["content"] != p["was_content"]
    source = F.when(p["was_content"] != "", p["was_content"]).otherwise(p["was_name"])
    empty = lambda c: F.when(c == "", F.lit("(vacío)")).otherwise(c)
    moves = F.array_compact(F.array(change(boxed, F.lit("envase"), p["was_content"], p["container"]), change(renamed, p["field"], p["was_name"], empty(p["name"])), change(refilled, F.lit("contenido"), source, empty(p["content"]))))
    split = F.array(F.struct(F.lit("presentacion").alias("field"), p["was_shown"].alias("from"), p["shown"].alias("to")), F.struct(F.lit("contenido").alias("field"), p["was_shown"].alias("from"), p["content"].alias("to")))
    out = products.withColumn("placed", placed(F.col("cat"), F.col("v"))).withColumn("repairs", F.when(p["device"], split).when(p["field"].isNotNull(), moves).otherwise(none))
    pair = lambda k, c: F.struct(k.alias("key"), c.alias("value"))
    news = F.when(p["device"], F.array(pair(F.lit("presentacion"), p["shown"]), pair(F.lit("contenido"), p["content"])))
    news = news.otherwise(F.array_compact(F.array(pair(p["field"], p["name"]), pair(F.lit("contenido"), p["content"]), F.when(F.col("cat").isin(*WITH_CONTAINER), pair(F.lit("envase"), p["container"])))))
    fresh = F.map_from_entries(F.when(F.size("repairs") > 0, news).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    merged = F.map_concat(F.map_filter("v", lambda k, _: ~F.array_contains(F.map_keys("fresh"), k)), F.map_filter("fresh", lambda _, x: x != ""))
    return sealed(out.withColumn("fresh", fresh).withColumn("v", merged).drop("placed", "fresh"))


def normal_form(value: Column, kinds: Column, keep: list[str], small_ml: bool = False) -> Column:
    """A captured value as its kind of field has it."""
    has = lambda k: F.array_contains(kinds, k)
    raw = F.coalesce(value, F.lit(""))
    t = one_line(raw)
    lines = F.array_join(F.filter(F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != ""), "\n")
    units = lambda c: spaced_units(c, small_ml)
    plain = F.regexp_replace(units(fixed_case(t, keep)), _re(r"\bP[Hh](?=\s*\d)").replace("(?iu)", ""), "pH")
    pack = F.regexp_replace(units(expanded_pack(fixed_case(t, keep, True))), _re(r"\bP[Hh](?=\s*\d)").replace("(?iu)", ""), "pH")
    return (
        F.when(has("select"), raw).when(has("lines"), lines).when(t == "", "").when(has("model"), t).when(has("code"), F.regexp_replace(F.upper(t), r"\s+", ""))
        .when(has("raw"), t).when(has("sentence"), units(sentence_case(t, keep))).when(has("pack"), pack).otherwise(plain)
    )


def normalize_fields(products: DataFrame, keep: list[str] = (), small_ml: bool = False) -> DataFrame:
    """products (cat, v) with v repaired and in normal form, and `changes` (field, from, to); fields that a category does not have, and empty ones, are left out.

    An unknown category has no fields.
    """
    known = F.create_map(*[x for cat, fields in FIELDS.items() for x in (F.lit(cat), F.array(*[F.struct(F.lit(k).alias("key"), F.split(F.lit(kinds), " ").alias("kinds")) for k, _, _, kinds in fields]))])
    fields = F.coalesce(known[F.col("cat")], F.array().cast("array<struct<key:string,kinds:array<string>>>"))
    each = F.transform(fields, lambda f: F.struct(f["key"].alias("key"), one_line(F.coalesce(F.element_at("v", f["key"]), F.lit(""))).alias("was"), normal_form(F.element_at("v", f["key"]), f["kinds"], list(keep), small_ml).alias("value"), f["kinds"].alias("kinds")))
    out = repair_swapped_fields(products).withColumn("each", each)
    told = F.filter("each", lambda e: (e["was"] != "") & (e["value"] != e["was"]) & ~F.array_contains(e["kinds"], "select") & ~F.array_contains(e["kinds"], "lines"))
    changes = F.concat("repairs", F.transform(told, lambda e: F.struct(e["key"].alias("field"), e["was"].alias("from"), e["value"].alias("to"))))
    v = F.map_from_entries(F.transform(F.filter("each", lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(e["key"], e["value"])))
    return sealed(out.withColumns({"v": v, "changes": changes}).drop("each", "repairs"))


