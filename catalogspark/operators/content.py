"""Content rules: does a product's record, and the texts made from it, say what a buyer needs, without contradicting itself?

Rows are products (product_id, cat, v, mc, html): captured fields, the short description and the long one in HTML, either of
which may be empty. The rules are the rows of RULES (`rules`); their inputs are measured once for each product.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.functions.session import sealed
from catalogspark.operators import rules
from catalogspark.operators.extraction import flat
from catalogspark.operators.language import ASCII_WORD, COMMERCIAL, edged, matches, terms_found
from catalogspark.operators.rules import Rule
from catalogspark.operators.schema import CATEGORY_FIELDS, FIELDS

# What a buyer must know by category, a|b being satisfied by either; fields that state the presentation; fields that the long text uses.
INFO = {
    "med": {"identity": ("marca", "principio"), "technical": ("concentracion", "forma", "via"), "origin": ("laboratorio",)},
    "dis": {"identity": ("marca", "modelo", "tipo"), "technical": ("tecnologia|uso|caracteristicas",), "origin": ("fabricante",)},
    "cos": {"identity": ("marca", "producto|tipo"), "technical": ("atributo|beneficio|fps",), "origin": ("fabricante",)},
    "sup": {"identity": ("marca", "componente"), "technical": ("forma",), "origin": ("fabricante",)},
    "beb": {"identity": ("marca", "tipo"), "technical": ("sabor|atributo|beneficio",), "origin": ("fabricante",)},
    "hig": {"identity": ("marca", "producto|tipo"), "technical": ("beneficio|variante|uso",), "origin": ("fabricante",)},
    "acc": {"identity": ("marca", "producto|tipo"), "technical": ("material|uso|caracteristicas|queEs",), "origin": ("fabricante",)},
}
PRESENTATION = {"dis": ("paquete", "presentacion")}
LONG_TEXT_FIELDS = {
    "med": ("marca", "principio", "concentracion", "forma", "via", "contenido", "laboratorio"),
    "dis": ("marca", "modelo", "tipo", "tecnologia", "fabricante", "uso", "caracteristicas", "paquete", "presentacion"),
    "cos": ("marca", "producto", "tipo", "beneficio", "contenido", "fabricante", "piel", "textura"),
    "sup": ("marca", "componente", "forma", "contenido", "fabricante"),
    "beb": ("marca", "tipo", "contenido", "sabor", "fabricante"),
    "hig": ("marca", "producto", "tipo", "beneficio", "contenido", "fabricante", "publico"),
    "acc": ("marca", "producto", "tipo", "uso", "material", "contenido", "fabricante"),
}
IDENTIFIERS = ("principio", "modelo", "producto", "componente", "tipo")
# Known forms, units and containers, fillers, short words; families of forms and routes, on folded texts.
FORM = (
    r"l[ií]quid[oa]|shot\b|gomit|granulad|tablet|comprim|c[aá]psul|gragea|perla|gr[aá]nul|jarabe|soluci[oó]n|suspensi[oó]n|emulsi[oó]n|inyect|ampoll?eta|ampolla|vial|pluma|jeringa|cartucho|crema|gel\b|ung[uü]ento|pomada"
    r"|loci[oó]n|parche|supositor|[oó]vulo|polvo|gotas|spray|aerosol|inhalad|shampoo|champ[uú]|colirio|enjuague|barra|sobre|pastilla|chicle|liofiliz|implante|aceite|espuma|toallita|mascarilla|s[eé]rum|serum|bruma|t[oó]nico"
    r"|bals[aá]mico|elixir|tintura|pasta|film|pel[ií]cula|lengüeta|disco|anillo|dispositivo|kit"
)
UNIT = (
    r"\b(?:mg|mcg|µg|g|gr|grs|kg|ml|l|lt|oz|ui|iu|cm|mm|m)\b|pieza|pza|unidad|tableta|c[aá]psula|comprimido|gragea|perla|caja|sobre|frasco|pluma|ampoll?eta|ampolla|jeringa|vial|tubo|bolsa|botella|lata|par\b|kit|toallita|parche"
    r"|supositorio|[oó]vulo|disco|lanceta|tira|dosis|pastilla|gomita|cartucho|bote|barra|paquete|rollo|spray|aplicador|sachet|dispositivo|set|juego|pack|blister|capa"
)
FILLER = r"\b(?:lorem|ipsum|n\/a|n\.a\.|s\/d|sin datos?|por definir|por completar|pendiente|xxx+|tbd|null|undefined)\b|\?\?\?"
SHORT = r"\b(?:TABS?|CAJ|CJA|FCO|AMP|SUSP|SOL|COMP|CAPS|PZAS?|PZ|C\/U|SOB)\b|\bc\/\s?\d"
FORM_FAMILIES = (
    ("otra", r"vaginal|rectal|oftalm|ocular|otic|nasal|oral\b.*topic|topic.*oral"),
    ("inyectable", r"inyect|ampoll?eta|ampolla|vial|pluma|jeringa|cartucho|liofiliz"),
    ("oral", r"tablet|comprim|capsul|gragea|perla|granul|pastilla|chicle|sobre"),
    ("topica", r"crema|gel\b|unguento|pomada|locion|parche|espuma|shampoo|champu"),
)
ROUTE_FAMILIES = (
    ("inyectable", r"subcut|intraven|intramusc|intraderm|parenteral|inyect|intravit|epidural"),
    ("oral", r"\boral\b|sublingual|bucal|via oral"),
    ("topica", r"topic|cutane|dermic|transderm"),
)
FREE_SALE, ON_PRESCRIPTION = r"\b(?:venta libre|sin receta|no requiere receta)\b", r"(?<!no )(?<!sin )\b(?:requiere receta|con receta|bajo receta)"
DOSE = r"(\d+(?:[.,]\d+)?)\s*(mg|mcg|µg|ug|g|ui|iu)\b"
LEGAL_TWINS, PORTION_TWINS = ("principio", "fabricante", "laboratorio"), ("contenido", "porcion")


def _lacks(group: str) -> str:
    """SQL: whether the category's information of a group is missing."""
    one = lambda spec: " AND ".join(f"{{{k}}} = ''" for k in spec.split("|"))
    return "CASE cat " + " ".join(f"WHEN '{c}' THEN " + " OR ".join(f"({one(s)})" for s in groups[group]) for c, groups in INFO.items()) + " END"


#: Rule, dimension, weight, severity, kind, when it fails, when it applies, for which categories.
RULES = [
    Rule("CMP-001", "completitud", 6, "error", "faltante", _lacks("identity")),
    Rule("CMP-002", "completitud", 8, "warning", "faltante", _lacks("technical")),
    Rule("CMP-003", "completitud", 6, "warning", "faltante", _lacks("origin")),
    Rule("FT-001", "fichaTecnica", 5, "error", "faltante", "NOT has_list", "html <> ''"),
    Rule("FT-002", "fichaTecnica", 6, "warning", "contenido", "size(lost_fields) > 0", "html <> ''"),
    Rule("FT-003", "fichaTecnica", 4, "warning", "contenido", "empty_entries", "html <> ''"),
    Rule("DES-001", "descripcion", 3, "error", "faltante", "mc = ''"),
    Rule("DES-002", "descripcion", 4, "warning", "contenido", "unnamed_mc OR unnamed_plain", "{marca} <> ''"),
    Rule("DES-003", "descripcion", 3, "warning", "contenido", "has_filler"),
    Rule("PRE-001", "presentacion", 5, "warning", "faltante", "size(presented) = 0 OR NOT any_quantity"),
    Rule("PRE-002", "presentacion", 5, "warning", "contenido", "NOT known_form", "{forma} <> ''", ("med", "sup")),
    Rule("COH-C01", "coherencia", 5, "error", "contradiccion", "form_family <> 'otra' AND route_family <> 'otra' AND form_family <> route_family", "{forma} <> '' AND {via} <> ''", ("med",)),
    Rule("COH-C02", "coherencia", 4, "error", "contradiccion", "({receta} = 'si' AND says_free) OR ({receta} = 'no' AND says_prescription)", "{receta} <> ''", ("med",)),
    Rule("COH-C03", "coherencia", 3, "warning", "contradiccion", "other_dose", "size(doses) > 0", ("med",)),
    Rule("COH-C04", "coherencia", 3, "warning", "contradiccion", "form_family = 'oral'", "{volumen} <> '' AND {forma} <> ''", ("med",)),
    Rule("SEG-001", "seguridad", 5, "error", "faltante", "CASE WHEN cat = 'med' THEN {receta} = '' ELSE {modo} = '' OR {precauciones} = '' END", "cat = 'med' OR (cat = 'cos' AND {fps} <> '')"),
    Rule("SEG-002", "seguridad", 5, "warning", "contenido", "CASE WHEN cat = 'med' THEN NOT warns ELSE NOT shows_care END", "html <> '' AND (cat = 'med' OR (cat = 'cos' AND {fps} <> '' AND {precauciones} <> ''))"),
    Rule("SEG-003", "seguridad", 0, "info", "mejora", "NOT keeps", "html <> ''", ("med",)),
    Rule("CLA-001", "claridad", 4, "warning", "contenido", "size(shortened) > 0"),
    Rule("CLA-002", "claridad", 3, "warning", "contenido", "size(shouted) > 0"),
    Rule("CLA-003", "claridad", 3, "warning", "contenido", "size(repeated) > 0"),
    Rule("CLM-001", "claims", 6, "error", "contenido", "exists(terms, t -> t.list = 'claim')"),
    Rule("CLM-002", "claims", 4, "warning", "contenido", "exists(terms, t -> t.list <> 'claim') OR (cat = 'med' AND sells)"),
]


def _has(c: Column, pattern: str) -> Column:
    return matches(c, pattern)


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(flat(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def plain_text(html: Column) -> Column:
    """Text of HTML without tags and entities."""
    return T.tidy(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"(?i)&[a-z#0-9]+;", " "))


def _family(c: Column, families) -> Column:
    out = F.lit("otra")
    for name, pattern in reversed(families):
        out = F.when(_has(c, pattern), name).otherwise(out)
    return out


def doses(c: Column) -> Column:
    """(n, unit) of the doses that a text states."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?iu)" + edged(DOSE)), 0)
    unit = lambda x: F.lower(F.regexp_extract(x, r"([^\d\s.,]+)\z", 1))
    same = lambda u: F.when(u.isin("ug", "µg"), "mcg").when(u == "iu", "ui").otherwise(u)
    return F.transform(found, lambda x: F.struct(F.replace(F.regexp_extract(x, r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).cast("double").alias("n"), same(unit(x)).alias("unit")))


def measured(products: DataFrame) -> DataFrame:
    """products with what the rules ask of them."""
    f = lambda k: F.coalesce(F.col("f")[k], F.lit(""))
    keys = lambda of: F.create_map(*[x for c, names in of.items() for x in (F.lit(c), F.array(*map(F.lit, names)))])[F.col("cat")]
    value = lambda k: F.coalesce(F.element_at("f", k), F.lit(""))
    rows = rules.captured(products).withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("mc", "html")})
    rows = rows.filter(F.col("cat").isin(*FIELDS) & (F.size("f") > 0)).withColumn("plain", plain_text(F.col("html")))
    rows = rows.withColumns({"mc_letters": alnum(F.col("mc")), "plain_letters": alnum(F.col("plain"))})
    says = lambda text, part: (alnum(part) != "") & F.contains(text, alnum(part))
    own = F.create_map(*[x for c, names in CATEGORY_FIELDS.items() for x in (F.lit(c), F.array(*[F.lit(k) for k in IDENTIFIERS if k in names]))])[F.col("cat")]
    rows = rows.withColumn("identifier", F.coalesce(F.get(F.filter(F.transform(own, value), lambda x: x != ""), F.lit(0)), F.lit("")))
    unnamed = lambda text, letters: (F.col(text) != "") & (~says(F.col(letters), f("marca")) | ((F.col("identifier") != "") & ~says(F.col(letters), F.col("identifier"))))
    shown = F.filter(F.transform(keys({c: PRESENTATION.get(c, ("contenido",)) for c in FIELDS}), value), lambda x: x != "")
    quantity = lambda x: x.rlike(r"\d") & (x.rlike(r"^\s*\d+(?:[.,]\d+)?\s*\z") | _has(x, UNIT))
    form, route = F.lower(flat(f("forma"))), F.lower(flat(f("via")))
    texts = [f("leyenda"), F.col("mc"), F.col("plain")]
    any_of = lambda pattern: F.greatest(*[_has(t, pattern) for t in texts])
    letters = lambda x: F.regexp_replace(x, "[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ]", "")
    loud = lambda x: (F.length(letters(x)) >= 8) & (F.length(F.regexp_replace(letters(x), "[^A-ZÁÉÍÓÚÜÑ]", "")) >= 0.8 * F.length(letters(x)))
    free = keys({c: [k for k, _, _, kinds in fields if k != "marca" and not {"select", "raw"} & set(kinds.split())] for c, fields in FIELDS.items()})
    plain = keys({c: [k for k, _, _, kinds in fields if "select" not in kinds.split()] for c, fields in FIELDS.items()})
    entries = F.transform(plain, lambda k: F.struct(k.alias("k"), F.regexp_replace(F.lower(flat(value(k))), r"\s+", " ").alias("t")))
    entries = F.filter(entries, lambda e: (F.length(e["t"]) >= 3) & ~e["t"].rlike(r"^[\d\s.,]+\z"))
    rows = rows.withColumns({"entries": entries, "doses": doses(f("concentracion"))})
    first = lambda e: F.get(F.filter("entries", lambda o: o["t"] == e["t"]), F.lit(0))["k"]
    fair = lambda a, b: ((a == "marca") & b.isin(*LEGAL_TWINS)) | ((b == "marca") & a.isin(*LEGAL_TWINS)) | (a.isin(*PORTION_TWINS) & b.isin(*PORTION_TWINS))
    others = F.concat(doses(f("leyenda")), doses(f("contenido")))
    same_unit = lambda x: F.filter("doses", lambda d: d["unit"] == x["unit"])
    notice = F.concat(F.col("plain_letters"), F.col("mc_letters"))
    out = rows.withColumns({
        "has_list": F.col("html").rlike(r"(?i)<ul[\s>][\s\S]*?<li[\s>]"),
        "lost_fields": F.filter(keys(LONG_TEXT_FIELDS), lambda k: (value(k) != "") & ~says(F.col("plain_letters"), value(k))),
        "empty_entries": F.col("html").rlike(r"(?i)<li[^>]*>\s*<strong>([^<]*)</strong>\s*</li>"),
        "unnamed_mc": unnamed("mc", "mc_letters"), "unnamed_plain": unnamed("plain", "plain_letters"),
        "has_filler": F.exists(F.map_values("v"), lambda x: _has(F.coalesce(x, F.lit("")), FILLER)) | _has(F.col("mc"), FILLER) | _has(F.col("plain"), FILLER),
        "presented": shown, "any_quantity": F.exists(shown, quantity),
        "known_form": _has(form, FORM) | _has(f("forma"), FORM), "form_family": _family(form, FORM_FAMILIES), "route_family": _family(route, ROUTE_FAMILIES),
        "says_free": any_of(FREE_SALE), "says_prescription": any_of(ON_PRESCRIPTION),
        "other_dose": F.exists(others, lambda x: (F.size(same_unit(x)) > 0) & ~F.exists(same_unit(x), lambda d: d["n"] == x["n"])),
        "warns": F.contains(notice, F.lit("consulteasumedico")) & F.contains(notice, F.lit("automedic")), "shows_care": says(F.col("plain_letters"), f("precauciones")),
        "keeps": _has(F.col("plain"), r"condiciones de conservaci[oó]n"),
        "shortened": F.filter(F.array(*map(F.lit, ("forma", "contenido", "presentacion", "paquete", "tipo"))), lambda k: value(k).rlike(edged(SHORT, ASCII_WORD))),
        "shouted": F.filter(free, lambda k: loud(value(k))),
        "repeated": F.filter("entries", lambda e: (first(e) != e["k"]) & ~fair(first(e), e["k"])),
        "terms": F.concat(terms_found(F.col("mc"), F.col("cat")), terms_found(F.col("plain"), F.col("cat"))),
        "sells": _has(F.col("mc"), COMMERCIAL) | _has(F.col("plain"), COMMERCIAL),
    })
    return sealed(out)


def findings(products: DataFrame) -> DataFrame:
    """Outcome of every rule on every product that has a known category and data."""
    return rules.evaluated(measured(products), "product_id", RULES)


def content_score(products: DataFrame) -> DataFrame:
    """(product_id, possible, obtained, score, errors, warnings, infos, status) of every product; those without data or category are not evaluated."""
    scored = rules.scores(findings(products), "product_id")
    return products.select("product_id").join(scored, "product_id", "left").fillna("sin_evaluar", ["status"])
