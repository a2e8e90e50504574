"""Language checks of free texts: claims, subjective words, statements that need proof, terms of medicine."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.schema import category_fields

# Lists of terms, as (list, term, pattern); patterns ignore case and \b is the edge of an ASCII word.
TERMS = (
    ("claim", "cura", r"\bcur(?:a|ar|an|as)\b"),
    ("claim", "elimina", r"\belimin(?:a|an|ar)\b"),
    ("claim", "previene", r"\bprevien(?:e|en)\b|\bprevenir\b"),
    ("claim", "garantiza", r"\bgarantiz(?:a|an|ado|ada|ados|adas)\b"),
    ("claim", "100% efectivo", r"100\s?%\s*efectiv[oa]"),
    ("claim", "el mejor", r"\b(?:el|la|los|las)\s+mejor(?:es)?\b|\bmejor opción\b"),
    ("claim", "sin efectos secundarios", r"sin efectos secundarios"),
    ("claim", "sustituye", r"\bsustituy(?:e|en)\b|\bsustituir\b"),
    ("subjective", "increíble", r"\bincreíbles?\b"),
    ("subjective", "práctico", r"\bpráctic[oa]s?\b"),
    ("subjective", "cómodo", r"\bcómod[oa]s?\b"),
    ("subjective", "ideal", r"\bideal(?:es)?\b"),
    ("subjective", "perfecto", r"\bperfect[oa]s?\b"),
    ("subjective", "excelente", r"\bexcelentes?\b"),
    ("subjective", "moderno", r"\bmodern[oa]s?\b"),
    ("subjective", "sencillo", r"\bsencill[oa]s?\b"),
    ("subjective", "seguro", r"\bsegur[oa]s?\b"),
    ("subjective", "exacto", r"\bexact[oa]s?\b"),
    ("subjective", "responsable", r"\bresponsable\b"),
    ("subjective", "optimizado", r"\boptimizad[oa]s?\b"),
    ("subjective", "delicado", r"\bdelicado\b"),
    ("subjective", "máximo", r"\bmáxim[oa]s?\b"),
    ("review", "para piel sensible", r"piel sensible"),
    ("review", "hidratación intensa", r"hidratación intensa"),
    ("review", "no comedogénico", r"comedog"),
    ("review", "alta precisión", r"alta precisión"),
    ("review", "absorción rápida", r"absorción rápida"),
)
COSMETIC_TERMS = (
    ("claim", "bloqueador solar", r"\bbloqueador(?:es)?\b|\bbloqueante(?:s)?\b"),
    ("claim", "protección total o al 100%", r"\bprotecci[oó]n total\b|\bprotecci[oó]n al 100\s?%|\b100\s?% de protecci[oó]n\b"),
    ("claim", "todo el día", r"\btodo el d[ií]a\b"),
    ("claim", "sin reaplicar", r"\bsin (?:necesidad de )?reaplicar\b|\bno (?:necesitas|requiere) reaplicar\b"),
    ("medical", "trata", r"\btrat(?:a|an|ar)\b"),
    ("medical", "medicinal", r"\bmedicinal(?:es)?\b"),
    ("medical", "terapéutico", r"\bterap[eé]utic[oa]s?\b"),
    ("medical", "antiinflamatorio", r"\bantiinflamatori[oa]s?\b|\bdesinflam\w+"),
    ("medical", "cicatrizante", r"\bcicatriz\w*"),
    ("medical", "antibiótico o antimicótico", r"\bantibi[oó]tic[oa]s?\b|\bantimic[oó]tic[oa]s?\b"),
    ("medical", "enfermedad de la piel", r"\b(?:dermatitis|psoriasis|rosacea|rosácea|eczema|eccema)\b"),
)
DEVICE_TERMS = (
    ("review", "clínicamente validado", r"\bcl[ií]nicamente (?:validad|probad|comprobad)\w*"),
    ("review", "precisión clínica", r"\bprecisi[oó]n cl[ií]nica\b"),
    ("review", "100% exacto", r"\b100\s?%\s*(?:exact|precis)\w*"),
    ("review", "diagnóstico", r"\bdiagn[oó]stic\w*"),
    ("review", "grado médico", r"\b(?:grado|nivel) m[eé]dic[oa]\b"),
)
ACCESSORY_TERMS = (
    ("medical", "enfermedad", r"\bv[aá]rices\b|\bflebitis\b|\btrombosis\b|\bartritis\b|\bartrosis\b|\bhernia\b|\blumbalgia\b"),
    ("review", "alivia", r"\baliv(?:ia|io|ian|iar|ios)\b"),
    ("review", "corrige", r"\bcorrig\w+"),
    ("review", "terapéutico", r"\bterap[eé]utic\w*"),
    ("review", "ortopédico profesional", r"\bortop[eé]dic[oa]s? profesional"),
)
#: Terms that only products of a category must not use.
CATEGORY_TERMS = {"cos": COSMETIC_TERMS, "dis": DEVICE_TERMS, "acc": ACCESSORY_TERMS}
# Words of commerce, which texts of medicines must not use.
COMMERCIAL = r"\b(compra|comprar|compre|oferta|ofertas|descuento|descuentos|promoci[oó]n|env[ií]o gratis|mejor precio|barato|econ[oó]mic[oa])\b"
# Steps of a routine in the order in which they are tried.
ROUTINE = (
    ("Protección solar", r"\bprotector(?:es)? solar|\bbloqueador|\bfps\b|\bspf\b"),
    ("Cabello", r"\bshampoo|\bchamp[uú]|\bacondicionador|\bcabello|\bcapilar"),
    ("Limpieza", r"\blimpiador|\blimpieza|\bagua micelar|\bdesmaquillante|\bespuma limpiadora|\bjab[oó]n facial"),
    ("Maquillaje", r"\bbase de maquillaje|\bmaquillaje|\blabial|\brubor|\bsombra|\bcorrector|\bdelineador|\bm[aá]scara de pesta[nñ]as|\biluminador|\bprebase|\bprimer\b"),
    ("Tratamiento", r"\bs[eé]rum|\bampolleta|\bexfoliante|\bmascarilla|\bcontorno de ojos|\btratamiento|\bconcentrado|\bretinol|\bniacinamida"),
    ("Hidratación", r"\bcrema|\bloci[oó]n|\bhidratante|\bemulsi[oó]n|\bb[aá]lsamo|\bgel hidratante|\baceite"),
)
#: A character of a word: ASCII letters, digits and _; under (?iu) also the four others that fold into ASCII letters.
ASCII_WORD, WORD = r"\w", r"[\w\x{130}\x{131}\x{17F}\x{212A}]"


def edge(word: str) -> str:
    """Pattern of the edge of a word."""
    return f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"


def edged(pattern: str, word: str = WORD) -> str:
    """A pattern where \\b and \\w go by `word`. Beside a character that is sure to be of a word, \\b asks for the other side alone, as it is tried at every place."""
    pattern = pattern.replace(r"\w", word)
    pattern = re.sub(r"\\b(?=(?:[A-Za-z0-9_]|\\d)(?![?*{]))", lambda _: f"(?<!{word})", pattern)
    pattern = re.sub(r"(?<=[^\\][A-Za-z0-9_])\\b", lambda _: f"(?!{word})", pattern)
    return pattern.replace(r"\b", edge(word))


def matches(text: Column, pattern: str) -> Column:
    """Whether a text has a pattern, whatever its case, where \\b and \\w go by ASCII."""
    return text.rlike("(?iu)" + edged(pattern))


def terms_found(text: Column, cat: Column | None = None) -> Column:
    """(list, term) of every term that a text of a category holds; without a category only the terms for all."""
    hit = lambda kind, term, p, where=None: F.when(matches(text, p) if where is None else where & matches(text, p), F.struct(F.lit(kind).alias("list"), F.lit(term).alias("term")))
    own = [hit(*t, cat == c) for c, terms in CATEGORY_TERMS.items() for t in terms] if cat is not None else []
    return F.array_compact(F.array(*[hit(*t) for t in TERMS], *own))


def lint(rows: DataFrame, key: str, text: str, cat: str | None = None) -> DataFrame:
    """(key, list, term) of every term that a text holds; cat names the column of its category, whose own terms count too."""
    found = terms_found(F.coalesce(F.col(text), F.lit("")), F.col(cat) if cat else None)
    return rows.select(key, F.explode(found).alias("hit")).select(key, "hit.*")


def lint_fields(products: DataFrame) -> DataFrame:
    """(product_id, field, list, term) over the captured fields of products (product_id, cat, v) that are free texts: no closed lists, nothing that is kept as it stands, no sentences."""
    fields = category_fields(products.sparkSession).filter(~F.arrays_overlap("kinds", F.array(*map(F.lit, ("select", "raw", "sentence")))))
    values = products.select("product_id", "cat", F.explode("v").alias("field", "value")).filter("value <> ''")
    free = values.join(F.broadcast(fields.select("cat", F.col("key").alias("field"))), ["cat", "field"])
    return free.select("product_id", "field", F.explode(terms_found(F.col("value"), F.col("cat"))).alias("hit")).select("product_id", "field", "hit.*")


def routine_step(text: Column) -> Column:
    """The first step of a routine whose words a text has; empty if none."""
    out = F.lit("")
    for step, pattern in reversed(ROUTINE):
        out = F.when(matches(text, pattern), step).otherwise(out)
    return out


def sunscreen_level(fps: Column) -> Column:
    """Level of protection that a factor stands for: from 6, 15, 30, and 50 with a plus or above."""
    n = F.regexp_extract(fps, r"(\d+)\s*(\+?)", 1).cast("double")
    plus = F.regexp_extract(fps, r"(\d+)\s*(\+?)", 2) == "+"
    level = F.when(n < 6, "").when(n < 15, "Baja").when(n < 30, "Media").when((n < 50) | ((n == 50) & ~plus), "Alta").otherwise("Muy alta")
    return F.when(fps.rlike(r"\d"), level).otherwise("")
