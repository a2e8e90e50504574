"""Attributes from dirty one-line product texts, by ordered rules that use up the text they read.

A row carries three texts of equal length: `raw` (one blank between words), `flat` (raw without the listed accents) on
which patterns are tried, and `rest`, raw with every character that a rule has used replaced by a mark. A rule takes the
first match of its pattern that touches no mark, and marks it; what is left at the end is unassigned. All of it is
Column expressions over one row. Only dictionaries join: aliases meet texts by one of their words.

Null and empty texts have no category and no fields. Control characters U+0001 to U+0003 count as blanks.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import text as T
from catalogspark.functions.session import sealed
from catalogspark.operators.language import ASCII_WORD, edged
from catalogspark.operators.schema import CATEGORY_FIELDS, category_keys

USED, OPEN, CLOSE = "\u0001", "\u0002", "\u0003"

# Accents that are ignored, and the letters that they leave.
ACCENTED = "áàäâéèëêíìïîóòöôúùüûñÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛÑ"
PLAIN = "aaaaeeeeiiiioooouuuunAAAAEEEEIIIIOOOOUUUUN"

# Numbers, units, containers and counted things. Patterns ignore case, and \b is the edge of an ASCII word.
NUM = r"\d+(?:[.,]\d+)?"
UNIT = r"(?:mg|mcg|ug|gr|grs|g|ui|iu|ml|l|%)"
DOSE = rf"{NUM}\s*{UNIT}(?![a-z0-9])(?:\s*\/\s*(?:{NUM}\s*)?{UNIT}(?![a-z0-9]))*"
CONTAINER = "(?:caj(?:a)?|fco|frasco|blister|blis|sobres?|estuche|tubo|bolsa|botella|bote|tarro|lata|pouch|display|vial)"
NOUN = (
    "(?:tab(?:s|letas?)?|caps?(?:ulas?)?|comp(?:rimidos?)?|pzas?|pz|piezas?|amp(?:olletas?)?|plumas?|sobres?|grag(?:eas?)?|parches?|tiras?|lancetas?|gomitas?|ovulos?|supositorios?"
    "|unidades|unidad|pastillas?|perlas?|softgels?|sachets?|barras?|shots?|chicles?|porciones|viales?)"
)
RELEASED = r"(?:\s+(?:de\s+)?(?:lib(?:eracion)?\.?\s*)?(?:prolongada|retardada|modificada))?"
PIECES = rf"(?:\b{CONTAINER}\.?\s*)?(?:\bc\/\s*|\bx\s*|\bcon\s+)\d+(?:\s*{NOUN}\b\.?{RELEASED})?|\b\d+\s*{NOUN}\b\.?{RELEASED}"
RELEASE = r"\b(?:de\s+)?(?:lib(?:eracion)?\.?\s*)?(prolongada|retardada|modificada)\b|\b(?:lp|xr|er|sr)\b"
BEFORE_VOLUME = r"\b(caj(?:a)?|fco|frasco|botella|tubo|bolsa)\.?\s*$"
MASS_UNITS = ("mg", "mcg", "ug", "g", "gr", "grs", "ui", "iu", "%")
VOLUME_UNITS = ("ml", "l")
UNIT_NAMES = {"ml": "mL", "l": "L", "ui": "UI", "iu": "UI", "gr": "g", "grs": "g"}
# Dosage forms in the order in which they are tried; the last column says whether a form speaks for a medicine.
FORMS = (
    (r"\b(?:tab(?:s|letas?)?|comp(?:rimidos?)?)\.?\s*mast(?:icables?)?\b\.?", "Tableta masticable", False),
    (r"\b(?:tab(?:s|letas?)?|comp(?:rimidos?)?)\.?\s*efervesc(?:entes?)?\b\.?|\befervescentes?\b", "Tableta efervescente", False),
    (r"\b(?:tab(?:s|letas?)?|comp(?:rimidos?)?)\.?\s*sublingual(?:es)?\b", "Tableta sublingual", True),
    (r"\bcaps?(?:ulas?)?\.?\s*blandas?\b|\bsoftgels?\b|\bperlas?\b", "Cápsula blanda", False),
    (r"\bcaps?(?:ulas?)?\.?\s*(?:vegetales?|veg)\b", "Cápsula vegetal", False),
    (r"\bsol(?:ucion)?\.?\s*iny(?:ectable)?\b\.?", "Solución inyectable", True),
    (r"\bsusp(?:ension)?\.?\s*iny(?:ectable)?\b\.?", "Suspensión inyectable", True),
    (r"\bsol(?:ucion)?\.?\s*oral\b", "Solución oral", True),
    (r"\bsusp(?:ension)?\.?\s*oral\b", "Suspensión oral", True),
    (r"\bsol(?:ucion)?\.?\s*(?:oft|oftalmica)\b\.?", "Solución oftálmica", True),
    (r"\bsusp(?:ension)?\b\.?", "Suspensión", True),
    (r"\bsol(?:ucion)?\b\.?", "Solución", True),
    (r"\btab(?:s|letas?)?\b\.?", "Tableta", True),
    (r"\bcomp(?:rimidos?)?\b\.?", "Comprimido", True),
    (r"\bcaps?(?:ulas?)?\b\.?", "Cápsula", True),
    (r"\bgrag(?:eas?)?\b\.?", "Gragea", True),
    (r"\b(?:jbe|jarabe)\b\.?", "Jarabe", True),
    (r"\bamp(?:olletas?)?\b\.?", "Ampolleta", True),
    (r"\bgotas\b", "Gotas", True),
    (r"\bsupositorios?\b", "Supositorio", True),
    (r"\bovulos?\b", "Óvulo", True),
    (r"\bung(?:uento)?\b\.?", "Ungüento", True),
    (r"\bgomitas?\b", "Gomita", False),
    (r"\bpolvo\b", "Polvo", False),
    (r"\bliquido\b", "Líquido", False),
    (r"\bshots?\b", "Shot", False),
    (r"\bbarras?\b", "Barra", False),
    (r"\bchicles?\b", "Chicle", False),
    (r"\bpastillas?\b", "Pastilla", False),
    (r"\bgranulado\b", "Granulado", False),
    (r"\b(?:spray|aerosol)\b", "Spray", False),
    (r"\baceite\b", "Aceite", False),
    (r"\bemulsion\b", "Emulsión", False),
    (r"\bcrema\b", "Crema", False),
    (r"\bgel\b", "Gel", False),
)
FORM_PLURALS = {
    "Tableta": "tabletas", "Comprimido": "comprimidos", "Cápsula": "cápsulas", "Gragea": "grageas", "Ampolleta": "ampolletas", "Supositorio": "supositorios", "Óvulo": "óvulos", "Gomita": "gomitas",
    "Tableta masticable": "tabletas masticables", "Tableta efervescente": "tabletas efervescentes", "Tableta sublingual": "tabletas sublinguales", "Cápsula blanda": "cápsulas blandas",
    "Cápsula vegetal": "cápsulas vegetales", "Pastilla": "pastillas", "Chicle": "chicles", "Barra": "barras", "Shot": "shots",
}
ROUTES = (
    (r"\boral\b", "Oral"), (r"\bsubcut(?:anea)?\b|\bs\.?c\.?(?![a-z0-9])", "Subcutánea"), (r"\bintramuscular\b", "Intramuscular"), (r"\bintravenosa\b|\bendovenosa\b", "Intravenosa"),
    (r"\btopic[oa]\b", "Tópica"), (r"\boftalmica\b", "Oftálmica"), (r"\bnasal\b", "Nasal"), (r"\bsublingual\b", "Sublingual"), (r"\brectal\b", "Rectal"), (r"\bvaginal\b", "Vaginal"), (r"\binhalada\b", "Inhalada"),
)
WITHOUT_PRESCRIPTION = r"\b(?:sin receta|venta libre|otc)\b"
WITH_PRESCRIPTION = r"\b(?:con receta|requiere receta|c\/receta|c\/rx|rx)\b"
# Kinds of products by category, in the order in which they are tried; the field that they fill.
KIND_FIELDS = {"dis": "tipo", "cos": "tipo", "hig": "producto", "acc": "producto", "beb": "tipo", "sup": "componente"}
KINDS = {
    "dis": (
        (r"\bpulsioximetro\b", "Pulsioxímetro"), (r"\besfigmomanometro\b", "Esfigmomanómetro"), (r"\bestetoscopio\b", "Estetoscopio"), (r"\btiras reactivas\b", "Tiras reactivas"), (r"\blancetas\b", "Lancetas"),
        (r"\blancetero\b", "Lancetero"), (r"\bbascula(?: digital)?\b", "Báscula"), (r"\bhumidificador\b", "Humidificador"), (r"\bvaporizador\b", "Vaporizador"), (r"\baspirador nasal\b", "Aspirador nasal"),
        (r"\b(?:electroestimulador|tens)\b", "Electroestimulador"), (r"\bmasajeador\b", "Masajeador"), (r"\bbaumanometro\b", "Baumanómetro"), (r"\btensiometro\b", "Tensiómetro"), (r"\bglucometro\b", "Glucómetro"),
        (r"\btermometro\b", "Termómetro"), (r"\boximetro\b", "Oxímetro"), (r"\bnebulizador\b", "Nebulizador"), (r"\binhalocamara\b", "Inhalocámara"),
    ),
    "cos": (
        (r"\bbalsamo labial\b", "Bálsamo labial"), (r"\bprotector labial\b", "Protector labial"), (r"\bleche limpiadora\b", "Leche limpiadora"), (r"\bdesmaquillante\b", "Desmaquillante"), (r"\bexfoliante\b", "Exfoliante"),
        (r"\baceite\b", "Aceite"), (r"\bbruma\b", "Bruma"), (r"\bfluido\b", "Fluido"), (r"\bcrema para ojos\b", "Contorno de ojos"), (r"\b(?:gel de ducha|gel de bano)\b", "Gel de baño"), (r"\bcrema hidratante\b", "Crema hidratante"),
        (r"\bcrema facial\b", "Crema facial"), (r"\bcrema corporal\b", "Crema corporal"), (r"\bcrema de manos\b", "Crema de manos"), (r"\bgel limpiador\b", "Gel limpiador"), (r"\bgel facial\b", "Gel facial"),
        (r"\bespuma limpiadora\b", "Espuma limpiadora"), (r"\bagua micelar\b", "Agua micelar"), (r"\blocion hidratante\b", "Loción hidratante"), (r"\blocion corporal\b", "Loción corporal"), (r"\bemulsion hidratante\b", "Emulsión hidratante"),
        (r"\bserum\b", "Sérum"), (r"\bprotector solar\b", "Protector solar"), (r"\bcontorno de ojos\b", "Contorno de ojos"), (r"\bcrema\b", "Crema"), (r"\bgel\b", "Gel"), (r"\blocion\b", "Loción"), (r"\bemulsion\b", "Emulsión"),
        (r"\bbalsamo\b", "Bálsamo"), (r"\bmascarilla\b", "Mascarilla"), (r"\btonico\b", "Tónico"), (r"\blimpiador\b", "Limpiador"),
    ),
    "hig": (
        (r"\bjabon liquido\b", "Jabón líquido"), (r"\bgel antibacterial\b", "Gel antibacterial"), (r"\bacondicionador\b", "Acondicionador"), (r"\btoallas sanitarias\b", "Toallas sanitarias"), (r"\btampones\b", "Tampones"),
        (r"\bprotectores? diarios?\b", "Protectores diarios"), (r"\bpanales\b", "Pañales"), (r"\balgodon\b", "Algodón"), (r"\bcotonetes\b", "Cotonetes"), (r"\brastrillo\b", "Rastrillo"), (r"\brepelente\b", "Repelente"),
        (r"\btalco\b", "Talco"), (r"\bpreservativos?\b", "Preservativos"), (r"\bpasta dental\b|\bcrema dental\b", "Pasta dental"), (r"\b(?:shampoo|champu)\b", "Shampoo"), (r"\bdesodorante\b", "Desodorante"), (r"\bjabon\b", "Jabón"),
        (r"\benjuague bucal\b", "Enjuague bucal"), (r"\bcepillo dental\b", "Cepillo dental"), (r"\bhilo dental\b", "Hilo dental"), (r"\btoallas humedas\b", "Toallas húmedas"),
    ),
    "acc": (
        (r"\brodillera\b", "Rodillera"), (r"\btobillera\b", "Tobillera"), (r"\bcollarin\b", "Collarín"), (r"\bcabestrillo\b", "Cabestrillo"), (r"\bmuletas?\b", "Muletas"), (r"\bbaston\b", "Bastón"), (r"\bplantillas?\b", "Plantillas"),
        (r"\bmedias de compresion\b", "Medias de compresión"), (r"\bpastillero\b", "Pastillero"), (r"\bguantes\b", "Guantes"), (r"\bbolsa para hielo\b", "Bolsa para hielo"), (r"\bparches? termicos?\b", "Parches térmicos"),
        (r"\bvenda\b", "Venda"), (r"\bfaja\b", "Faja"), (r"\bmunequera\b", "Muñequera"), (r"\bbolsa termica\b", "Bolsa térmica"), (r"\b(?:cubrebocas|tapabocas)\b", "Cubrebocas"),
    ),
    "beb": (
        (r"\bnutricion oral\b", "Nutrición oral"), (r"\bbebida (?:de )?proteina\b", "Bebida de proteína"), (r"\bbebida deportiva\b", "Bebida deportiva"), (r"\bbebida con electrolitos\b", "Bebida con electrolitos"),
        (r"\bagua alcalina\b", "Agua alcalina"), (r"\bagua\b", "Agua"), (r"\bjugo\b", "Jugo"), (r"\bleche\b", "Leche"), (r"\bformula infantil\b", "Fórmula infantil"), (r"\bsuero oral\b", "Suero oral"),
        (r"\bbebida (?:hidratante|isotonica)\b", "Bebida hidratante"), (r"\bisotonica\b", "Bebida isotónica"), (r"\brehidratante\b", "Bebida rehidratante"),
    ),
    "sup": (
        (r"\bcolageno hidrolizado\b", "Colágeno hidrolizado"), (r"\bacido folico\b", "Ácido fólico"), (r"\bcoenzima q ?10\b", "Coenzima Q10"), (r"\bcalcio\b", "Calcio"), (r"\bhierro\b", "Hierro"), (r"\bbiotina\b", "Biotina"),
        (r"\bashwagandha\b", "Ashwagandha"), (r"\bcurcuma\b", "Cúrcuma"), (r"\bfibra\b", "Fibra"), (r"\bglutamina\b", "Glutamina"), (r"\bprebioticos?\b", "Prebiótico"), (r"\blecitina\b", "Lecitina"), (r"\bluteina\b", "Luteína"),
        (r"\b(?:espirulina|spirulina)\b", "Espirulina"), (r"\bjengibre\b", "Jengibre"), (r"\bginkgo(?: biloba)?\b", "Ginkgo biloba"), (r"\bvaleriana\b", "Valeriana"), (r"\bpotasio\b", "Potasio"), (r"\bselenio\b", "Selenio"),
        (r"\bl-?carnitina\b", "L-carnitina"), (r"\bbcaa\b", "BCAA"), (r"\baminoacidos\b", "Aminoácidos"), (r"\b(?:proteina whey|whey)\b", "Proteína whey"), (r"\belectrolitos\b", "Electrolitos"), (r"\bvitamina [a-z]\d*\b", None),
        (r"\bomega ?-?3\b", "Omega 3"), (r"\bcolageno\b", "Colágeno"), (r"\bprobioticos?\b", "Probiótico"), (r"\bmultivitaminico\b", "Multivitamínico"), (r"\bmagnesio\b", "Magnesio"), (r"\bzinc\b", "Zinc"),
        (r"\bmelatonina\b", "Melatonina"), (r"\bcreatina\b", "Creatina"), (r"\bproteina\b", "Proteína"),
    ),
}
# Flavours by the word that names them, attributes of drinks, actives of cosmetics, technique of devices.
FLAVOURS = {
    "coco": "Coco", "fresa": "Fresa", "limon": "Limón", "naranja": "Naranja", "uva": "Uva", "manzana": "Manzana", "mora azul": "Mora azul", "mora": "Mora", "menta": "Menta", "vainilla": "Vainilla", "chocolate": "Chocolate",
    "mango": "Mango", "pina": "Piña", "durazno": "Durazno", "sandia": "Sandía", "maracuya": "Maracuyá", "cereza": "Cereza", "toronja": "Toronja", "mandarina": "Mandarina", "jamaica": "Jamaica", "tamarindo": "Tamarindo",
    "frutos rojos": "Frutos rojos", "frutos del bosque": "Frutos del bosque", "platano": "Plátano", "cafe": "Café", "caramelo": "Caramelo", "galleta": "Galleta", "cookies": "Cookies", "moka": "Moka", "citricos": "Cítricos",
    "guayaba": "Guayaba", "frambuesa": "Frambuesa", "arandano": "Arándano", "lima": "Lima",
}
FLAVOUR_WORD = r"\bsabor(?: a)?\b"
DRINK_ATTRIBUTES = (
    (r"\bsin azucar(?:es)?\b", "Sin azúcar"), (r"\bsin lactosa\b", "Sin lactosa"), (r"\bsin gluten\b|\blibre de gluten\b", "Sin gluten"), (r"\bsin calorias\b", "Sin calorías"), (r"\bbajo en sodio\b", "Bajo en sodio"),
    (r"\bzero\b", "Zero"), (r"\blight\b", "Light"),
)
ACTIVES = (
    (r"\bacido hialuronico\b", "Ácido hialurónico"), (r"\bniacinamida\b", "Niacinamida"), (r"\bretinol\b", "Retinol"), (r"\bceramidas\b", "Ceramidas"), (r"\bpeptidos\b", "Péptidos"), (r"\bacido salicilico\b", "Ácido salicílico"),
    (r"\bacido glicolico\b", "Ácido glicólico"), (r"\bcentella asiatica\b", "Centella asiática"), (r"\bvitamina c\b", "Vitamina C"),
)
TECHNIQUES = (
    (r"\bautomatico de brazo\b", "Automático de brazo"), (r"\bautomatico de muneca\b", "Automático de muñeca"), (r"\bde brazo\b", "De brazo"), (r"\bde muneca\b", "De muñeca"), (r"\binfrarrojo\b", "Infrarrojo"), (r"\bautomatico\b", "Automático"),
)
MODEL, FACTOR, DIGITAL = r"\b[a-z]{1,6}-?\d{2,6}[a-z0-9-]*\b", r"\b(?:fps|spf) ?\d+\+?", r"\bdigital\b"
# Words that speak for a category, the order of categories that decides ties, and the points of the other signs.
CATEGORY_WORDS = {
    "dis": r"\b(baumanometro|tensiometro|glucometro|termometro|oximetro|nebulizador|inhalocamara|estetoscopio|tiras reactivas|lancetas?|lancetero|esfigmomanometro|pulsioximetro|bascula|humidificador|vaporizador|aspirador nasal)\b",
    "cos": r"\b(crema (?:hidratante|facial|corporal|de manos)|gel (?:limpiador|facial)|agua micelar|espuma limpiadora|serum|protector solar|fps|spf|contorno de ojos|mascarilla|limpiador|tonico|acido hialuronico|niacinamida|retinol|ceramidas|locion|emulsion|exfoliante|desmaquillante|balsamo labial|protector labial|bruma)\b",
    "sup": r"\b(vitamina [a-z]|multivitaminico|omega ?-?3|colageno|probioticos?|magnesio|zinc|melatonina|creatina|proteina|gomitas?|calcio|hierro|biotina|ashwagandha|curcuma|colageno hidrolizado|espirulina|glutamina|bcaa|aminoacidos|coenzima q ?10|acido folico|electrolitos|whey)\b",
    "beb": r"\b(suero oral|electrolit|electrolitos|bebida|sabor|isotonica|rehidratante|nutricion oral|agua alcalina|formula infantil|bebida (?:de )?proteina)\b",
    "hig": r"\b(pasta dental|crema dental|shampoo|champu|desodorante|jabon|enjuague bucal|cepillo dental|hilo dental|toallas humedas|acondicionador|gel antibacterial|toallas sanitarias|tampones|panales|cotonetes|rastrillo|repelente|preservativos?|jabon liquido)\b",
    "acc": r"\b(parches? termicos?|venda|faja|munequera|bolsa termica|cubrebocas|tapabocas|rodillera|tobillera|collarin|cabestrillo|muletas?|baston|medias de compresion|pastillero)\b",
}
CATEGORY_ORDER = ("dis", "cos", "hig", "beb", "acc", "sup", "med")
DOSE_OF_MEDICINE = r"\d+(?:[.,]\d+)?\s*(?:mg|mcg|ug|ui|iu)\b"
PRESCRIPTION_WORDS = r"\b(?:con receta|sin receta|requiere receta|c\/receta|rx|otc)\b"
SUPPLEMENT_WORD = r"\bsuplemento\b"
# Words that are never reported as unassigned, and signs that part what is left into words.
STOP_WORDS = ("de", "del", "la", "el", "los", "las", "con", "en", "y", "e", "o", "a", "al", "c", "x", "para", "por", "un", "una", "caj", "caja", "fco", "frasco")
PARTING = r"[\s,;|/.()]"

#: Kinds of dictionary entries in the order in which they use up text, and whether all of a kind are taken or the first alone.
DICTIONARY_KINDS = (("brand", False), ("maker", False), ("ingredient", True))
#: Aliases up to which a dictionary is broadcast.
FEW_ALIASES = 100_000
SPAN = "array<struct<at:int,size:int>>"


def flat(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def one_line(c: Column) -> Column:
    return T.tidy(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{USED}{OPEN}{CLOSE}]", " "))


def compiled(pattern: str) -> str:
    """A pattern whatever the case, where \\b goes by ASCII."""
    return "(?i)" + edged(pattern, ASCII_WORD)


def free_matches(text: Column, rest: Column, pattern) -> Column:
    """(at, size) of all matches of a pattern in text that touch no used character of rest, in order."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(compiled(pattern))
    pieces = F.split(F.regexp_replace(text, pattern, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")  # every second piece is a match

    def step(acc: Column, piece: Column) -> Column:
        size = F.length(piece)
        hit = acc["inside"] & (size > 0) & ~F.contains(F.substring(rest, acc["at"], size), F.lit(USED))
        found = F.when(hit, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), size.alias("size"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + size).alias("at"), (~acc["inside"]).alias("inside"), found.alias("found"))

    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("found"))
    return F.when(F.regexp_like(text, pattern), F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(SPAN))


def alias_spans(pieces: Column) -> Column:
    """(at, size) of every second piece of a text in order; most texts hold an alias once, which needs no loop."""

    def step(acc: Column, piece: Column) -> Column:
        size = F.length(piece)
        found = F.when(acc["inside"], F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), size.alias("size"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + size).alias("at"), (~acc["inside"]).alias("inside"), found.alias("found"))

    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("found"))
    once = F.array(F.struct((F.length(F.get(pieces, F.lit(0))) + 1).alias("at"), F.length(F.get(pieces, F.lit(1))).alias("size"))).cast(SPAN)
    return F.when(F.size(pieces) == 3, once).otherwise(F.aggregate(pieces, start, step, lambda acc: acc["found"]))


def marked(rest: Column, span: Column) -> Column:
    return F.when(span.isNull(), rest).otherwise(F.overlay(rest, F.repeat(F.lit(USED), span["size"]), span["at"], span["size"]))


def all_marked(rest: Column, spans: Column) -> Column:
    return F.aggregate(spans, rest, lambda acc, s: F.overlay(acc, F.repeat(F.lit(USED), s["size"]), s["at"], s["size"]))


def cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["at"], span["size"])


class Reader:
    """A table on which rules are run one after another; columns raw, flat and rest, and one for each result."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def put(self, **columns: Column) -> None:
        self.rows = self.rows.withColumns(columns)

    def first(self, name: str, pattern: str, where: Column | None = None) -> None:
        """`name`: the span of the first free match, which is used up; null without one."""
        span = F.get(free_matches(F.col("flat"), F.col("rest"), pattern), F.lit(0))
        self.put(**{name: span if where is None else F.when(where, span)})
        self.put(rest=marked(F.col("rest"), F.col(name)))

    def one_of(self, name: str, lists: dict, where: Column | None = None) -> None:
        """`name`: (canon, span) of the first rule (pattern, canon) with a free match, which is used up. lists: the rules by the categories that have them.

        Constant patterns sift the rules; those that match at all, which are few, are then tried in order.
        """
        rule = lambda p, canon: F.struct(F.lit(compiled(p)).alias("pattern"), F.lit(canon).cast("string").alias("canon"))
        sifted = F.lit(None)
        for cats, rules in lists.items():
            own = F.array_compact(F.array(*[F.when(F.regexp_like("flat", F.lit(compiled(p))), rule(p, canon)) for p, canon in rules]))
            sifted = F.when(F.col("cat").isin(*cats), own).otherwise(sifted)
        tried = F.transform("sifted", lambda r: F.struct(r["canon"].alias("canon"), F.get(free_matches(F.col("flat"), F.col("rest"), r["pattern"]), F.lit(0)).alias("span")))
        self.put(sifted=sifted if where is None else F.when(where, sifted))
        self.put(**{name: F.get(F.filter(tried, lambda t: t["span"].isNotNull()), F.lit(0))})
        self.put(rest=marked(F.col("rest"), F.col(f"{name}.span")))


def category(text: Column) -> Column:
    """(cat, ambiguous): the category with most points of a flat text, and the runner-up if it is at most one point behind; null without signs."""
    has = lambda p: F.regexp_like(text, F.lit(compiled(p)))
    points = {c: F.when(has(p), 3).otherwise(0) for c, p in CATEGORY_WORDS.items()}
    points["sup"] = points["sup"] + F.when(has(SUPPLEMENT_WORD), 4).otherwise(0)
    signs = ((has(DOSE) & has(DOSE_OF_MEDICINE), 2), (has("|".join(p for p, _, medicine in FORMS if medicine)), 2), (has(PRESCRIPTION_WORDS), 2), (has("|".join(p for p, _ in ROUTES)), 1))
    points["med"] = sum((F.when(sign, n).otherwise(0) for sign, n in signs), F.lit(0))
    ranked = F.array_sort(F.array(*[F.struct((-points[c]).alias("minus"), F.lit(i).alias("place"), F.lit(c).alias("cat")) for i, c in enumerate(CATEGORY_ORDER)]))

    def verdict(r: Column) -> Column:
        near = (r[1]["minus"] < 0) & (r[1]["minus"] - r[0]["minus"] <= 1)
        return F.when(r[0]["minus"] < 0, F.struct(r[0]["cat"].alias("cat"), F.when(near, r[1]["cat"]).alias("ambiguous")))

    return F.get(F.transform(F.array(ranked), verdict), F.lit(0))


def detect_category(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cat, ambiguous) of every text; null without signs of a category."""
    return rows.select(key, flat(one_line(F.col(text))).alias("flat")).select(key, category(F.col("flat")).alias("c")).select(key, "c.cat", "c.ambiguous")


def quoted_alias(alias: Column) -> Column:
    """Pattern of a flat alias as whole words, where blanks stand for any white space. Its own ends say on which side of an edge a word must lie."""
    start = F.when(F.regexp_like(alias, F.lit(rf"^{ASCII_WORD}")), rf"(?<!{ASCII_WORD})").otherwise(rf"(?<={ASCII_WORD})")
    end = F.when(F.regexp_like(alias, F.lit(rf"{ASCII_WORD}\z")), rf"(?!{ASCII_WORD})").otherwise(rf"(?={ASCII_WORD})")
    return F.concat(F.lit("(?i)"), start, F.lit(r"\Q"), F.replace(F.regexp_replace(alias, r"\s+", " "), F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"), end)


def uncased(c: Column) -> Column:
    """A text whatever its case, each character by itself: lower case writes a sigma by what follows it."""
    return F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))


def dictionary_candidates(rows: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """(key, flat, aliases): the entries (kind, alias, canon, seq) of a dictionary that a flat text in one line holds, in the order of their use, with the spans of all their matches.

    An entry meets texts by that of its words which fewest entries have (one without letters and digits meets none), so an alias may have any number of words and a
    word that many aliases share finds few of them. The dictionary is broadcast while it has at most FEW_ALIASES
    entries; beyond that, words are joined and adaptive execution splits the frequent ones. Where they meet, a text that does not have the
    alias's characters at all is refused at once; in the others its pattern, made once an entry, is tried once.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = dictionary.select("kind", flat(F.trim("alias")).alias("alias"), "canon", "seq").filter("alias <> ''")
    spread = known.select("*", F.explode(F.array_distinct(words(F.col("alias")))).alias("word"))
    shared = spread.groupBy("word").agg(F.count("*").alias("n"))
    picked = spread.join(shared, "word").groupBy("kind", "alias", "canon", "seq").agg(F.min(F.struct("n", "word")).alias("w"))
    alias = F.col("alias")
    picked = picked.select("kind", "alias", "canon", "seq", "w.word", uncased(F.regexp_replace(alias, r"\s+", " ")).alias("plain"), quoted_alias(alias).alias("pattern"))
    few = dictionary.limit(FEW_ALIASES + 1).count() <= FEW_ALIASES
    met = rows.select(key, "flat", F.explode(F.array_distinct(words(F.col("flat")))).alias("word")).join(F.broadcast(picked) if few else picked, "word")
    held = met.filter(F.contains(uncased(F.col("flat")), F.col("plain")))
    pieces = F.split(F.regexp_replace("flat", F.col("pattern"), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")  # every second piece is a match
    held = held.withColumn("pieces", pieces).withColumn("spans", alias_spans(F.col("pieces")))
    place = F.create_map(*[x for i, (kind, _) in enumerate(DICTIONARY_KINDS) for x in (F.lit(kind), F.lit(i))])[F.col("kind")]
    one = F.struct(place.alias("place"), (-F.length("alias")).alias("minus"), "seq", "alias", "canon", "kind", "spans")
    return held.groupBy(key, "flat").agg(F.array_sort(F.collect_list(F.when(F.size("spans") > 0, one))).alias("aliases"))  # as many as one text holds


def use_aliases(rest: Column, aliases: Column, kinds=DICTIONARY_KINDS) -> Column:
    """(rest, hits): text used up by aliases in order, and each hit (kind, alias, canon, at, size)."""
    whole = {kind for kind, every in kinds if every}
    hit = "array<struct<kind:string,alias:string,canon:string,at:int,size:int>>"

    def step(acc: Column, a: Column) -> Column:
        spans = F.filter(a["spans"], lambda s: ~F.contains(cut(acc["rest"], s), F.lit(USED)))
        done = ~a["kind"].isin(*whole) & F.exists(acc["hits"], lambda h: h["kind"] == a["kind"])
        taken = F.when(done, F.array().cast(SPAN)).when(a["kind"].isin(*whole), spans).otherwise(F.slice(spans, 1, 1))
        more = F.transform(taken, lambda s: F.struct(a["kind"].alias("kind"), a["alias"].alias("alias"), a["canon"].alias("canon"), s["at"].alias("at"), s["size"].alias("size")))
        return F.struct(all_marked(acc["rest"], taken).alias("rest"), F.concat(acc["hits"], more).alias("hits"))

    return F.aggregate(aliases, F.struct(rest.alias("rest"), F.array().cast(hit).alias("hits")), step)


def parsed_doses(raw: Column, spans: Column) -> Column:
    """Doses as (span, text, parts of (number, unit, text), has mass, ends in a volume)."""

    def part(p: Column) -> Column:
        whole = rf"^({NUM})?\s*([a-zA-Z%]+)$"
        number, unit = F.regexp_extract(p, whole, 1), F.regexp_extract(p, whole, 2)
        name = reduce(lambda acc, u: F.when(F.lower(unit) == u[0], u[1]).otherwise(acc), UNIT_NAMES.items(), F.when(F.lower(unit) == "ug", unit).otherwise(F.lower(unit)))
        return F.when(unit != "", F.struct(number.alias("number"), F.lower(unit).alias("unit"), F.concat(F.when(number != "", F.concat(number, F.lit(" "))).otherwise(""), name).alias("text")))

    def dose(s: Column) -> Column:
        return F.struct(s.alias("span"), F.filter(F.transform(F.split(cut(raw, s), r"\s*/\s*"), part), lambda p: p.isNotNull()).alias("parts"))

    def judged(d: Column) -> Column:
        mass = F.exists(d["parts"], lambda p: p["unit"].isin(*MASS_UNITS))
        volume = F.coalesce(F.try_element_at(d["parts"], F.lit(-1))["unit"].isin(*VOLUME_UNITS), F.lit(False))
        return F.struct(d["span"].alias("span"), d["parts"].alias("parts"), shown(d["parts"]).alias("text"), mass.alias("mass"), volume.alias("volume"))

    return F.transform(F.transform(spans, dose), judged)


def shown(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), " / ")


def extract(rows: DataFrame, key: str, text: str, dictionary: DataFrame | None = None, cat: str | None = None, suggest_brand: bool = False) -> DataFrame:
    """(key, raw, cat, ambiguous, fields map, leftover array, notes array) of every text.

    dictionary: entries (kind brand / maker / ingredient, alias, canon, seq). cat: a column that states the category; where it is
    null or unknown the text decides. suggest_brand: up to three words in front that nothing used become the brand.
    """
    raw = one_line(F.col(text))
    given = F.when(F.col(cat).isin(*CATEGORY_FIELDS), F.col(cat)) if cat else F.lit(None).cast("string")
    start = rows.select(F.col(key).alias("id"), raw.alias("raw"), flat(raw).alias("flat"), given.alias("given"))
    start = start.withColumn("found", category(F.col("flat")))
    start = start.select("id", "raw", "flat", F.when(F.col("raw") != "", F.coalesce("given", "found.cat")).alias("cat"), F.when(F.col("given").isNull() & (F.col("raw") != ""), F.col("found.ambiguous")).alias("ambiguous"))
    if dictionary is not None:
        aliases = dictionary_candidates(start, "id", dictionary).select(F.col("id").alias("other"), F.col("flat").alias("same"), "aliases")
        start = start.join(aliases, F.col("id").eqNullSafe(F.col("other")) & (F.col("flat") == F.col("same")), "left").drop("other", "same")
    else:
        start = start.withColumn("aliases", F.lit(None))
    med, cat_is = F.col("cat") == "med", lambda *c: F.col("cat").isin(*c)
    r = Reader(start)
    none = F.array().cast("array<struct<place:int,minus:int,seq:bigint,alias:string,canon:string,kind:string,spans:array<struct<at:int,size:int>>>>")
    usable = F.coalesce(F.col("aliases"), none)
    r.put(used=use_aliases(F.col("raw"), F.filter(usable, lambda a: med | (a["kind"] != "ingredient")) if dictionary is not None else none))
    r.put(rest=F.col("used.rest"), hits=F.col("used.hits"))
    r.first("without", WITHOUT_PRESCRIPTION)
    r.first("with", WITH_PRESCRIPTION, F.col("without").isNull())
    # doses and volumes
    r.put(spans=free_matches(F.col("flat"), F.col("rest"), DOSE))
    r.put(rest=all_marked(F.col("rest"), F.col("spans")), doses=parsed_doses(F.col("raw"), F.col("spans")))
    r.put(strength_at=F.when(med, F.array_position(F.transform("doses", lambda d: d["mass"]), True)).otherwise(0).cast("int"))
    r.put(volume_at=F.when(med, F.array_position(F.transform("doses", lambda d, i: ~d["mass"] & (i + 1 != F.col("strength_at"))), True)).otherwise(F.least(F.size("doses"), F.lit(1))).cast("int"))
    r.put(strength=F.get("doses", F.col("strength_at") - 1), volume=F.get("doses", F.col("volume_at") - 1))
    r.one_of("forma", {("med", "sup"): [(p, name) for p, name, _ in FORMS]})
    oral = med & F.coalesce(F.col("forma.canon").rlike("(?i)oral$"), F.lit(False))
    r.one_of("via", {("med",): ROUTES}, ~oral)
    r.first("release", RELEASE, F.col("forma").isNotNull())
    r.first("pieces", PIECES)
    # the container before a volume, where no pieces are stated
    before = F.regexp_extract(F.substring("flat", F.lit(1), F.col("volume.span.at") - 1), compiled(BEFORE_VOLUME).replace("$", r"\z"), 0)
    place = F.struct((F.col("volume.span.at") - F.length(before)).alias("at"), F.length(before).alias("size"))
    r.put(before=F.when(F.col("pieces").isNull() & F.col("volume").isNotNull() & (before != ""), place))
    r.put(before=F.when(~F.contains(cut(F.col("rest"), F.col("before")), F.lit(USED)), F.col("before")))
    r.put(rest=marked(F.col("rest"), F.col("before")))
    held = F.when(F.col("pieces").isNotNull(), cut(F.col("raw"), F.col("pieces"))).when(F.col("volume").isNotNull(), F.concat_ws(" ", F.trim(cut(F.col("raw"), F.col("before"))), F.col("volume.text"))).otherwise("")
    r.put(held=held)
    plural = F.create_map(*[F.lit(x) for pair in FORM_PLURALS.items() for x in pair])[F.col("forma.canon")]
    named = F.when(F.col("pieces").isNotNull() & ~F.regexp_like(flat(F.col("held")), F.lit(compiled(NOUN))), plural)
    word = F.lower(cut(F.col("flat"), F.col("release")))
    release = F.when(F.col("release").isNotNull(), F.concat(F.lit("de liberación "), F.when(F.contains(word, F.lit("retard")), "retardada").when(F.contains(word, F.lit("modific")), "modificada").otherwise("prolongada")))
    r.put(content=F.when(F.col("held") != "", F.concat_ws(" ", "held", named, release)).otherwise(""))
    # what only one category has
    r.one_of("kind", {(c,): rules for c, rules in KINDS.items()})
    vitamin = F.concat(F.lit("Vitamina "), F.upper(F.substring(cut(F.col("flat"), F.col("kind.span")), 10, 1)), F.substring(cut(F.col("flat"), F.col("kind.span")), 11, 99))
    r.first("digital", DIGITAL, cat_is("dis") & F.col("kind").isNotNull())
    r.one_of("quality", {("dis",): TECHNIQUES, ("cos",): ACTIVES, ("beb",): DRINK_ATTRIBUTES})
    r.first("model", MODEL, cat_is("dis"))
    r.first("factor", FACTOR, cat_is("cos"))
    r.first("flavour_word", FLAVOUR_WORD, cat_is("sup", "beb"))
    r.one_of("flavour", {("sup", "beb"): [(rf"\b{word}\b", name) for word, name in FLAVOURS.items()]})
    of = lambda kind: F.get(F.transform(F.filter("hits", lambda h: h["kind"] == kind), lambda h: h["canon"]), F.lit(0))
    ahead = F.trim(F.substring_index("rest", USED, 1))
    guess = F.when((F.length(ahead) > 0) & (F.size(F.split(ahead, " ")) <= 3) & ahead.rlike(r"\p{L}"), ahead)
    r.put(guess=F.when(of("brand").isNull() & F.lit(suggest_brand), guess))
    r.put(rest=F.when(F.col("guess").isNotNull(), marked(F.col("rest"), F.struct(F.lit(1).alias("at"), F.length(F.substring_index("rest", USED, 1)).alias("size")))).otherwise(F.col("rest")))
    kind_of = lambda c: F.when(cat_is(c), F.coalesce(F.col("kind.canon"), F.when(F.col("kind").isNotNull(), vitamin)))
    maker = of("maker")
    split_volume = (F.size("strength.parts") >= 2) & F.col("strength.volume") & (F.try_element_at("strength.parts", F.lit(-1))["number"] != "")
    fields = {
        "marca": F.coalesce(of("brand"), F.col("guess")),
        "laboratorio": F.when(med, maker),
        "fabricante": F.when(~med, maker),
        "principio": F.when(med, F.array_join(F.array_distinct(F.transform(F.filter("hits", lambda h: h["kind"] == "ingredient"), lambda h: h["canon"])), ", ")),
        "receta": F.when(med & F.col("without").isNotNull(), "no").when(med & F.col("with").isNotNull(), "si"),
        "volumen": F.when(split_volume, F.try_element_at("strength.parts", F.lit(-1))["text"]),
        "concentracion": F.when(split_volume, shown(F.slice("strength.parts", F.lit(1), F.size("strength.parts") - 1))).otherwise(F.col("strength.text")),
        "forma": F.col("forma.canon"),
        "via": F.when(oral, "Oral").otherwise(F.col("via.canon")),
        "contenido": F.col("content"),
        "tipo": F.coalesce(F.concat(kind_of("dis"), F.when(F.col("digital").isNotNull(), " digital").otherwise("")), kind_of("cos"), kind_of("beb")),
        "producto": F.coalesce(kind_of("hig"), kind_of("acc")),
        "componente": kind_of("sup"),
        "tecnologia": F.when(cat_is("dis"), F.col("quality.canon")),
        "modelo": cut(F.col("raw"), F.col("model")),
        "atributo": F.when(cat_is("cos", "beb"), F.col("quality.canon")),
        "fps": F.regexp_replace(F.regexp_replace(cut(F.col("raw"), F.col("factor")), r"^\D+", ""), r"\s+", ""),
        "sabor": F.col("flavour.canon"),
    }
    allowed = F.create_map(*[x for c in CATEGORY_FIELDS for x in (F.lit(c), F.array(*[F.lit(k) for k in category_keys(c)]))])[F.col("cat")]
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]), lambda e: (F.coalesce(e["value"], F.lit("")) != "") & F.array_contains(allowed, e["key"]))
    left = F.filter(F.split("rest", f"(?:{PARTING}|{USED})+"), lambda w: w.rlike(r"[\p{L}\d]") & ~F.lower(flat(w)).isin(*STOP_WORDS))
    idle = F.filter(F.transform("doses", lambda d, i: F.when(~(i + 1).isin(F.col("strength_at"), F.col("volume_at")), F.concat(F.lit("Dosis sin asignar: "), d["text"], F.lit(".")))), lambda n: n.isNotNull())
    notes = F.concat(idle, F.array_compact(F.array(
        F.when(F.col("pieces").isNotNull() & F.col("volume").isNotNull(), F.concat(F.lit("Volumen sin asignar: "), F.col("volume.text"), F.lit("."))),
        F.when(F.col("release").isNotNull() & (F.col("content") == ""), F.lit("Liberación prolongada detectada, pero no hay presentación a la cual agregarla.")),
        F.when(F.col("guess").isNotNull(), F.lit("La marca es una sugerencia por posición. Verifícala.")),
    )))
    known, empty = F.col("cat").isNotNull(), F.array().cast("array<string>")
    out = r.rows.select(
        F.col("id").alias(key), "raw", "cat", "ambiguous",
        F.when(known, F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>")).alias("fields"),
        F.when(known, left).when(F.col("raw") == "", empty).otherwise(F.split("raw", " ")).alias("leftover"),
        F.when(known, notes).otherwise(empty).alias("notes"),
    )
    return sealed(out)


def row_state(extracted: DataFrame) -> DataFrame:
    """Adds error: why a text gave no product, null if it gave one."""
    reason = F.when(F.col("cat").isNull(), "No se detectó la categoría. Agrega la columna Categoría o elige una por defecto.").when(F.size("fields") == 0, "No se encontraron datos en el texto crudo.")
    return extracted.withColumn("error", reason)


def unassigned_tokens(extracted: DataFrame, key: str) -> DataFrame:
    """(key, place, token) of what no rule used."""
    return extracted.select(key, F.posexplode("leftover").alias("place", "token"))


def retry_candidates(states: DataFrame, key: str, missing: Column, done: Column) -> DataFrame:
    """Rows of `row_state` worth another try: they have a text, no other try was made (done), and they failed, left words over or still lack what a title needs (missing)."""
    why = F.when(F.col("error").isNotNull(), "error").when(F.size("leftover") > 0, "leftover").when(missing, "title")
    return states.filter((F.col("raw") != "") & ~done).select(key, why.alias("why")).filter("why IS NOT NULL")
