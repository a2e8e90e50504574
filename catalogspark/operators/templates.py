"""Meta titles, meta descriptions and image texts from line templates, compiled into Column expressions.

A template has one block a line. `{token}` is a value, `{token:lc}` with a small first letter, `{token:o}` one that may be
empty; a line whose other tokens are all empty goes. Text in brackets is optional: a bracket whose tokens are all
empty goes, and brackets go from the right while the text is longer than the limit. A title that is still too long may be
shortened by whole lines: the line of the store first, then the last lines, never the first one.

A template is read once, when the expression is built. Each level of dropping is an expression of its own, and the first that
fits is taken, so rendering is one projection over one row. Missing values count as empty; a token that no value was given for is
reported and empty. Lengths are in characters.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.operators.titles import capital, words

# Templates of each category, as (template, separator, most characters).
TITLES = {
    "med": ("Comprar {marca} {concentracion}\n{principio}\n{laboratorio}", " | ", 60),
    "dis": ("{marca} {modelo} {nombre_seo}\n{variante_seo}\n[{tienda}]", " | ", 60),
    "cos": ("{marca} {nombre_seo}[ {con_activo}]\n{variante_seo}\n[{tienda}]", " | ", 60),
    "sup": ("{marca}[ {tipo_seo}]\n{variante_seo}\n[{tienda}]", " | ", 60),
    "beb": ("{marca} {nombre_seo}\n{variante_seo}\n[{tienda}]", " | ", 60),
    "hig": ("{marca} {nombre_seo}\n{variante_seo}\n[{tienda}]", " | ", 60),
    "acc": ("{marca} {nombre_seo}\n{variante_seo}\n[{tienda}]", " | ", 60),
}
DESCRIPTIONS = {
    "med": ("El {marca} de {concentracion} contiene {principio} por {laboratorio}\nVenta en línea {receta_txt:o} de forma segura", " | ", 155),
    "dis": ("{marca} {modelo} {nombre_seo}\n{uso_pub}\n[Compra en {tienda}]", ". ", 155),
    "cos": ("{marca} {nombre}[ {con_activo}]\n{beneficio_piel}\n{presentacion}\n[Compra en {tienda}]", ". ", 155),
    "sup": ("{marca} {tipo_seo}, {variante_seo}\n{fabricante}\n[{caracteristica1}]", ". ", 155),
    "beb": ("{marca} {nombre}\n{beneficio_pub}\n{presentacion}\n[Compra en {tienda}]", ". ", 155),
    "hig": ("{marca} {nombre}\n{beneficio_pub}\n{presentacion}\n[Compra en {tienda}]", ". ", 155),
    "acc": ("{marca} {nombre}\n{uso_pub}\n{presentacion}\n[Compra en {tienda}]", ". ", 155),
}
IMAGE_TEXTS = {
    "med": ("{marca} {concentracion}\n{principio}\n{contenido:lc}", ", ", 125),
    "dis": ("{marca} {modelo} {tipo:lc}\n{tecnologia:lc}", ", ", 125),
    "cos": ("{marca} {producto} {tipo:lc}\n{contenido:lc}", ", ", 125),
    "sup": ("{marca} {componente}\n{contenido:lc}", ", ", 125),
    "beb": ("{marca} {tipo:lc}\nsabor {sabor:lc}\n{contenido}", ", ", 125),
    "hig": ("{marca} {producto}\n{contenido:lc}", ", ", 125),
    "acc": ("{marca} {producto}\n{contenido:lc}", ", ", 125),
}
#: Categories whose structure of meta texts is confirmed.
CONFIRMED = ("med",)
# How an image text must not begin, formulas for infants, packs of packs, factors of protection.
BAD_START = r"(?iu)^(imagen|foto|fotograf[ií]a)(?![A-Za-z0-9_])"
FORMULA = r"(?iu)(?<![A-Za-z0-9_])f[oó]rmula (?:infantil|para lactantes|de seguimiento|de continuaci[oó]n)(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])lactantes?(?![A-Za-z0-9_])"
PACK_OF_PACKS, FACTOR = r"(?i)\d\s*x\s*\d", r"(?i)^\s*(?:fps|spf)(?![A-Za-z0-9_])"
TOKEN = re.compile(r"\{(\w+)(?::(lc|o))?\}")
GROUP = re.compile(r"\[([^\[\]]*)\]")
TRAILING, LEADING, DANGLING = r"(\s*[/,\-–]\s*)+\z", r"^(\s*[/,\-–]\s*)+", r"(?i)\s+(por|de|con|en)\z"


def small(c: Column) -> Column:
    """First letter small, but for a word in capitals."""
    return F.when(c.rlike("^[A-ZÁÉÍÓÚÑ]{2}"), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))


def _let(c: Column, f) -> Column:
    """f of c, with c computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


class Template:
    """A template over tokens; render() compiles it."""

    def __init__(self, text: str, separator: str, most: int, tokens: dict[str, Column]):
        self.text, self.separator, self.most, self.tokens = text, separator, most, tokens
        self.groups = GROUP.findall(text)
        self.unknown = sorted({k for k, _ in TOKEN.findall(text)} - set(tokens))
        self.lines = [x.strip() for x in re.split(r"\r?\n", text) if x.strip()]
        self.sentences = separator.lstrip().startswith(".")

    def value(self, key: str, how: str = "") -> Column:
        c = self.tokens.get(key)
        if c is None:
            return F.lit("")
        c = F.coalesce(c, F.lit(""))
        return small(c) if how == "lc" else c

    def filled(self, part: str) -> Column | None:
        """Whether a required token of a text has a value; None without such tokens."""
        asked = [self.value(k) != "" for k, how in TOKEN.findall(part) if how != "o" and k in self.tokens]
        return F.greatest(F.lit(False), *asked) if asked else None

    def group_stays(self, inner: str) -> Column:
        found = TOKEN.findall(inner)
        if not found:
            return F.lit(True)
        asked = [self.value(k) != "" for k, how in found if how != "o"]
        return F.greatest(F.lit(False), *asked) if asked else F.lit(False)

    def shown(self, part: str) -> list[Column]:
        out, at = [], 0
        for m in TOKEN.finditer(part):
            out += [F.lit(part[at : m.start()]), self.value(m[1], m[2] or "")]
            at = m.end()
        return [*out, F.lit(part[at:])]

    def line(self, line: str, first_group: int, kept_groups: int) -> Column:
        """Text of a line, null where it goes; groups from kept_groups on are dropped."""
        text, raw, asked, at, n = [], [], [], 0, first_group
        for m in GROUP.finditer(line):
            outer = line[at : m.start()]
            text += self.shown(outer)
            raw.append(F.lit(outer))
            asked.append(self.filled(outer))
            if n < kept_groups:
                stays = self.group_stays(m[1])
                text.append(F.when(stays, F.concat(*self.shown(m[1]))).otherwise(""))
                raw.append(F.when(stays, F.lit(m[1])).otherwise(""))
                inner = self.filled(m[1])
                asked.append(None if inner is None else F.when(stays, inner))
            at, n = m.end(), n + 1
        text += self.shown(line[at:])
        raw.append(F.lit(line[at:]))
        asked.append(self.filled(line[at:]))
        asked = [a for a in asked if a is not None]
        whole = F.concat(*text)
        whole = F.regexp_replace(F.regexp_replace(whole, r"\(\s*\)", ""), r"\s+", " ")
        whole = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, TRAILING, ""), LEADING, ""), DANGLING, ""))
        if self.sentences:
            whole = F.regexp_replace(whole, r"\.+\z", "")
        lost = F.lit(False)
        if asked:  # at least one token is asked for, and none has a value
            any_asked = F.greatest(*[a.isNotNull() for a in asked], F.lit(False))
            lost = any_asked & ~F.coalesce(F.greatest(*[F.coalesce(a, F.lit(False)) for a in asked], F.lit(False)), F.lit(False))
        return F.when((F.trim(F.concat(*raw)) != "") & ~lost, F.nullif(whole, F.lit("")))

    def joined(self, lines: list[Column]) -> Column:
        text = F.array_join(F.array_compact(F.array(*lines)), self.separator)
        if self.sentences:
            text = _let(text, lambda x: F.when((x != "") & ~x.rlike(r"[.!?]\z"), F.concat(x, F.lit("."))).otherwise(x))
        return F.trim(text)

    def blocks(self, kept_groups: int) -> dict[tuple[int, int], Column]:
        """Text of each line by its number and how many of its own groups are kept: levels that keep the same ones share it."""
        out, n = {}, 0
        for i, line in enumerate(self.lines):
            own = len(GROUP.findall(line))
            out[i, min(max(kept_groups - n, 0), own)] = self.line(line, n, kept_groups)
            n += own
        return out

    def group_texts(self) -> list[Column]:
        return [F.when(self.group_stays(g), F.nullif(F.trim(F.concat(*self.shown(g))), F.lit(""))) for g in self.groups]

    def render(self, shorten: bool = False) -> Column:
        """(text, length, over, dropped, shortened): dropped has the texts that went for the limit, in the order in which they went."""
        n = len(self.groups)
        levels = [self.blocks(n - d) for d in range(n + 1)]
        unique = {k: c for level in levels for k, c in level.items()}
        place = {k: i for i, k in enumerate(unique)}
        # every line is rendered once a row; levels and shortened texts join what is there
        of = lambda texts, level: [F.get(texts, F.lit(place[k])) for k in level]
        return _let(F.array(*unique.values()), lambda texts: self.rendered([of(texts, level) for level in levels], shorten))

    def rendered(self, lines: list[list[Column]], shorten: bool) -> Column:
        """render() of the lines of every level, from all groups kept to none."""
        n = len(self.groups)
        levels = F.array(*[F.struct(self.joined(lines[d]).alias("text"), F.lit(d).alias("d")) for d in range(n + 1)])
        fits = lambda x: F.length(x["text"]) <= self.most if self.most else F.lit(True)
        groups = F.array(*self.group_texts()) if n else F.array().cast("array<string>")

        def told(found: Column) -> Column:
            gone = F.array_compact(F.reverse(F.slice(groups, F.lit(n + 1) - found["d"], found["d"]))) if n else F.array().cast("array<string>")
            base = F.struct(found["text"].alias("text"), gone.alias("dropped"), F.lit(False).alias("shortened"))
            if not (shorten and self.most and len(self.lines) > 1):
                return base
            return F.when(fits(found), base).otherwise(F.coalesce(self.shortened(lines[n], gone), base))

        def whole(out: Column) -> Column:
            size = F.length(out["text"])
            return F.struct(out["text"].alias("text"), size.alias("length"), (size > self.most if self.most else F.lit(False)).alias("over"), out["dropped"].alias("dropped"), out["shortened"].alias("shortened"))

        chosen = lambda found: F.coalesce(F.get(F.filter(found, fits), F.lit(0)), F.get(found, F.lit(n)))
        return _let(_let(_let(levels, chosen), told), whole)

    def shortened(self, blocks: list[Column], gone: Column) -> Column:
        """The text after as many whole lines went as it takes, null if that never fits. Only texts with all their brackets dropped come here."""
        store = [i for i in range(1, len(blocks)) if re.search(r"\{tienda(?::\w+)?\}", GROUP.sub("", self.lines[i]))]
        order = store + [i for i in range(len(blocks) - 1, 0, -1) if i not in store]
        tries, out = [], []
        for i in order:
            out.append(i)
            text = self.joined([b for k, b in enumerate(blocks) if k not in out])
            lost = F.array_compact(F.array(*[F.nullif(self.joined([blocks[k]]), F.lit("")) for k in out]))
            tries.append(F.when((F.length(text) <= self.most) & (text != "") & (F.size(lost) > 0), F.struct(text.alias("text"), F.concat(gone, lost).alias("dropped"), F.lit(True).alias("shortened"))))
        return F.coalesce(*tries)


def extra_words(text: Column, known: Column) -> Column:
    """Words of a text that hold more than what another text says already."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: (w != "") & (F.size(F.array_except(words(w), words(known))) > 0)), " ")


def named(product: Column, kind: Column) -> Column:
    """A product and those words of its kind that it does not have yet."""
    more = extra_words(kind, product)
    return F.concat_ws(" ", F.nullif(product, F.lit("")), F.nullif(more, F.lit("")))


def _listed(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts])


def _or(*parts: Column) -> Column:
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def _held(content: Column, container: Column, between: str) -> Column:
    return F.when(content == "", "").when(container == "", content).otherwise(F.concat(container, F.lit(between), content))


def meta_tokens(cat: str, v: dict[str, Column], title: Column, store: str = "", name: str = "") -> dict[str, Column]:
    """Tokens of a category from its deduplicated fields v (`titles.deduped`)."""
    f = lambda k: F.coalesce(v[k], F.lit("")) if k in v else F.lit("")
    out = dict(v) | {"titulo": title, "categoria": F.lit(name), "tienda": F.lit(store.strip()), "receta_txt": F.when(f("receta") == "si", "con receta médica").otherwise("")}
    out["tipo_seo"] = _or(f("tipoCorto"), f("componente"), f("tipo"), f("producto"), f("modelo"))
    out["variante_seo"] = _listed(_or(f("sabor"), f("variante")), f("talla"), f("contenido"))
    first = F.get(F.split(f("caracteristicas"), r"(?<=[.!?])\s+"), F.lit(0))
    out["caracteristica1"] = F.regexp_replace(F.trim(first), r"\.\z", "")
    to_public = lambda what: F.when(what == "", F.when(f("publico") == "", "").otherwise(F.concat(F.lit("Para "), small(f("publico"))))).when(f("publico") == "", what).otherwise(F.concat(what, F.lit(" para "), small(f("publico"))))
    if cat in ("cos", "hig", "beb", "acc"):
        out["nombre"], out["nombre_seo"] = named(f("producto"), f("tipo")), named(f("producto"), _or(f("tipoCorto"), f("tipo")))
        out["presentacion"] = _held(f("contenido"), f("envase"), " de ")
    if cat == "acc":
        size = F.when(f("talla").rlike(r"(?i)^talla(?![A-Za-z0-9_])"), f("talla")).when(f("talla") != "", F.concat(F.lit("Talla "), f("talla"))).otherwise("")
        out["variante_seo"] = _listed(f("compresion"), size, f("lado"), f("color"), f("contenido"))
        out["uso_pub"] = _let(_or(f("uso"), extra_words(f("material"), _or(f("tipo"), f("producto")))), capital)
        out["presentacion"] = F.when(f("contenido") == "", f("envase")).otherwise(_held(f("contenido"), f("envase"), " con "))
    if cat == "dis":
        out["nombre_seo"] = _or(f("tipoCorto"), f("tipo"))
        out["variante_seo"] = _listed(_let(extra_words(f("tecnologia"), f("tipo")), capital), f("contenido"))
        out["uso_pub"] = capital(f("uso"))
    if cat == "beb":
        taste = F.when(f("sabor").rlike(r"(?i)^sabor(?![A-Za-z0-9_])"), f("sabor")).when(f("sabor") != "", F.concat(F.lit("Sabor "), f("sabor"))).otherwise("")
        out["variante_seo"] = _listed(taste, f("etapa"), f("contenido"))
        out["beneficio_pub"] = _let(F.when(f("tipo").rlike(FORMULA), "").otherwise(f("beneficio")), to_public)
        many = (f("contenido") != "") & (f("envase") != "") & f("contenido").rlike(PACK_OF_PACKS)
        out["presentacion"] = F.when(many, F.concat(f("envase"), F.lit(" ("), f("contenido"), F.lit(")"))).otherwise(out["presentacion"])
    if cat == "hig":
        out["beneficio"] = _or(f("beneficio"), f("uso"))
        out["beneficio_pub"] = to_public(out["beneficio"])
    if cat == "cos":
        out["con_activo"] = F.when(f("fps") != "", F.concat(F.lit("FPS "), f("fps"))).when((f("atributo") != "") & ~f("atributo").rlike(FACTOR), F.concat(F.lit("con "), small(f("atributo")))).otherwise("")
        out["piel_lc"] = small(f("piel"))
        skin = F.when(f("piel") == "", "").otherwise(F.concat(F.lit("Para "), small(f("piel"))))
        out["beneficio_piel"] = F.when(f("beneficio") == "", skin).when(f("piel") == "", f("beneficio")).otherwise(F.concat(f("beneficio"), F.lit(" para "), small(f("piel"))))
    return out


def meta_texts(cat: str, tokens: dict[str, Column], shorten: bool = False, templates=None) -> Column:
    """(title, description, image) of a category, each as Template.render gives it."""
    of = templates or {"title": TITLES[cat], "description": DESCRIPTIONS[cat], "image": IMAGE_TEXTS[cat]}
    return F.struct(*[Template(*of[k], tokens).render(shorten and k == "title").alias(k) for k in ("title", "description", "image")])



def bad_start(c: Column) -> Column:
    """Whether an image text begins as it must not, since a reader says that it is an image anyway."""
    return F.coalesce(c, F.lit("")).rlike(BAD_START)
