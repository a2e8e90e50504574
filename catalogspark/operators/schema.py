"""Category schema as data: which fields a category has, which it needs, and how a field is read, checked and written."""

# Names of the categories.
CATEGORIES = {
    "med": "Medicamentos",
    "dis": "Dispositivos médicos",
    "cos": "Dermacosméticos / Cosméticos",
    "sup": "Suplementos alimenticios",
    "beb": "Bebidas e hidratación",
    "hig": "Cuidado personal e higiene",
    "acc": "Accesorios y generales",
}
# Fields of each category in order, as (key, label, required, kinds). Kinds: pack (a pack or content), model (kept as it is), raw (kept
# but for blanks), code (upper case), sentence, lines (one entry a line), select (a closed list); a field without kind is a name or a short text.
FIELDS = {
    "med": (
        ("marca", "Marca", True, ""),
        ("concentracion", "Concentración", True, ""),
        ("volumen", "Volumen", False, ""),
        ("principio", "Principio activo", True, ""),
        ("forma", "Forma farmacéutica", True, "pack"),
        ("contenido", "Presentación o piezas", True, "pack"),
        ("laboratorio", "Laboratorio", True, ""),
        ("categoria", "Categoría", False, ""),
        ("via", "Vía de administración", True, ""),
        ("receta", "¿Requiere receta médica?", True, "select"),
        ("leyenda", "Leyenda regulatoria adicional", False, ""),
        ("area", "Área terapéutica", False, "select"),
        ("area2", "Segunda área terapéutica", False, "select"),
        ("atc", "Código ATC", False, "raw code"),
        ("especialidad", "¿Es de alta especialidad?", False, "select"),
        ("indicaciones", "Indicaciones", False, "sentence"),
        ("posologia", "Posología o cómo se usa", False, "sentence"),
        ("poblacion", "Población a la que va dirigido", False, "sentence"),
        ("contraindicaciones", "Contraindicaciones y advertencias", False, "sentence"),
    ),
    "dis": (
        ("marca", "Marca", True, ""),
        ("modelo", "Modelo", True, "model"),
        ("tipo", "Tipo de dispositivo", True, ""),
        ("tecnologia", "Tecnología o zona de medición", False, ""),
        ("fabricante", "Fabricante", True, ""),
        ("categoria", "Categoría", False, ""),
        ("uso", "Uso previsto", False, ""),
        ("contenido", "Contenido o piezas", False, "pack"),
        ("presentacion", "Presentación", False, "pack"),
        ("publico", "Dirigido a", False, ""),
        ("registro", "Registro sanitario", False, "raw"),
        ("caracteristicas", "Características técnicas verificables", False, "lines"),
        ("especificaciones", "Especificaciones técnicas", False, "raw lines"),
        ("paquete", "Contenido del paquete", False, ""),
        ("compatibilidad", "Compatibilidad", False, "sentence"),
        ("modo", "Instrucciones de uso", False, "sentence"),
        ("advertencias", "Advertencias", False, "sentence"),
        ("declarada", "Declarado en el empaque", False, "raw"),
        ("extra", "Especificaciones adicionales", False, ""),
        ("tipoCorto", "Tipo corto (para el meta title)", False, ""),
        ("compat", "Insumos compatibles (SKU)", False, "raw"),
        ("area", "Área de uso o necesidad", False, "select"),
    ),
    "cos": (
        ("marca", "Marca", True, ""),
        ("producto", "Línea o nombre del producto", False, ""),
        ("tipo", "Tipo de producto", False, ""),
        ("beneficio", "Beneficio principal", False, ""),
        ("atributo", "Activo principal", False, ""),
        ("contenido", "Contenido neto", True, "pack"),
        ("fabricante", "Laboratorio", True, ""),
        ("categoria", "Categoría", False, ""),
        ("envase", "Presentación (envase)", False, "pack"),
        ("zona", "Zona de aplicación", False, ""),
        ("variante", "Tono, aroma o variante", False, ""),
        ("piel", "Tipo de piel o necesidad declarada", False, ""),
        ("ingredientes", "Activos destacados", False, ""),
        ("textura", "Textura u objetivo cosmético", False, ""),
        ("beneficios", "Beneficios", False, "lines"),
        ("atributos", "Características declaradas", False, "sentence"),
        ("tipoCorto", "Tipo corto (para el meta title)", False, ""),
        ("comercial", "Frase comercial objetiva", False, ""),
        ("inci", "Lista de ingredientes (INCI)", False, "raw"),
        ("modo", "Modo de uso", False, "sentence"),
        ("precauciones", "Precauciones", False, "sentence"),
        ("fps", "Factor de protección solar (FPS)", False, ""),
        ("nivel", "Nivel de protección", False, "select"),
        ("espectro", "Espectro", False, ""),
        ("resistencia", "Resistencia al agua", False, ""),
        ("pao", "Duración después de abierto (PAO)", False, ""),
        ("origen", "País de origen", False, ""),
        ("rutina", "Paso de rutina", False, "select"),
        ("area", "Área de uso o necesidad", False, "select"),
    ),
    "sup": (
        ("marca", "Marca", True, ""),
        ("componente", "Tipo o componente principal", True, ""),
        ("forma", "Forma", True, "pack"),
        ("contenido", "Contenido neto o piezas", True, "pack"),
        ("fabricante", "Laboratorio", True, ""),
        ("categoria", "Categoría", False, ""),
        ("composicion", "Composición (resumen)", False, ""),
        ("caracteristicas", "Características objetivas", False, ""),
        ("tipoCorto", "Tipo corto (para el meta title)", False, ""),
        ("sabor", "Sabor", False, ""),
        ("porcion", "Tamaño de porción", False, ""),
        ("porciones", "Porciones por envase", False, ""),
        ("nutrimental", "Información nutrimental", False, "raw lines"),
        ("modo", "Modo de consumo", False, "sentence"),
        ("ingredientes", "Lista de ingredientes", False, "raw"),
        ("alergenos", "Alérgenos", False, "sentence"),
        ("advertencias", "Advertencias", False, "sentence"),
        ("atributos", "Atributos del empaque", False, "sentence"),
        ("publico", "Dirigido a", False, ""),
        ("envase", "Tipo de envase", False, "pack"),
        ("area", "Área de uso o necesidad", False, "select"),
    ),
    "beb": (
        ("marca", "Marca", True, ""),
        ("producto", "Línea o nombre del producto", False, ""),
        ("tipo", "Tipo de bebida", True, ""),
        ("beneficio", "Beneficio principal", False, ""),
        ("sabor", "Sabor", False, ""),
        ("atributo", "Atributo verificado", False, ""),
        ("contenido", "Contenido neto", True, "pack"),
        ("categoria", "Categoría", False, ""),
        ("fabricante", "Laboratorio", False, ""),
        ("envase", "Presentación (envase)", False, "pack"),
        ("etapa", "Etapa", False, ""),
        ("publico", "Dirigido a", False, ""),
        ("descripcion", "Descripción objetiva", False, ""),
        ("caracteristicas", "Características verificables", False, ""),
        ("beneficios", "Beneficios", False, "lines"),
        ("atributos", "Características declaradas", False, "sentence"),
        ("leyenda", "Sellos y leyendas del empaque", False, "raw"),
        ("ingredientes", "Lista de ingredientes", False, "raw"),
        ("alergenos", "Alérgenos", False, "sentence"),
        ("modo", "Modo de consumo", False, "sentence"),
        ("porcion", "Tamaño de porción", False, ""),
        ("porciones", "Porciones por envase", False, ""),
        ("nutrimental", "Información nutrimental", False, "raw lines"),
        ("tipoCorto", "Tipo corto (para el meta title)", False, ""),
        ("area", "Área de uso o necesidad", False, "select"),
    ),
    "hig": (
        ("marca", "Marca", True, ""),
        ("producto", "Línea o nombre del producto", False, ""),
        ("tipo", "Tipo de producto", False, ""),
        ("beneficio", "Beneficio principal", False, ""),
        ("variante", "Aroma o variante", False, ""),
        ("contenido", "Contenido neto", True, "pack"),
        ("fabricante", "Laboratorio", True, ""),
        ("categoria", "Categoría", False, ""),
        ("talla", "Talla o etapa", False, ""),
        ("publico", "Dirigido a", False, ""),
        ("envase", "Presentación (envase)", False, "pack"),
        ("uso", "Uso objetivo", False, ""),
        ("ingredientes", "Activos destacados", False, ""),
        ("beneficios", "Beneficios", False, "lines"),
        ("caracteristicas", "Características", False, ""),
        ("atributos", "Características declaradas", False, "sentence"),
        ("fluor", "Flúor declarado", False, ""),
        ("duracion", "Duración declarada", False, ""),
        ("tipoCorto", "Tipo corto (para el meta title)", False, ""),
        ("inci", "Lista de ingredientes (INCI)", False, "raw"),
        ("modo", "Modo de uso", False, "sentence"),
        ("precauciones", "Precauciones", False, "sentence"),
        ("area", "Área de uso o necesidad", False, "select"),
    ),
    "acc": (
        ("marca", "Marca", True, ""),
        ("producto", "Línea o nombre", False, ""),
        ("tipo", "Tipo de accesorio", False, ""),
        ("uso", "Uso o beneficio", False, ""),
        ("material", "Material", False, ""),
        ("contenido", "Contenido neto", True, "pack"),
        ("fabricante", "Fabricante", True, ""),
        ("categoria", "Categoría", False, ""),
        ("envase", "Presentación", False, "pack"),
        ("talla", "Talla", False, ""),
        ("lado", "Lado", False, ""),
        ("color", "Color", False, ""),
        ("compresion", "Nivel de compresión", False, ""),
        ("publico", "Dirigido a", False, ""),
        ("beneficios", "Beneficios", False, "lines"),
        ("tallas", "Guía de tallas y medidas", False, "raw lines"),
        ("modo", "Modo de uso", False, "sentence"),
        ("cuidados", "Cuidado y limpieza", False, "sentence"),
        ("advertencias", "Advertencias", False, "sentence"),
        ("declarada", "Declarado en el empaque", False, "raw"),
        ("registro", "Registro sanitario", False, "raw"),
        ("compatibilidad", "Compatibilidad", False, "sentence"),
        ("queEs", "¿Qué es? Descripción objetiva", False, ""),
        ("caracteristicas", "Características principales", False, ""),
        ("paquete", "Incluye", False, ""),
        ("tipoCorto", "Tipo corto (para el meta title)", False, ""),
        ("compat", "Productos compatibles (SKU)", False, "raw"),
        ("area", "Área de uso o necesidad", False, "select"),
    ),
}
# Closed options, and fields whose value is a number.
AREAS = (
    "Diabetes y metabolismo", "Control de peso", "Cardiovascular", "Digestivo y gastrointestinal", "Respiratorio y alergias", "Dolor e inflamación", "Infecciones", "Salud mental y neurología",
    "Hormonal y salud sexual", "Piel y dermatología", "Ojos y oídos", "Oncología e inmunología", "Nutrición y vitaminas", "Hidratación", "Higiene y cuidado personal", "Otra",
)
OPTIONS = {
    "receta": ("si", "no"),
    "especialidad": ("si", "no"),
    "area": AREAS,
    "area2": AREAS,
    "nivel": ("Baja", "Media", "Alta", "Muy alta"),
    "rutina": ("Limpieza", "Tratamiento", "Hidratación", "Protección solar", "Maquillaje", "Cabello"),
}
NUMERIC = ("concentracion", "volumen", "contenido", "fps")
#: The keys of each category in order.
CATEGORY_FIELDS = {cat: tuple(key for key, *_ in fields) for cat, fields in FIELDS.items()}


def category_keys(cat: str) -> tuple:
    return CATEGORY_FIELDS[cat]


def category_fields(spark):
    """(cat, key, required, options, numeric, label, kinds, place): one row for each field of each category."""
    rows = [(cat, key, required, list(OPTIONS[key]) if key in OPTIONS else None, key in NUMERIC, label, kinds.split(), i) for cat, fields in FIELDS.items() for i, (key, label, required, kinds) in enumerate(fields)]
    return spark.createDataFrame(rows, "cat string, key string, required boolean, options array<string>, numeric boolean, label string, kinds array<string>, place int")
