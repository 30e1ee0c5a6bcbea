"""Scalar text functions as column expressions."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTED, PLAIN = "áàäâãåéèëêíìïîóòöôõúùüûñç", "aaaaaaeeeeiiiiooooouuuunc"


def plain_text(c: Column) -> Column:
    """Lower case, without accents, every other character than a letter or digit as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def registry_key(c: Column) -> Column:
    """Upper-case letters and digits only; a null key is empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def slug(c: Column, mark: str = "-") -> Column:
    return F.replace(plain_text(c), F.lit(" "), F.lit(mark))


def tokens(c: Column, stop_words: tuple[str, ...] = (), least: int = 2) -> Column:
    """Distinct words of the plain text in order, without stop words, numbers and shorter words."""
    words = F.array_distinct(F.split(plain_text(c), " "))
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]+$") & ~F.array_contains(stop, w))


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the plain phrase stands in the plain text between word borders."""
    return F.contains(F.concat(F.lit(" "), plain_text(text), F.lit(" ")), F.concat(F.lit(" "), plain_text(phrase), F.lit(" ")))


def _code_point(c: Column) -> Column:
    """The character of a code point; the replacement character for what is none."""
    fine = c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")).otherwise("\ufffd")


def unescaped(c: Column) -> Column:
    """Entities of markup as characters, once: `&name;` of the names that HTML 4 knows, `&#10;` and `&#xA;`; others stay as they are."""
    names = F.create_map(*[F.lit(x) for name, code in html.entities.name2codepoint.items() for x in (name, chr(code))], F.lit("apos"), F.lit("'"))
    sign = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, "^" + sign, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2)))
        known = F.when(number.isNotNull(), _code_point(number.try_cast("long"))).otherwise(F.get(F.map_values(F.map_filter(names, lambda k, _: k == name)), F.lit(0)))
        return F.when(name == "", part).otherwise(F.concat(F.coalesce(known, F.concat(F.lit("&"), name, F.lit(";"))), F.substr(part, F.length(name) + 3)))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, f"(?={sign})"), read), "")).otherwise(c)


def strip_tags(markup: Column) -> Column:
    """Text of markup: scripts and styles go, tags become spaces, entities are read, white space collapses."""
    text = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(text), r"[ \t\r\n\u00a0]+", " "))


def table_rows(markup: Column) -> Column:
    """The rows of the table that has the most, each an array of its cells' texts; null without a table. Cells that span others count once, tables within tables aren't told apart."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)(?=<t[dh][\s>]|</t[dhr]>|$)"), 1), strip_tags)
    rows = lambda table: F.filter(F.transform(F.regexp_extract_all(table, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)(?=<tr[\s>]|</tr>|$)"), 1), cells), lambda r: F.size(r) > 0)
    tables = F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"), 1), rows)
    return F.array_max(F.transform(tables, lambda t: F.struct(F.size(t).alias("n"), t.alias("rows"))))["rows"]


def redact(c: Column) -> Column:
    """E-mail addresses, nine-digit mobile numbers that start with 9, and eight-digit identity numbers, in that order."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(F.regexp_replace(c, r"\b9[0-9]{8}\b", "[PHONE]"), r"\b[0-9]{8}\b", "[ID]")


def locale_number(c: Column) -> Column:
    """Numbers as `1.000,5`, `4,000.00`, `2 000` or `12,5`: the last mark is the decimal one, if not three digits follow it alone."""
    t = F.regexp_replace(c, r"\s", "")
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    value = (
        F.when(both & comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$"), F.regexp_replace(t, "[.,]", ""))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    return value.try_cast("double")


def registry_code(c: Column) -> Column:
    """A registration number such as DE04606 out of free text; empty if there is none."""
    return F.replace(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"\b((?:DE|DN|EE|EN|PN|RD|N)[- ]?[0-9]{4,6})\b", 1), F.lit("-"), F.lit(""))


def price(c: Column) -> Column:
    return locale_number(F.regexp_extract(c, r"([0-9][0-9.,]*)", 1))


#: What marks a review as a medical claim, as holding personal data, or as unsafe dosing.
MEDICAL_CLAIM = ("cura", "curó", "curo", "garantizado", "milagro", "sanó", "sano mi")
PERSONAL_DATA = ("dni", "telefono", "teléfono", "whatsapp", "direccion", "dirección")
UNSAFE_DOSING = ("mg/kg", "sobredosis", "megadosis", "duplicar dosis", "triplicar dosis")
#: Signs that are no part of a word at its ends.
WORD_ENDS = ".,;:!?¡¿()[]{}"


def spam_flags(c: Column) -> Column:
    """Names of the spam signs of a review, in a fixed order; an empty review has none."""
    text = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    has = lambda *parts: F.array_max(F.array(*[F.contains(text, F.lit(p)) for p in parts]))
    words = F.filter(F.transform(F.split(text, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(WORD_ENDS))), lambda w: w != "")
    flag = lambda name, test: F.when(test, F.lit(name))
    found = F.array(
        flag("contains_url", has("http://", "https://", "www.")),
        flag("contains_contact", has("@") & has(".")),
        flag("repeated_characters", text.rlike(r"(?s)(.)\1{7}")),
        flag("medical_claim", has(*MEDICAL_CLAIM)),
        flag("personal_data", has(*PERSONAL_DATA)),
        flag("unsafe_dosing", has(*UNSAFE_DOSING)),
        flag("repeated_words", (F.size(words) >= 8) & (F.size(F.array_distinct(words)) / F.size(words) <= 0.45)),
    )
    return F.array_compact(found)


def scan_key(c: Column) -> Column:
    """A key that survives misread digits: 0, 1, 3, 5 and 8 as o, i, e, s and b."""
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "01358", "oiesb")


def human(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def base_url(c: Column) -> Column:
    return F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def without_tracking(url: Column, names: str = "utm_[a-z]+|ref|fbclid|gclid") -> Column:
    """The url without its fragment and tracking parameters."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, rf"([?&])(?:{names})=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "&&+", "&"), r"\?&+", "?"), "[?&]+$", "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def camel_words(c: Column) -> Column:
    """Words of a name that are joined without spaces; a new one begins at a capital after a small letter, digit or bracket."""
    return F.filter(F.transform(F.split(c, r"(?<=[a-z0-9\)])(?=[A-Z])"), lambda x: F.trim(x)), lambda x: x != "")


#: Words of a product's name that are units or packaging.
UNIT_WORDS = ("MG", "MCG", "UG", "UI", "IU", "ML", "GR", "KG", "UN", "UND", "CAP", "CAPS", "TAB", "TABS", "CT", "OZ")
PACKAGING_WORDS = (
    "CON", "PARA", "LOS", "LAS", "DEL", "POR", "THE", "AND", "PLUS", "WITH", "FROM", "FRASCO", "CAJA", "LATA", "POTE", "SOBRE", "SOBRES", "BOLSA", "TUBO", "PACK", "TABLETAS", "TABLETA", "CAPSULAS", "CAPSULA",
    "COMPRIMIDO", "COMPRIMIDOS", "SOFTGELS", "SOFTGEL", "GOMITAS", "UNIDADES", "BLANDAS", "BLANDA", "MASTICABLES", "POLVO", "SABOR", "VAINILLA", "FRESA", "CHOCOLATE", "NARANJA",
)
#: Spanish names of nutrients and salts and the form they share with English ones.
SYNONYMS = {
    "VITAMINA": "VITAMIN", "VITAMINAS": "VITAMIN", "VITAMINS": "VITAMIN", "CALCIO": "CALCIUM", "MAGNESIO": "MAGNESIUM", "ZINC": "ZN", "HIERRO": "IRON", "POTASIO": "POTASSIUM", "SELENIO": "SELENIUM", "CROMO": "CHROMIUM", "YODO": "IODINE",
    "COBRE": "COPPER", "MANGANESO": "MANGANESE", "COLAGENO": "COLLAGEN", "BIOTINA": "BIOTIN", "LUTEINA": "LUTEIN", "ZEAXANTINA": "ZEAXANTHIN", "GLUCOSAMINA": "GLUCOSAMINE", "CONDROITINA": "CHONDROITIN", "CREATINA": "CREATINE",
    "PROTEINA": "PROTEIN", "GLICINATO": "GLYCINATE", "GLUCONATO": "GLUCONATE", "CITRATO": "CITRATE", "CARBONATO": "CARBONATE", "SULFATO": "SULFATE", "OXIDO": "OXIDE", "CLORURO": "CHLORIDE", "PICOLINATO": "PICOLINATE",
    "BISGLICINATO": "BISGLYCINATE", "COMPLEJO": "COMPLEX", "ELECTROLITOS": "ELECTROLYTES", "ACIDO": "ACID", "FOLICO": "FOLIC", "PROBIOTICOS": "PROBIOTICS", "PROBIOTICO": "PROBIOTICS", "ACEITE": "OIL", "PESCADO": "FISH", "HIGADO": "LIVER",
    "BACALAO": "COD", "MELATONINA": "MELATONIN", "CURCUMA": "TURMERIC", "JENGIBRE": "GINGER", "AJO": "GARLIC",
}


def comparable_tokens(c: Column) -> Column:
    """Distinct words of a product's name, sorted, without units and packaging, Spanish and English names of a nutrient as one."""
    t = F.upper(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN))
    t = F.regexp_replace(F.regexp_replace(t, r"([0-9])[,. ]([0-9]{3})\b", "$1$2"), r"\b([A-Z])-([0-9])", "$1$2")
    words = F.filter(F.regexp_extract_all(t, F.lit("([A-Z0-9]+)"), 1), lambda w: (F.length(w) >= 2) & ~w.isin(*UNIT_WORDS, *PACKAGING_WORDS))
    names = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))))


def names_agree(a: Column, b: Column) -> Column:
    """Whether two names share a comparable word; an empty second one agrees with all."""
    x, y = comparable_tokens(a), comparable_tokens(b)
    return (F.size(y) == 0) | F.arrays_overlap(x, y)


def without_accents(c: Column) -> Column:
    """Every accent of any script removed: what the bounded table of plain_text can't do. In Arrow batches."""

    @F.pandas_udf("string")
    def fold(x):
        import unicodedata

        return x.map(lambda v: None if v is None else "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)))

    return fold(c)


def json_text(c: Column, skip: tuple[str, ...] = ("image", "thumb", "url", "link")) -> Column:
    """All words and numbers in a JSON value in order, but those under a key that holds one of `skip`; null if it isn't JSON."""

    @F.pandas_udf("string")
    def flat(x):
        import json

        def walk(v):
            if isinstance(v, dict):
                return [p for k, child in v.items() if not any(s in k.lower() for s in skip) for p in walk(child)]
            if isinstance(v, list):
                return [p for child in v for p in walk(child)]
            return [] if v is None else [" ".join(str(v).split())]

        def one(v):
            try:
                return None if v is None else " ".join(p for p in walk(json.loads(v)) if p)
            except (ValueError, RecursionError):
                return None

        return x.map(one)

    return flat(c)


#: Words that begin a line of a report about a person.
HEADER_WORDS = (
    "paciente", "nombre", "nombres", "apellido", "apellidos", "dni", "documento", "ci", "c.i", "c.i.", "pasaporte", "historia clinica", "historia clínica", "hc", "fecha de nacimiento",
    "f nac", "f. nac", "f.nac", "fnac", "direccion", "dirección", "telefono", "teléfono", "celular", "correo", "email", "e-mail", "medico", "médico", "dr", "dr.", "dra", "dra.",
)


def redact_report(c: Column) -> Column:
    """Lines about a person, then e-mail addresses, mobile numbers and identity numbers, in that order."""
    words = "|".join(w.replace(".", "\\.").replace(" ", "\\s+") for w in sorted(HEADER_WORDS, key=len, reverse=True))
    return redact(F.regexp_replace(c, rf"(?im)^[ \t]*(?:{words})(?![\p{{L}}0-9_]).*$", "[LINE]"))


#: Parts of column names that stand for personal data.
PERSONAL_NAMES = ("name", "nombre", "apellido", "dni", "document", "email", "correo", "phone", "telefono", "celular", "address", "direccion", "birth", "nacimiento")


def personal_columns(columns: list[str], source_id: str = "source_case_id") -> list[str]:
    """Columns whose names tell of personal data; the source's own id isn't one."""
    return [c for c in columns if c.strip().lower() != source_id and any(p in c.strip().lower() for p in PERSONAL_NAMES)]


def personal_values(columns: list[str], numbers: tuple[str, ...] = (), source_id: str = "source_case_id") -> Column:
    """Findings `column:email` and `column:phone_like` in a row's values; numbers aren't searched for telephones, and an address hides a telephone."""
    def one(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        phone = F.lit(False) if c in numbers else text.rlike(r"(?<![0-9])(?:[0-9][ \-]?){9,}(?![0-9])")
        return F.when(text.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), f"{c}:email").when(phone, f"{c}:phone_like")

    return F.array_compact(F.array(*[one(c) for c in columns if c != source_id]))


#: Endings and parameters of image addresses, and what marks one that shows no product.
IMAGE_ENDINGS, IMAGE_PARAMETERS = (".jpg", ".jpeg", ".png", ".webp"), ("format=jpg", "format=jpeg", "format=png", "format=webp", "fm=jpg", "fm=webp")
NO_PRODUCT_PATH, NO_PRODUCT_HOST = ("placeholder", "default", "no-image", "no_image", "logo"), ("facebook", "google", "analytics", "tagmanager")


def image_urls(html: Column, base: Column, most: int = 8) -> Column:
    """The first distinct image addresses of a page: of src and data-src first, then bare ones; relative ones belong to the base. Those over 500 characters don't count."""
    named = F.regexp_extract_all(html, F.lit(r"(?i)(?:data-)?src\s*=\s*[\"']([^\"']+)[\"']"), 1)
    bare = F.regexp_extract_all(html, F.lit(r"(?i)(https?://[^\s\"'<>]+\.(?:jpg|jpeg|png|webp))"), 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    whole = lambda u: F.when(F.lower(u).rlike("^https?://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(root, F.lit("/"), u))
    path = lambda u: F.lower(F.regexp_extract(u, r"^[^?#]*", 0))
    query = lambda u: F.lower(F.regexp_extract(u, r"\?([^#]*)", 1))
    image = lambda u: (F.length(u) <= 500) & (path(u).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in IMAGE_ENDINGS) + ")$") | query(u).rlike("|".join(IMAGE_PARAMETERS)))
    return F.slice(F.array_distinct(F.filter(F.transform(F.concat(named, bare), lambda u: whole(F.trim(u))), image)), 1, most)


def first_image(urls: Column) -> Column:
    """The first address that may show a product; empty if none."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1))
    rest = lambda u: F.lower(F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1))
    fine = F.filter(urls, lambda u: u.startswith("http") & ~rest(u).rlike("|".join(NO_PRODUCT_PATH)) & ~host(u).rlike("|".join(NO_PRODUCT_HOST)))
    return F.coalesce(F.get(fine, F.lit(0)), F.lit(""))


def tagged(expression: Column, tag: str = "[tiab]") -> Column:
    """Each alternative of an OR with a field's tag, in brackets; an expression with an AND stays as it is."""
    parts = F.transform(F.split(expression, " OR "), lambda p: F.concat(F.trim(p), F.lit(tag)))
    return F.concat(F.lit("("), F.when(F.contains(expression, F.lit(" AND ")), expression).otherwise(F.array_join(parts, " OR ")), F.lit(")"))


def search_query(term: Column, outcome: Column, claim_type: Column, study_filter: str, tag: str = "[tiab]") -> Column:
    """A literature search: the component's terms and the outcome's, repletion for claims of a deficiency, and the filter of studies; null without terms or outcome."""
    more = F.when(F.coalesce(claim_type.startswith("deficiency"), F.lit(False)), " AND (supplement*[tiab] OR repletion[tiab] OR treatment[tiab])").otherwise("")
    return F.when((term != "") & (outcome != ""), F.concat(tagged(term, tag), F.lit(" AND "), tagged(outcome), more, F.lit(f" AND {study_filter}")))
