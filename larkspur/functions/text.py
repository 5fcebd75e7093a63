"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The terms that count, and those that don't.
TOKEN_PATTERN = r"[a-z]+(?:'[a-z]+)?|\$?\d[\d,]*(?:\.\d+)?%?"
STOPWORDS = """
    a about above after again against all am an and any are as at
    be because been before being below between both but by
    can could did do does doing down during
    each few for from further
    had has have having he her here hers him his how however
    i if in into is it its itself
    just me more most much must my
    no nor not now of off on once only or other others otherwise our ours out
    over own
    same shall she should so some such than that the their theirs them then
    there these they this those through to too
    under until up us very was we were what when where whether which while who
    whom why will with would you your yours
    company companies
""".split()
# Tags that break lines, and elements that go with their content.
BLOCK_TAGS = "p div br tr table li ul ol h1 h2 h3 h4 h5 h6 section article hr".split()
DROP_TAGS = "script style head".split()  # meta and link are empty elements
# Abbreviations that end in a period but do not end a sentence.
ABBREVIATIONS = """
    inc corp co ltd llc lp plc n.v s.a
    mr mrs ms dr prof jr sr st
    vs etc e.g i.e approx est no nos
    u.s u.k fig figs ref cf al
    jan feb mar apr jun jul aug sep sept oct nov dec
""".split()
#: Entities that are decoded, the ampersand last.
ENTITIES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "bull": "•", "sect": "§", "trade": "™", "euro": "€", "pound": "£", "cent": "¢", "yen": "¥", "deg": "°", "#160": " ", "#39": "'", "#34": '"', "#8217": "’", "#8216": "‘", "#8220": "“", "#8221": "”", "#8211": "–", "#8212": "—", "amp": "&", "#38": "&"}

_STRIP = r"(?U)^\s+|\s+$"


def tokens(text: Column) -> Column:
    """Terms of a text: lower case, figures whole, stopwords dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS))


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(text, _STRIP, "")


def normalised_text(text: Column) -> Column:
    """One kind of line end and quote, single spaces, stripped lines, no blank lines."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.translate(t, "’‘“”", "''\"\"")
    t = F.regexp_replace(t, r"[ \t\x{A0}\x{200B}]+", " ")
    t = F.regexp_replace(t, r"(?Umd)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    t = F.regexp_replace(t, r"(?U)\n\s*\n+", "\n")
    return strip(t)


def html_text(html: Column) -> Column:
    """Visible text, a line for each visual block; table cells run together. Regular markup is assumed: see
    ``sources.html`` for a tolerant parser."""
    t = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?s)<!--.*?-->|<!(?i:doctype)[^>]*>", "")
    for tag in DROP_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)</?[A-Za-z][^>]*>", "")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return normalised_text(t)


def _boundary() -> str:
    closing = r"[\"')\]]{0,4}"
    words = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
    return (
        rf"(?<=[.!?]{closing})(?<!\b[A-Z]\.{closing})"
        rf"(?<!(?:^|[^A-Za-z.])\.{{0,2}}(?i:{words})\.{{1,3}}{closing})\s+(?=[\"'(\[]{{0,4}}[A-Z0-9])"
    )


SENTENCE_BOUNDARY = _boundary()


def sentences(text: Column) -> Column:
    """Sentences of a text, line by line, verbatim."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_BOUNDARY)))


def without_heading(text: Column) -> Column:
    """A section's body without its first line, if that is an item heading and more follows."""
    return strip(F.regexp_replace(text, r"(?is)\A\s*item [^\n]*\n", ""))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def section_label(part: Column, item: Column) -> Column:
    none = item.isNull() | (item == "")
    return F.when(none, "-").when(part.isNotNull() & (part != ""), F.concat(part, F.lit("-"), item)).otherwise(item)


def citation(cik: Column, fiscal_year: Column, label: Column) -> Column:
    return F.concat_ws(":", cik, fiscal_year.cast("string"), label)


def filing_id(cik: Column, accession: Column) -> Column:
    return F.concat_ws("/", cik, accession)


def chunk_id(accession: Column, part: Column, item: Column, order: Column) -> Column:
    dash = lambda c: F.coalesce(empty_to_null(c), F.lit("-"))
    return F.concat_ws("-", accession, dash(part), dash(item), order.cast("string"))


def storage_key(cik: Column, accession: Column, form: Column, fiscal_year: Column) -> Column:
    return F.concat(cik, F.lit("/"), accession, F.lit("/"), form, F.lit("-"), fiscal_year.cast("string"), F.lit(".html"))


def document_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """Address of a document below ``base``: the number without zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(base.rstrip("/")), cik.cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def ids_digest(ids: Column) -> Column:
    """Order-free digest of an array of ids: SHA-256 of the sorted, NUL-terminated ids, 32 digits."""
    joined = F.aggregate(F.array_sort(ids), F.lit(""), lambda acc, x: F.concat(acc, x, F.lit("\0")))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)
