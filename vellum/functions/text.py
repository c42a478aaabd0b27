"""Scalar functions, Column to Column. Python's Unicode white space needs ``(?U)``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEASONS = {"01": ("Fall", "Guz"), "02": ("Spring", "Bahar"), "03": ("Summer", "Yaz")}
DAYS = {"M": "Monday", "T": "Tuesday", "W": "Wednesday", "R": "Thursday", "F": "Friday", "S": "Saturday", "U": "Sunday"}
REQUIREMENT_NEEDLES = {"university": ("university", "universite"), "required": ("required", "zorunlu"), "core": ("core", "cekirdek"), "area": ("area", "alan"), "free": ("free", "serbest")}
PII = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+|\+?\d[\d\s().-]{7,}\d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once a row however often ``body`` names it, also within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_else(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where ``a`` is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def normalize_text(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "\r", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n+", " "))


def _composed(c: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    # Texts below U+0300 have the normal form already; they stay in the JVM.
    other = c.rlike("[^\\x00-\\x{2FF}]")
    return F.coalesce(nfc(F.when(other, c)), c)


def clean_text(c: Column, compose: bool = True) -> Column:
    """Document cleaning. ``compose=False`` skips the normal form, the only step that leaves the JVM, where texts are known to have it."""
    c = _composed(c) if compose else c
    c = F.regexp_replace(c, "[\u00a0\u200b\u200c\u200d\ufeff]", "")
    c = F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), r"[ \t]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return strip(c)


def clean_value(token: Column) -> Column:
    """Text of a raw JSON scalar: integral floats lose the fraction, booleans are capitalised."""
    number = F.try_to_number(token, F.lit("S999999999999999D999")).isNotNull() | token.rlike(r"^-?\d+\.0+$")
    return (
        F.when(token.isNull() | (token == "null"), "")
        .when(token.isin("true", "false"), F.initcap(token))
        .when(number & token.rlike(r"^-?\d+\.0+$"), F.regexp_replace(token, r"\.0+$", ""))
        .otherwise(normalize_text(token))
    )


def store_clean(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(*parts: Column, separator: str = "\n") -> Column:
    """Non-blank parts, stripped and joined."""
    kept = F.filter(F.transform(F.array(*parts), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_join(kept, separator)


def field(label: str, value: Column) -> Column:
    """``label: value.``, or nothing for an empty value."""
    value = normalize_text(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(value == "", "").otherwise(F.concat(F.lit(f"{label}: "), value, F.lit(".")))


def say(template: str, *values: Column | str) -> Column:
    """A template with its {} filled in order; null as an empty text."""
    first, *rest = template.split("{}")
    if len(rest) != len(values):
        raise ValueError(f"{template!r} takes {len(rest)} values")
    parts = [F.lit(first)]
    for value, after in zip(values, rest):
        parts += [F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("")), F.lit(after)]
    return F.concat(*parts)


def maybe(text: Column, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), text).otherwise("")


def spaced_course_id(c: Column) -> Column:
    c = strip(c)
    spaced = F.concat_ws(" ", F.upper(F.regexp_extract(c, r"^([A-Za-z]+)\s*([0-9].*)$", 1)), F.regexp_extract(c, r"^([A-Za-z]+)\s*([0-9].*)$", 2))
    return F.when(c.rlike(r"^[A-Za-z]+\s*[0-9].*$"), spaced).otherwise(c)


def course_aliases(c: Column) -> Column:
    spaced = spaced_course_id(c)
    compact = F.replace(spaced, F.lit(" "), F.lit(""))
    return F.array_distinct(F.array(spaced, compact, F.lower(spaced), F.lower(compact)))


def subject_of(c: Column) -> Column:
    """The text before the first space."""
    return F.split(c, " ", 2)[0]


def number_of(c: Column) -> Column:
    """The text after the first space; empty without one."""
    return F.coalesce(F.try_element_at(F.split(c, " ", 2), F.lit(2)), F.lit(""))


def course_id(subject: Column, number: Column) -> Column:
    return lines(subject, number, separator=" ")


def term_name(code: Column) -> Column:
    year, suffix = F.substring(code, 1, 4), F.substring(code, 5, 2)
    name = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in SEASONS.items() for x in (k, v[i])]), suffix), F.lit("Unknown"))
    said = F.concat(name(0), F.lit(" "), year, F.lit("-"), (F.try_to_number(year, F.lit("9999")).cast("int") + 1).cast("string"), F.lit(" ("), name(1), F.lit(")"))
    return F.when(code.rlike(r"^\d{6}$"), said).otherwise("")


def requirement_type(category: Column) -> Column:
    low = F.lower(F.coalesce(category, F.lit("")))
    found = F.lit(None).cast("string")
    for kind, needles in reversed(REQUIREMENT_NEEDLES.items()):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        found = F.when(hit, kind).otherwise(found)
    return F.coalesce(found, F.nullif(low, F.lit("")), F.lit("unknown"))


def readable_days(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    letters = F.filter(F.split(c, ""), lambda x: x.rlike("[A-Za-z]"))
    return or_else(F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(names, F.upper(x)), x)), "/"), c)


def clean_code(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def display_code(c: Column) -> Column:
    c = clean_code(c)
    return F.when(c.rlike(r"^[A-Z]+\d.+$"), F.regexp_replace(c, r"^([A-Z]+)(\d.+)$", "$1 $2")).otherwise(c)


def su_credit(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def format_credit(c: Column) -> Column:
    """Integral values without a fraction, others with one digit: the nearest to the exact binary value, half to even. Ten times the value is taken as a product and its rounding error."""
    x = c.cast("double")
    product = x * 10.0
    split = x * 134217729.0  # 2^27 + 1 parts a double in two halves, whose products are exact
    high = split - (split - x)
    error = (high * 10.0 - product) + (x - high) * 10.0
    low = F.floor(product).cast("double")
    over = (product - low - 0.5) + error
    tenths = F.when(over > 0, low + 1).when(over < 0, low).otherwise(low + F.abs(low % 2)).cast("long")
    shown = F.concat(F.when(tenths < 0, "-").when((tenths == 0) & (x < 0), "-").otherwise(""), F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"))
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(shown)


def safe_filename(c: Column) -> Column:
    base = F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/]*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return or_else(kept, F.lit("upload.txt"))


def redact(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), PII, "[redacted]"))


def document_type(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("review", "whatsapp", "instructor_review"), "review").when(low.isin("exam", "exams", "exam_pdf"), "exam").otherwise("course")


def location_key(page: Column, slide: Column, section: Column) -> Column:
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("sec-"), F.substring(section, 1, 20)))
    return F.coalesce(F.concat(F.lit("p"), page.cast("string")), F.concat(F.lit("s"), slide.cast("string")), named, F.lit(""))


def source_label(source: Column, page: Column, slide: Column, section: Column) -> Column:
    said = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label} "), c.cast("string")))
    quoted = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("section '"), section, F.lit("'")))
    return lines(source, said("page", page), said("slide", slide), quoted, separator=", ")


def with_header(text: Column, source: Column, page: Column) -> Column:
    page = F.when(page.isNotNull(), F.concat(F.lit(", page "), page.cast("string"))).otherwise("")
    return F.concat(F.lit("[Source: "), source, page, F.lit("]\n"), text)


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def source_id(kind: Column, digest: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(digest, 1, 24))


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", source, index.cast("string"), F.substring(content_hash(text), 1, 16))


def card_id(kind: Column, path: Column, line_no: Column, source: Column, text: Column) -> Column:
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (kind, path, line_no, source, F.substring(text, 1, 160))]
    return F.concat(F.lit("catalog::"), F.sha1(F.concat_ws("\x1f", *parts).cast("binary")))


def slices(items: Column, size: int) -> Column:
    """Fixed-size slices of an array; none of an empty one."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(size)))


def embedding_cache_key(provider: Column, model: Column, text: Column) -> Column:
    safe = lambda c: F.replace(strip(or_else(c, F.lit("unknown"))), F.lit(":"), F.lit("_"))
    return F.concat_ws("_", safe(provider), safe(model), content_hash(text))
