"""Cleaning and normalising text, as Column expressions.

Patterns are written for Java: ``(?U)`` makes \\w, \\b and \\s mean what they mean in Unicode. Null and
empty texts give the empty text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fixed

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, use) -> Column:
    """``use(c)`` where ``c`` is evaluated once: as the variable of a lambda.

    An expression that a lambda refers to from outside would be evaluated for every element.
    """
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


@F.pandas_udf(T.StringType())
def _nfc(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Unicode NFC, the one step without a built-in: an Arrow UDF."""
    return _nfc(c)


def character_references(c: Column) -> Column:
    """``&#n;`` as the character n: the text is cut at the references and put together again.

    Numbers beyond Unicode, surrogates and zero become U+FFFD.
    """
    parts = F.split(c, r"&#(?=\d+;)")
    n = lambda p: F.regexp_extract(p, r"^(\d+);", 1)
    code = lambda p: F.substring(n(p), 1, 9).cast("long")
    valid = lambda k: k.between(1, 0x10FFFF) & ~k.between(0xD800, 0xDFFF)
    char = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.when(valid(code(p)), code(p)).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    decoded = F.transform(parts, lambda p, i: F.when((i == 0) | (n(p) == ""), p).otherwise(F.concat(char(p), F.regexp_replace(p, r"^\d+;", ""))))
    return F.when(c.rlike(r"&#\d+;"), F.array_join(decoded, "")).otherwise(c)


def remove_html(c: Column, numeric: bool = True) -> Column:
    """Tags become spaces; four named references are decoded one after the other (``&amp;lt;`` ends as
    ``<``), numeric ones if ``numeric``; other named references become spaces."""
    c = replaced(c, (r"<[^>]+>", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
    if numeric:
        c = character_references(c)
    return F.regexp_replace(c, r"&[a-zA-Z]+;", " ")


def newlines(c: Column) -> Column:
    return replaced(c, (r"\r\n", "\n"), (r"\r", "\n"), (r"\n{3,}", "\n\n"))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def punctuation(c: Column) -> Column:
    """One space behind signs, none before, unless a digit is next to them (``08:30`` stays)."""
    return replaced(c, (r"[{}\[\]]", ""), (r"(?U)(?<!\d)\s*([.,!?;])\s*(?!\d)", "$1 "), (r"(?U)(?<!\d)\s*:\s*(?!\d)", ": "))


def whitespace(c: Column) -> Column:
    return strip(replaced(c, (r"[ \t]+", " "), (r"\n ", "\n"), (r" \n", "\n")))


def clean(c: Column, unicode: bool = True, numeric: bool = True) -> Column:
    """Entity-table cleaning: HTML, NFC, newlines, controls, punctuation, white space, in this order."""
    c = remove_html(filled(c), numeric)
    c = nfc(c) if unicode else c
    return whitespace(punctuation(without_controls(newlines(c))))


def clean_statistics(raw: Column, cleaned: Column) -> Column:
    before, after = F.length(filled(raw)), F.length(cleaned)
    return F.struct(before.alias("original_length"), after.alias("cleaned_length"), (before - after).alias("chars_removed"), F.round((before - after) / F.greatest(before, F.lit(1)) * 100, 2).alias("reduction_pct"))


def clean_mail_text(c: Column) -> Column:
    """Mail-record cleaning: marks, newlines, controls, references, blank lines, lines of separators."""
    c = replaced(filled(c), ("[﻿​‌‍]", ""), (r"\r\n", "\n"), (r"\r", "\n"), (CONTROL, ""), (r"&[#a-zA-Z0-9]+;", " "), (r"\n{3,}", "\n\n"))
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(strip(x), r"[ \t]+", " "))
    return strip(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?U)^[\s\-_=*#]{3,}$")), "\n"))


def clean_subject(c: Column) -> Column:
    return strip(replaced(filled(c), (r"&[#a-zA-Z0-9]+;", " "), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), (r"(?U)\s+", " ")))


def clean_sender(c: Column) -> Column:
    """Struct of name and email: ``Name <address>``, or the first address and the rest, or a name."""
    c = filled(c)
    quotes = lambda x: F.regexp_replace(x, r'^"+|"+$', "")
    form = r"(?U)^(.+?)\s*<([^>]+)>\s*$"
    name, address = F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2)
    found = F.regexp_extract(c, r"(?U)[\w.+-]+@[\w-]+\.[\w.]+", 0)
    rest = quotes(F.regexp_replace(strip(F.replace(c, found, F.lit(""))), r"^[<>()]+|[<>()]+$", ""))
    return (
        F.when(c.rlike(form), F.struct(quotes(strip(name)).alias("name"), F.lower(strip(address)).alias("email")))
        .when(found != "", F.struct(rest.alias("name"), F.lower(found).alias("email")))
        .otherwise(F.struct(strip(c).alias("name"), F.lit("").alias("email")))
    )


def addresses(c: Column) -> Column:
    """The parts of a header that names several people, cut at commas outside quotes and brackets; an
    empty header has none."""
    parts = F.transform(F.regexp_extract_all(filled(c), F.lit(r'(?:"[^"]*"|<[^>]*>|[^,"<]|["<])+'), 0), strip)
    return F.filter(parts, lambda p: p != "")


def json_string(c: Column) -> Column:
    """A text as JSON writes it in ASCII: quotes, backslashes, controls and all but ASCII escaped."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = lambda ch: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), ch), F.when(ch.rlike(r"^[\x20-\x7e]$"), ch).otherwise(units(ch)))
    plain = F.when(c.rlike(r'^[\x20-\x21\x23-\x5b\x5d-\x7e]*$'), c).otherwise(F.array_join(F.transform(F.split(c, ""), escaped), ""))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def canonical_json(fields: dict[str, Column], numbers: tuple[str, ...] = ()) -> Column:
    """An object as JSON with sorted keys, ``", "`` and ``": "`` between, in ASCII, nulls kept. Fields
    are texts (times in ISO 8601 before they come here), but for ``numbers``."""
    parts = [F.lit("{")]
    for i, name in enumerate(sorted(fields)):
        value = fields[name].cast("string") if name in numbers else json_string(fields[name].cast("string"))
        parts += [F.lit((", " if i else "") + f'"{name}": '), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


#: Steps after :func:`normalize`, in the order of their registration: functions of a text column.
NORMALIZERS: list = []


def register_normalizer(step):
    """Adds a step (Column -> Column) to :func:`normalized`."""
    NORMALIZERS.append(step)
    return step


def normalized(c: Column) -> Column:
    """:func:`normalize` and numbers, then every registered step."""
    c = normalize_numbers(normalize(c))
    for step in NORMALIZERS:
        c = step(c)
    return c


def clean_date(c: Column) -> Column:
    """A mail date as ISO 8601 with its offset; what isn't one stays, empty becomes null."""
    t = F.regexp_replace(strip(c), r"^[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\([^)]*\)$", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    offset = F.regexp_extract(t, r"([+-])(\d{2})(\d{2})$", 0)
    local = F.try_to_timestamp(F.concat(F.regexp_replace(t, r"\s*[+-]\d{4}$", ""), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(offset != "", F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2))).otherwise(""))
    return F.when(c.isNull() | (c == ""), None).otherwise(F.coalesce(iso, c))


def extension(c: Column) -> Column:
    """The extension of a file name with its dot, lower case; none: empty. Leading dots begin a name."""
    base = F.regexp_extract(filled(c), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def clean_filename(c: Column) -> Column:
    c = strip(F.regexp_replace(filled(c), r"[\x00-\x1f]", ""))
    ext = extension(c)
    return F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(ext)), ext)


def normalize_filename(c: Column) -> Column:
    c = filled(c)
    ext = F.substring(c, F.length(c) - F.length(extension(c)) + 1, F.length(extension(c)))
    stem = F.substring(c, F.lit(1), F.length(c) - F.length(ext))
    return F.concat(F.substring(replaced(stem, (r"(?U)\s+", "_"), (r"(?U)[^\w\-]", "")), 1, 100), ext)


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(filled(c), r"(?U)[^\w\-\.]", "_")


def normalize(c: Column, lowercase: bool = False, unicode: bool = True) -> Column:
    """Mail-record normalising. Unlike ``punctuation`` it puts a space into ``08:30``."""
    c = nfc(filled(c)) if unicode else filled(c)
    c = F.translate(c, "０１２３４５６７８９", "0123456789")
    c = F.lower(c) if lowercase else c
    c = F.translate(c, "–—‘’“”•‣◦⁃", "--''\"\"****")
    return strip(replaced(c, (r"(?U)\s+([.,;:!?])", "$1"), (r"([.,;:!?])([A-Za-z0-9À-ɏ])", "$1 $2"), (r"[ \t]+", " ")))


def normalize_numbers(c: Column) -> Column:
    return replaced(filled(c), (r"(\d{1,2})[/.](\d{1,2})[/.](\d{2,4})", "$1-$2-$3"), (r"(?<=\d),(?=\d{3})", ""))


def cleaning_operations(raw: Column, cleaned: Column) -> Column:
    """What cleaning did, as an array of names."""
    changed = raw != cleaned
    return F.array_compact(F.array(
        F.when(changed & (F.length(raw) != F.length(cleaned)), F.lit("removed_control_chars")),
        F.when(changed & raw.contains("\r\n"), F.lit("normalized_line_endings")),
        F.when(changed & raw.rlike(r"&[#a-zA-Z0-9]+;"), F.lit("removed_html_entities")),
    ))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """The value of a small fixed map, or a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def file_category(c: Column) -> Column:
    return lookup(extension(c), fixed.FILE_CATEGORIES, "unknown")


def media_type(c: Column) -> Column:
    return lookup(extension(c), fixed.MEDIA_TYPES, "application/octet-stream")


def parse_time(c: Column) -> Column:
    """The first of five formats that fits, as a timestamp; none: null."""
    t = F.replace(c, F.lit("Z"), F.lit("+0000"))
    mail = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
    formats = ["yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd'T'HH:mm:ssxxx", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx", "yyyy-MM-dd'T'HH:mm:ss.SSSxx", "yyyy-MM-dd'T'HH:mm:ss.SSSxxx", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats], F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss xx")))
