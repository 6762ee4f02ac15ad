"""Character references of HTML as text, in one pass over a string column, by expressions alone."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what counts as a reference: a decimal or hexadecimal number, or up to 32 characters that may begin with a name
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: names that count without a semicolon too, and so as the beginning of a longer word
OPEN_NAMES = {n: c for n, c in html5.items() if not n.endswith(";")}
SHORTEST, LONGEST = min(map(len, OPEN_NAMES)), max(map(len, OPEN_NAMES))
#: numbers that stand for another character: those of the Windows code page, zero, and the carriage return as itself
OTHERS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
REPLACEMENT = "\ufffd"


def _table(entries: dict) -> Column:
    """A constant map (of strings), folded once a plan."""
    words = lambda x: F.split(F.lit("\1".join(x)), "\1")
    return F.map_from_arrays(words(map(str, entries)), words(entries.values()))


def character(code: Column) -> Column:
    """The character of a code point (a number below 0x110000, no surrogate)."""
    unit = lambda n: F.lpad(F.hex(n), 4, "0")
    over = code - 0x10000
    pair = F.concat(unit(F.lit(0xD800) + F.floor(over / 1024)), unit(F.lit(0xDC00) + F.pmod(over, F.lit(1024))))
    return F.decode(F.unhex(F.when(code < 0x10000, unit(code)).otherwise(pair)), "UTF-16BE")


def _numbered(digits: Column, base: int) -> Column:
    """What a number refers to: a character, the replacement character for none, or nothing for control and other non-characters."""
    plain = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(plain) > 7, F.lit(0x110000)).otherwise(F.coalesce(F.conv(F.nullif(plain, F.lit("")), base, 10).cast("int"), F.lit(0)))

    def of(n: Column) -> Column:
        low = F.pmod(n, F.lit(0x10000))
        nothing = ((n < 0x20) & ~n.isin(9, 10, 12)) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
        return (
            F.when(n.isin(*OTHERS), F.try_element_at(_table(OTHERS), n.cast("string")))
            .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), REPLACEMENT)
            .when(nothing, "")
            .otherwise(character(n))
        )

    return F.element_at(F.transform(F.array(code), of), 1)  # an array of one, so that the number is made once


def _named(said: Column) -> Column:
    """What a name refers to; else the longest name that it begins with, and the rest; else the text as it stands."""
    whole = F.try_element_at(_table(html5), said)
    begun = [
        F.when(F.length(said) > n, F.concat(F.try_element_at(_table(OPEN_NAMES), F.left(said, F.lit(n))), F.substring(said, n + 1, 40))) for n in range(LONGEST, SHORTEST - 1, -1)
    ]
    return F.coalesce(whole, *begun, F.concat(F.lit("&"), said))


def unescape(text: Column) -> Column:
    """``text`` with each character reference decoded once."""

    def decoded(ref: Column) -> Column:
        number = F.rtrim(ref, F.lit(";"))
        return (
            F.when(ref.rlike("^&#[xX]"), _numbered(F.substring(number, 4, 1_000_000), 16))
            .when(ref.startswith("&#"), _numbered(F.substring(number, 3, 1_000_000), 10))
            .otherwise(_named(F.substring(ref, 2, 40)))
        )

    parts, refs = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = F.array_join(F.flatten(F.zip_with(parts, F.transform(refs, decoded), lambda part, ref: F.array(part, F.coalesce(ref, F.lit(""))))), "")
    return F.when(text.contains("&"), joined).otherwise(text)
