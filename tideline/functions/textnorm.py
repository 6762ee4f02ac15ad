"""Normal forms of names and titles, and ids made from them, as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, of which one is dropped from the end of a company's name.
LEGAL_FORMS = r"inc|llc|ltd|limited|corp|corporation|co|gmbh|s\.?p\.?a|s\.?r\.?l|b\.?v|a\.?g|plc|sa|nv"


#: most texts hold nothing of this kind and skip the long tables
BEYOND_ASCII = r"[^\x00-\x7F]"


#: syllables of Hangul, which are made of two or three letters by arithmetic, and the first letter of each kind
HANGUL_FIRST, HANGUL_LAST, LEADS, VOWELS, TAILS = 0xAC00, 0xD7A3, 0x1100, 0x1161, 0x11A7


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without marks leaves of characters other than Hangul: for ``translate`` where that is
    one character or none, and as a dict where it is several."""
    pairs, gone, several = [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        if HANGUL_FIRST <= code <= HANGUL_LAST:
            continue
        c = chr(code)
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(left) > 1:
            several[c] = left
        elif left != c:
            (pairs if left else gone).append((c, left))
    return "".join(c for c, _ in pairs) + "".join(c for c, _ in gone), "".join(x for _, x in pairs), several


def _char_class(chars, coarse: int = 12) -> str:
    """A regular expression for one of the characters: ``coarse`` ranges that hold them all are tried before the exact ones."""
    ranges = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    widest = sorted(range(1, len(ranges)), key=lambda i: ranges[i - 1][1] - ranges[i][0])[: coarse - 1]
    cuts = [0, *sorted(widest), len(ranges)]
    outer = [(ranges[i][0], ranges[j - 1][1]) for i, j in zip(cuts, cuts[1:])]
    one = lambda some: "[" + "".join(rf"\x{{{x:X}}}-\x{{{y:X}}}" for x, y in some) + "]"
    return f"(?={one(outer)}){one(ranges)}"


def _jamo(syllable: Column) -> Column:
    """A syllable of Hangul as its letters."""
    leads, vowels, tails = ("".join(chr(first + i) for i in range(n)) for first, n in ((LEADS, 19), (VOWELS, 21), (TAILS + 1, 27)))

    def of(n: Column) -> Column:
        letter = lambda letters, i: F.substr(F.lit(letters), (i + 1).cast("int"), F.lit(1))
        tail = F.when(F.pmod(n, F.lit(28)) == 0, "").otherwise(letter(tails, F.pmod(n, F.lit(28)) - 1))
        return F.concat(letter(leads, F.floor(n / 588)), letter(vowels, F.floor(F.pmod(n, F.lit(588)) / 28)), tail)

    return F.element_at(F.transform(F.array(F.ascii(syllable) - HANGUL_FIRST), of), 1)


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks: compatibility decomposition, from which combining characters are left out."""
    frm, to, several = _plain_letters()
    hangul = rf"[\x{{{HANGUL_FIRST:X}}}-\x{{{HANGUL_LAST:X}}}]"
    grown = _char_class([*several, *map(chr, range(HANGUL_FIRST, HANGUL_LAST + 1))])
    words = lambda x: F.split(F.lit("\1".join(x)), "\1")
    table = F.map_from_arrays(words(several), words(several.values()))

    def expanded(text: Column) -> Column:
        """Characters that become several are cut out and replaced one by one."""
        made = F.transform(F.regexp_extract_all(text, F.lit(grown), F.lit(0)), lambda x: F.when(x.rlike(hangul), _jamo(x)).otherwise(F.try_element_at(table, x)))
        return F.array_join(F.flatten(F.zip_with(F.split(text, grown, -1), made, lambda part, more: F.array(part, F.coalesce(more, F.lit(""))))), "")

    def of(text: Column) -> Column:
        plain = F.translate(text, frm, to)
        return F.when(text.rlike(BEYOND_ASCII), F.when(text.rlike(grown), expanded(plain)).otherwise(plain)).otherwise(text)

    # An array of one names the text once: callers nest this, and a plan that repeats its input grows with a power of the depth.
    return F.element_at(F.transform(F.array(c), of), 1)


def normalize_text(c: Column) -> Column:
    """Lower case, without marks, white space squeezed; null gives an empty string."""
    squeezed = F.regexp_replace(F.lower(strip_diacritics(c.cast("string"))), r"(?U)\s+", " ")
    return F.coalesce(F.trim(squeezed), F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "")


def normalize_company(name: Column) -> Column:
    return slug(F.regexp_replace(normalize_text(name), rf"[,\s]+({LEGAL_FORMS})\.?$", ""))


def normalize_title(title: Column) -> Column:
    return slug(F.regexp_replace(F.coalesce(title, F.lit("")), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", " "))


def matching_key(name: Column) -> Column:
    """A company's key for list matching: a leading article goes if something is left."""
    n = normalize_company(name)
    return F.when(n.startswith("the") & (F.length(n) > 5), F.substring(n, 4, 1 << 20)).otherwise(n)


def content_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, n)


def posting_id(company: Column, title: Column, day: Column) -> Column:
    """Id of a posting: its company, title and day (MMDDYYYY, or empty), without its address."""
    return content_id(normalize_company(company), normalize_title(title), F.coalesce(day, F.lit("")))


def content_key(version: Column, company: Column, text: Column, n: int = 16) -> Column:
    """Key under which a document's result is kept: version, company and text without regard to white space."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    parts = (version, F.lower(F.trim(F.coalesce(company, F.lit("")))), squeezed)
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, n)


def url_key(url: Column, rules) -> Column:
    """The first rule (pattern, template) whose pattern is found gives the key; groups are lower-cased."""
    tries = []
    for pattern, template in rules:
        pieces: list[Column] = []
        for literal, group in re.findall(r"([^{]*)(?:\{(\d+)\})?", template):
            if literal:
                pieces.append(F.lit(literal))
            if group:
                pieces.append(F.lower(F.regexp_extract(url, pattern, int(group) + 1)))
        tries.append(F.when(url.rlike(pattern), F.concat(*pieces)))
    return F.coalesce(*tries)


#: Where applicant-tracking systems carry a job's own number in its address.
JOB_URL_RULES = (
    (r"[?&]gh_jid=(\d+)", "gh:{0}"),
    (r"greenhouse\.io/[^/?#]+/jobs/(\d+)", "gh:{0}"),
    (r"(?i)jobs\.ashbyhq\.com/[^/?#]+/([0-9a-f-]{36})", "ashby:{0}"),
    (r"(?i)jobs\.lever\.co/[^/?#]+/([0-9a-f-]{36})", "lever:{0}"),
    (r"smartrecruiters\.com/v1/companies/[^/?#]+/postings/(\d+)", "sr:{0}"),
    (r"jobs\.smartrecruiters\.com/[^/?#]+/(\d+)", "sr:{0}"),
    (r"//([^./]+)\.recruitee\.com/o/([^/?#]+)", "recruitee:{0}/{1}"),
    (r"\.jobs\.personio\.(?:de|com)/job/(\d+)", "personio:{0}"),
)
