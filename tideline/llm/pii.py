"""PII surrogates: detected entities get keyed replacements of the same kind and form.

One alternation of patterns finds entities, left to right.  Names are found after a title;
the bare name and the bare family name are then entities of the same text too.  Each
entity has a canonical form, so that spellings of one entity (case of an address or a
hexadecimal secret, grouping of a number, a number with or without its country) get one
surrogate:

* digits of phone numbers, cards and the like are drawn anew; grouping and the country
  that the number itself begins with stay; card numbers keep a valid check digit valid;
* account numbers keep country, length and grouping and get valid check digits;
* letters of secrets are drawn anew within their case and alphabet;
* local parts of e-mail addresses become syllables with as many digits, the domain stays
  within ``example`` names of the same depth; addresses of hosts stay of their version;
* names keep title, gender, script and capital form.  A family name has one surrogate, in
  whatever combination it stands; given names come from lists by gender and script.  The
  gender is the title's, that of a known given name, or neutral.

A surrogate is a function of key, kind and canonical form alone (by HMAC-SHA-512), so it
is made beside the text without a join.  The exceptions are collisions: where two entities
would get one surrogate, or an entity the canonical form of another one, all but the least
take the next attempt, until none is left (an error if their form has too few values for
them); later attempts draw from a wider space where the form allows one (more syllables,
double given names, any first number for IP addresses).  A given name may be one that
occurs elsewhere, since it tells nobody apart.  The exceptions are found by aggregation
over distinct entities, are few, and reach the texts as a broadcast if counted to be few
and by a join on the text's hash otherwise.

Only DataFrame expressions run on this path.

Edge cases: a null text stays null; a text without entities stays as it is; repeated rows
are treated alike; an empty table gives an empty result; all columns pass through,
whatever their names; entities at the ends of a text or side by side are found each; a
text of any length is searched whole, in time proportional to its length (and to the titled
names in it); of a domain of more than 127 labels the first 127 are replaced; a name without
a title anywhere in its text is not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, shuffle_partitions

#: rounds without fewer collisions after which a form counts as too narrow for its entities
STALLED = 50
BROADCAST_EXCEPTIONS = 20_000

# Titles and given names by gender and script, syllables of family names, countries.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"), "n": ("Dr", "Prof")}
GIVEN = {
    "latin": {
        "m": ("James", "Robert", "Michael", "David", "Thomas", "Daniel", "Matthew", "Anthony", "Stephen", "Patrick", "Lukas", "Mateo"),
        "f": ("Mary", "Patricia", "Jennifer", "Linda", "Susan", "Jessica", "Margaret", "Emily", "Laura", "Helen", "Claire", "Sofia"),
        "n": ("Alex", "Robin", "Kim", "Sam", "Jordan", "Taylor", "Jamie", "Morgan"),
    },
    "cyrillic": {
        "m": ("Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Павел"),
        "f": ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна"),
        "n": ("Саша", "Женя", "Валя", "Слава"),
    },
}
#: given names whose gender is known beside those above
KNOWN = {
    "m": ("John", "Peter", "Paul", "William", "Richard", "Charles", "Joseph", "George", "Mark", "Andrew", "Hans", "Klaus", "Jürgen", "Stefan", "Martin", "Pierre",
          "Jean", "Louis", "Antoine", "François", "Carlos", "José", "Juan", "Luis", "Miguel", "Marco", "Giovanni", "Lars", "Erik", "Olaf"),
    "f": ("Ingrid", "Anna", "Maria", "Julia", "Sophie", "Emma", "Hannah", "Marie", "Camille", "Elena", "Lucia", "Carmen", "Petra", "Ursula", "Heidi", "Astrid",
          "Karin", "Nina", "Eva", "Olivia", "Charlotte", "Alice", "Rachel", "Sarah", "Elizabeth", "Barbara", "Ruth", "Isabel", "Pilar", "Chloé"),
}
SYLLABLES = {
    "latin": ("bar", "den", "fol", "gan", "hol", "ker", "lam", "mor", "nel", "per", "ral", "sten", "tor", "vel", "wick", "yard"),
    "cyrillic": ("бар", "вол", "гор", "дан", "зим", "кар", "лад", "мир", "нов", "пав", "род", "сав", "тим", "фад", "хар", "ян"),
}
#: length of an account number (IBAN) -> its countries
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "PT", 26: "IS|TR", 27: "FR|GR|IT|MC|SM", 28: "AL|AZ|CY|DO|GT|HU|LB|PL",
    29: "BR|QA|UA", 30: "JO|KW|MU", 31: "MT",
}
#: country codes of phone numbers of one and two digits; the others have three
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _iban() -> str:
    """Account numbers of known countries by their length, others as groups of four and a rest (with a digit if it stands apart)."""
    known = "|".join(
        rf"(?:{names})\d{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (f"(?: ?[0-9A-Z]{{{n % 4}}})" if n % 4 else "") for n, names in IBAN_LENGTHS.items()
    )
    other = r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?:[0-9A-Z]{1,3}| (?=[A-Z]*[0-9])[0-9A-Z]{1,3})?"
    return rf"(?<![0-9A-Za-z])(?:{known}|{other})(?![0-9A-Za-z])"


_NAME, _INITIALS = r"\p{Lu}[\p{L}'’-]+", r"(?:\p{Lu}\. )*+"
_ALL_TITLES = "|".join(t for group in TITLES.values() for t in group)
_TITLE = rf"(?:{_ALL_TITLES})\.? "
_HEXTET = "[0-9A-Fa-f]{1,4}"
#: kind -> pattern (Java), in order of precedence
PATTERNS = {
    # From the start of a run on, so that a long run is read once; up to 126 labels before the last.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[a-f]*[0-9])[0-9a-f]{32,64}|(?=[A-F]*[0-9])[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])",
    "iban": _iban(),
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEXTET}:){{7}}{_HEXTET}|(?:{_HEXTET}:){{2,6}}(?::{_HEXTET}){{1,5}}|(?:{_HEXTET}:){{2,7}}:|(?:{_HEXTET}:):{_HEXTET}(?::{_HEXTET}){{1,5}})(?![\w:]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "name": rf"(?<!\p{{L}}){_TITLE}{_INITIALS}{_NAME}(?: {_INITIALS}{_NAME})?",
}
#: all of them; an address may also begin where the entity before it ends
PATTERN = "|".join([rf"(?:\G{PATTERNS['email'].partition(')')[2]})", *(f"(?:{p})" for p in PATTERNS.values())])
#: what every entity contains; most texts lack it and are not searched further
TRIGGER = rf"[@0-9]|AKIA|gh[pousr]_|sk-|{_ALL_TITLES}"


def entities_in(text: Column) -> Column:
    """The entities that patterns find alone; bare names are not among them."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(TRIGGER), found).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    """Which pattern an entity belongs to; what fits none is a bare name."""
    found = F
    for kind, p in PATTERNS.items():
        found = found.when(entity.rlike(f"^(?:{p})$"), F.lit(kind))
    return found.otherwise("name")


# --- names ---------------------------------------------------------------------


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, f"^{_TITLE}", "")


def _family_of(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def _given_of(name: Column) -> Column:
    """The given name of a name, or null; initials are none."""
    before = F.filter(F.split(_bare(name), " "), lambda t: ~t.rlike(r"^\p{Lu}\.$"))
    return F.when(F.size(before) > 1, F.get(before, F.lit(0)))


def _gender(name: Column) -> Column:
    """m, f or n (neutral): the title's, else that of a known given name; Cyrillic names tell by their ending."""
    title = F.regexp_extract(name, rf"^({_ALL_TITLES})\.? ", 1)
    given = F.lower(F.coalesce(_given_of(name), F.lit("")))
    known = {g: [n.lower() for n in (*GIVEN["latin"][g], *GIVEN["cyrillic"][g], *KNOWN[g])] for g in ("m", "f")}
    by_name = F.when(given.isin(*known["m"]), "m").when(given.isin(*known["f"]), "f").otherwise(
        F.when(given.rlike(r"^\p{IsCyrillic}{3,}$"), F.when(given.rlike("[ая]$"), "f").otherwise("m")).otherwise("n")
    )
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise(by_name)


def _plain_family(family: Column) -> Column:
    """Lower case; Cyrillic names in their masculine form."""
    low = F.lower(family)
    return F.regexp_replace(F.regexp_replace(low, "(?<=ов|ев|ин|ын)а$", ""), "ская$", "ский")


def titled_names(found: Column) -> Column:
    """Of the entities of a text the names: struct of bare form and gender."""
    names = F.filter(found, lambda e: e.rlike(f"^{_TITLE}"))
    return F.transform(names, lambda e: F.struct(_bare(e).alias("bare"), _gender(e).alias("gender")))


def _pattern_with(titled: Column) -> Column:
    """The pattern that also finds the bare names of a text."""
    forms = F.array_distinct(F.concat(F.transform(titled, lambda x: x["bare"]), F.transform(titled, lambda x: _family_of(x["bare"]))))
    longest = F.array_sort(forms, lambda a, b: F.length(b) - F.length(a))
    quoted = F.transform(longest, lambda n: F.regexp_replace(n, r"([^\p{L} ])", r"\\$1"))
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}@.])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}@])"))


# --- canonical forms -----------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _full_ipv6(entity: Column) -> Column:
    """All eight groups of four digits, in lower case."""
    halves = F.split(F.lower(entity), "::")
    groups = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ":"), lambda x: x != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(x, 4, "0")), ":")


def canonical(kind: Column, entity: Column) -> Column:
    """What spellings of one entity have in common (of names: nothing, their parts have it)."""
    return (
        F.when(kind.isin("email", "ip"), F.lower(entity))
        .when(kind == "ipv6", _full_ipv6(entity))
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "").otherwise("1"), _digits(entity)))
        .when(kind.isin("ssn", "card"), _digits(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when((kind == "secret") & entity.rlike("^[0-9A-F]{32,64}$"), F.lower(entity))
        .otherwise(entity)
    )


def units_of(entity: Column, titled: Column) -> Column:
    """What of an entity has a surrogate of its own: struct of kind, plain (canonical form) and spelling.

    Names are a family name and, if there is one, a given name with its gender, which a bare
    name has from the titled name that it repeats.
    """
    unit = lambda k, p, s: F.struct(k.alias("kind"), p.alias("plain"), s.alias("spelling"))

    def units(x: Column) -> Column:
        e, kind = x["e"], x["kind"]
        bare = _bare(e)
        same = F.get(F.filter(titled, lambda t: (t["bare"] == bare) | t["bare"].endswith(F.concat(F.lit(" "), bare))), F.lit(0))
        gender = F.when(bare == e, F.coalesce(same["gender"], _gender(e))).otherwise(_gender(e))
        family, given = _plain_family(_family_of(bare)), F.concat_ws("|", gender, F.lower(_given_of(e)))
        of_name = F.concat(
            F.array(unit(F.lit("family"), family, family)),
            F.when(_given_of(e).isNotNull(), F.array(unit(F.lit("given"), given, given))).otherwise(F.array().cast("array<struct<kind:string,plain:string,spelling:string>>")),
        )
        return F.when(kind == "name", of_name).otherwise(F.array(unit(kind, canonical(kind, e), e)))

    # An array of one, so that the kind is found once.
    return F.element_at(F.transform(F.transform(F.array(entity), lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind"))), units), 1)


# --- surrogates ----------------------------------------------------------------


def _stream(kind: Column, plain: Column, attempt: Column, key: str) -> Column:
    """HMAC-SHA-512 of an entity, as hexadecimal."""
    if not key:
        raise ValueError("surrogates need a key")
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    pad = lambda b: F.lit(bytearray(x ^ b for x in raw))
    message = F.concat_ws("\x1f", kind, plain, attempt.cast("string")).cast("binary")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 512))), 512)


def _draw(stream: Column, i: Column | int, n: Column | int) -> Column:
    """The i-th number below n of a keyed stream."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.pmod(F.xxhash64(stream, as_column(i).cast("int")), as_column(n).cast("long")).cast("int")


def _pick(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), at + 1)


def _syllables(script: str, stream: Column, n: Column) -> Column:
    words = SYLLABLES[script]
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(words, _draw(stream, i, len(words)))), "")


def _refill(entity: Column, kind: str, fresh: Column) -> Column:
    """The characters of a class (``kind``, as in brackets) replaced by those of ``fresh`` in turn."""
    upto = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), f"[^{kind}]", ""))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(f"[{kind}]"), F.substr(fresh, upto(i), F.lit(1))).otherwise(c)), "")


def _redraw(entity: Column, stream: Column, keep: Column | int = 0) -> Column:
    """Each digit and ASCII letter drawn anew in its class (hexadecimal letters stay so), the rest and the first ``keep`` as they are."""
    hexadecimal = entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    letters = F.when(hexadecimal, F.lit("abcdef")).otherwise(F.lit("abcdefghijklmnopqrstuvwxyz"))

    def one(c: Column, i: Column) -> Column:
        letter = F.substr(letters, _draw(stream, i, F.length(letters)) + 1, F.lit(1))
        return (
            F.when(i < keep, c)
            .when(c.rlike("^[0-9]$"), _draw(stream, i, 10).cast("string"))
            .when(c.rlike("^[a-z]$"), letter)
            .when(c.rlike("^[A-Z]$"), F.upper(letter))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _phone(entity: Column, stream: Column) -> Column:
    plain = canonical(F.lit("phone"), entity)
    country = F.when(plain.rlike(CALLING), F.length(F.regexp_extract(plain, CALLING, 0))).otherwise(3)
    return _refill(entity, "0-9", F.right(_redraw(plain, stream, country), F.length(_digits(entity))))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string of even length without its last digit."""
    return F.aggregate(
        F.transform(
            F.split(F.substr(digits, F.lit(1), F.length(digits) - 1), ""),
            lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _card(entity: Column, stream: Column) -> Column:
    digits = _digits(entity)
    valid = F.pmod(_luhn_sum(digits) + F.substr(digits, F.lit(16)).cast("int"), F.lit(10)) == 0
    fresh = _redraw(digits, stream)
    check = F.pmod(10 - F.pmod(_luhn_sum(fresh), F.lit(10)), F.lit(10)).cast("string")
    return _refill(entity, "0-9", F.when(valid, F.concat(F.substr(fresh, F.lit(1), F.lit(15)), check)).otherwise(fresh))


def _iban_surrogate(entity: Column, stream: Column) -> Column:
    """The country, valid check digits, and the rest drawn anew."""
    plain = canonical(F.lit("iban"), entity)
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), _redraw(F.substr(plain, F.lit(5)), stream)
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    # The number that rest, country and 00 spell, modulo 97; a letter is two digits.
    remainder = F.aggregate(
        F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    )
    return _refill(entity, "0-9A-Z", F.concat(country, F.lpad((98 - remainder).cast("string"), 2, "0"), rest))


def _email(entity: Column, stream: Column, attempt: Column) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    word = _syllables("latin", stream, 4 + attempt)
    word = F.when(local == F.upper(local), F.upper(word)).when(local.rlike("^[A-Z]"), F.initcap(word)).otherwise(word)
    wanted = F.length(_digits(local))
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(wanted, F.lit(1))), lambda i: _draw(stream, i + 1000, 10).cast("string")), "")
    fresh = F.concat(word, F.when(local.contains("."), F.lit(".")).otherwise(""), F.when(wanted > 0, digits).otherwise(""))
    # A dot needs something behind it.
    fresh = F.when(fresh.endswith("."), F.concat(fresh, F.when(local == F.upper(local), F.upper(_syllables("latin", stream, F.lit(1)))).otherwise(_syllables("latin", stream, F.lit(1))))).otherwise(fresh)
    hosts = F.split(domain, r"\.")
    hosts = F.concat(
        F.transform(F.slice(hosts, F.lit(1), F.greatest(F.size(hosts) - 2, F.lit(0))), lambda _, i: _pick(SYLLABLES["latin"], _draw(stream, i + 2000, 16))),
        F.array(F.lit("example"), F.element_at(hosts, -1)),
    )
    return F.concat(fresh, F.lit("@"), F.array_join(hosts, "."))


def _ipv6(entity: Column, stream: Column) -> Column:
    groups = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.lower(F.hex(_draw(stream, i, 65536))))
    fresh = F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))
    return F.when(entity == F.lower(entity), fresh).otherwise(F.upper(fresh))


def _ip(stream: Column, attempt: Column) -> Column:
    net = F.when(attempt > 1, (_draw(stream, 9, 254) + 1).cast("string")).otherwise("10")
    return F.concat_ws(".", net, *((_draw(stream, i, 254) + 1).cast("string") for i in range(3)))


def _cyrillic(c: Column) -> Column:
    return c.rlike(r"\p{IsCyrillic}")


def _family(plain: Column, stream: Column, attempt: Column) -> Column:
    """A family name in lower case, by the script of the old one."""
    n = 4 + attempt
    return F.when(_cyrillic(plain), F.concat(_syllables("cyrillic", stream, n), F.lit("ов"))).otherwise(_syllables("latin", stream, n))


def _given(plain: Column, stream: Column, attempt: Column) -> Column:
    """A given name, double ones from the second attempt on, by gender and script of the old one (``plain``: gender, bar, name)."""
    gender = F.substr(plain, F.lit(1), F.lit(1))

    def of(script: str) -> Column:
        lists = GIVEN[script]
        one = lambda i: F.when(gender == "m", _pick(lists["m"], _draw(stream, i, len(lists["m"])))).when(
            gender == "f", _pick(lists["f"], _draw(stream, i, len(lists["f"])))
        ).otherwise(_pick(lists["n"], _draw(stream, i, len(lists["n"]))))
        return F.array_join(F.transform(F.sequence(F.lit(0), attempt), one), "-")

    return F.when(_cyrillic(plain), of("cyrillic")).otherwise(of("latin"))


def surrogate(kind: Column, spelling: Column, stream: Column, attempt: Column) -> Column:
    """The replacement of a unit in its own spelling, by the keyed stream of its canonical form."""
    head = "^(AKIA|gh[pousr]_|sk-)"
    secret = F.concat(F.regexp_extract(spelling, f"{head}?", 0), _redraw(F.regexp_replace(spelling, head, ""), stream))
    return (
        F.when(kind == "email", _email(spelling, stream, attempt))
        .when(kind == "ip", _ip(stream, attempt))
        .when(kind == "ipv6", _ipv6(spelling, stream))
        .when(kind == "phone", _phone(spelling, stream))
        .when(kind == "ssn", _refill(spelling, "0-9", _redraw(_digits(spelling), stream)))
        .when(kind == "card", _card(spelling, stream))
        .when(kind == "iban", _iban_surrogate(spelling, stream))
        .when(kind == "family", _family(spelling, stream, attempt))
        .when(kind == "given", F.concat(F.substr(spelling, F.lit(1), F.lit(2)), F.lower(_given(spelling, stream, attempt))))
        .otherwise(secret)
    )


def _whole_name(name: Column, family: Column, given: Column, stream: Column) -> Column:
    """Title, initials, given and family name anew, each part in the capital form of the old one."""
    title, parts = F.regexp_extract(name, f"^(?:{_TITLE})?", 0), F.split(_bare(name), " ")
    shouted = lambda old, new: F.when(old.rlike(r"^\p{Lu}{2,}$"), F.upper(new)).otherwise(new)
    feminine = F.when(F.lower(name).rlike("(?:ова|ева|ина|ына|ская)$"), "а").otherwise("")

    def part(p: Column, i: Column) -> Column:
        initial = F.when(_cyrillic(p), F.substr(F.lit("АБВГДЕИКЛМНПРС"), _draw(stream, i + 3000, 14) + 1, F.lit(1))).otherwise(
            F.substr(F.lit("ABCDEFGHIJKLMNPRST"), _draw(stream, i + 3000, 18) + 1, F.lit(1))
        )
        return (
            F.when(i == F.size(parts) - 1, shouted(p, F.concat(F.initcap(family), feminine)))
            .when(p.rlike(r"^\p{Lu}\.$"), F.concat(initial, F.lit(".")))
            .otherwise(shouted(p, given))
        )

    return F.concat(title, F.array_join(F.transform(parts, part), " "))


# --- collisions ----------------------------------------------------------------


def _found(texts: DataFrame) -> DataFrame:
    """``texts`` with titled (its titled names) and found (all entities, bare names included) of ``__text``."""
    text = F.col("__text")
    first = texts.withColumn("__first", entities_in(text)).withColumn("__titled", titled_names(F.col("__first")))
    bare = F.regexp_extract_all(text, _pattern_with(F.col("__titled")), F.lit(0))
    return first.withColumn("__found", F.when(F.size("__titled") > 0, bare).otherwise(F.col("__first"))).drop("__first")


def _units(texts: DataFrame) -> DataFrame:
    """Distinct (kind, plain) of all entities with one spelling each."""
    found = (
        _found(texts.select(F.col("text").alias("__text")))
        .select(F.explode(F.array_distinct("__found")).alias("e"), F.when(F.size("__titled") > 0, F.col("__titled")).alias("titled"))
        .groupBy("e", "titled")
        .agg(F.lit(1).alias("one"))
    )
    none = F.array().cast("array<struct<bare:string,gender:string>>")
    units = found.select(F.explode(units_of(F.col("e"), F.coalesce("titled", none))).alias("u")).select("u.*")
    return units.groupBy("kind", "plain").agg(F.min("spelling").alias("spelling"))


def _with_made(units: DataFrame, key: str) -> DataFrame:
    """Add ``made``, the canonical form of each unit's surrogate at its attempt."""
    kind, attempt = F.col("kind"), F.col("attempt")
    streamed = units.withColumn("stream", _stream(kind, F.col("plain"), attempt, key))
    spelled = streamed.withColumn("made", surrogate(kind, F.col("spelling"), F.col("stream"), attempt))
    return spelled.select("kind", "plain", "spelling", "attempt", canonical(kind, F.col("made")).alias("made"))


def exceptions(texts: DataFrame, key: str) -> DataFrame:
    """(kind, plain, attempt) of the units whose first surrogate collides."""
    # The number of tasks is given: units are few bytes, and their surrogates some work.
    units = checkpoint(_units(texts)).repartition(shuffle_partitions(texts.sparkSession))
    state = checkpoint(_with_made(units.withColumn("attempt", F.lit(0)), key))
    real = state.where("kind <> 'given'").select("kind", F.col("plain").alias("made"))
    least, stalled = None, 0
    while True:
        # All but one of the units that share a surrogate, and those that would become another real entity.
        twice = state.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("plain").alias("first")).where("n > 1")
        clash = state.join(twice, ["kind", "made"]).where("plain <> first").select("kind", "plain")
        taken = state.join(real, ["kind", "made"], "left_semi").select("kind", "plain")
        again = checkpoint(clash.union(taken).distinct().withColumn("more", F.lit(True)))
        left = again.count()
        if left == 0:
            break
        least, stalled = (left, 0) if least is None or left < least else (least, stalled + 1)
        if stalled >= STALLED:
            raise RuntimeError(f"{left} entities have no surrogate of their own: their form has too few values")
        marked = state.join(again, ["kind", "plain"], "left")
        raised = marked.where("more").select("kind", "plain", "spelling", (F.col("attempt") + 1).alias("attempt"))
        state = checkpoint(marked.where("more IS NULL").select("kind", "plain", "spelling", "attempt", "made").union(_with_made(raised, key)))
    return state.where("attempt > 0").select("kind", "plain", "attempt")


# --- texts ---------------------------------------------------------------------


def _replaced(text: Column, found: Column, titled: Column, attempts: Column | None, key: str) -> Column:
    """``text`` with its entities ``found`` replaced in place.

    Each step of the chain names what the next one uses, so that no expression is repeated.
    """

    def attempt(u: Column) -> Column:
        if attempts is None:
            return F.lit(0)
        return F.coalesce(F.try_element_at(attempts, F.concat_ws(":", u["kind"], u["plain"])), F.lit(0))

    def streamed(u: Column) -> Column:
        return F.struct(u["kind"].alias("kind"), u["spelling"].alias("spelling"), u["attempt"].alias("attempt"), _stream(u["kind"], u["plain"], u["attempt"], key).alias("stream"))

    tried = lambda u: F.struct(u["kind"].alias("kind"), u["plain"].alias("plain"), u["spelling"].alias("spelling"), attempt(u).alias("attempt"))
    units = F.transform(found, lambda e: F.struct(e.alias("e"), F.transform(F.transform(units_of(e, titled), tried), streamed).alias("u")))

    def fresh(x: Column) -> Column:
        one, two = F.get(x["u"], F.lit(0)), F.get(x["u"], F.lit(1))
        name = _whole_name(x["e"], _family(one["spelling"], one["stream"], one["attempt"]), _given(two["spelling"], two["stream"], two["attempt"]), one["stream"])
        return F.when(one["kind"] == "family", name).otherwise(surrogate(one["kind"], one["spelling"], one["stream"], one["attempt"]))

    # What stands between the entities and the replacements, in turn.
    between = F.when(F.size(titled) > 0, F.split(text, _pattern_with(titled), -1)).otherwise(F.split(text, PATTERN, -1))
    return F.array_join(F.flatten(F.zip_with(between, F.transform(units, fresh), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def replace_entities(docs: DataFrame, key: str, count_as: str = "__entities") -> DataFrame:
    """``docs`` with its ``text`` freed of entities, and how many were replaced in the column ``count_as``."""
    text, found, titled = F.col("__text"), F.col("__found"), F.col("__titled")
    # The given columns travel in a struct, so that none can clash with those made here.
    rest = [c for c in docs.columns if c != "text"]
    listed = _found(docs.select(F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in rest)).alias("__row"), F.col("text").alias("__text")))
    some = F.size(found) > 0
    odd = checkpoint(exceptions(docs.select("text"), key).select(F.concat_ws(":", "kind", "plain").alias("name"), "attempt"))
    n_odd = odd.count()
    if n_odd == 0:
        attempts = None
    elif n_odd <= BROADCAST_EXCEPTIONS:
        one = odd.agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("__attempts"))
        listed, attempts = listed.crossJoin(F.broadcast(one)), F.col("__attempts")  # one row, of counted size
    else:
        # Too many for a broadcast: the texts that hold some get their own few by a join on the text's hash.
        digest = F.sha2(text, 256)
        own = (
            listed.where(some)
            .select(digest.alias("__id"), F.explode(F.array_distinct(found)).alias("e"), titled.alias("t"))
            .select("__id", F.explode(units_of(F.col("e"), F.col("t"))).alias("u"))
            .select("__id", F.concat_ws(":", "u.kind", "u.plain").alias("name"))
            .distinct()
            .join(odd, "name")
            .groupBy("__id")
            .agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("__attempts"))
        )
        listed = listed.withColumn("__id", F.when(some, digest)).join(own, "__id", "left").drop("__id")
        attempts = F.coalesce(F.col("__attempts"), F.create_map().cast("map<string,int>"))
    clean = F.when(some, _replaced(text, found, titled, attempts, key)).otherwise(text)
    return listed.select(
        *(clean.alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns),
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias(count_as),
    )


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (freed of entities) and n_entities of every row."""
    return replace_entities(docs.select("doc_id", "text"), key, "n_entities")
