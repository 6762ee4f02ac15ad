import datetime as dt

from pyspark.sql import functions as F

from tideline.functions import dates, textnorm
from tideline.functions.terms import any_term
from tideline.operators import keywords, screens

NOW = dt.datetime(2026, 8, 26, 12)


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_names(spark):
    got = values(spark, ["Acme, Inc.", "ACME GmbH", "Société Générale", None, "Ba  nk  s.p.a."], textnorm.normalize_company)
    assert got == ["acme", "acme", "societegenerale", "", "bank"]
    assert values(spark, ["🛂 Engineer", "Engineer", "Engi-neer!"], textnorm.normalize_title) == ["engineer"] * 3
    assert values(spark, ["The Home Depot, Inc", "the co", "Therapy"], textnorm.matching_key) == ["homedepot", "the", "rapy"]
    assert values(spark, ["ﬁn  Ångström"], textnorm.normalize_text) == ["fin angstrom"]


def test_dates(spark):
    rows = ["1767841111", "1767841111000", "2026-08-06T23:30:00-04:00", "2026-08-06", "Aug 27", "Aug 28", "Feb 29", "20260805", "", None, "soon", "2026-13-01"]
    got = values(spark, rows, lambda c: dates.coerce_date(c, NOW))
    d = dt.date
    assert got == [d(2026, 1, 8), d(2026, 1, 8), d(2026, 8, 6), d(2026, 8, 6), d(2026, 8, 27), d(2025, 8, 28), None, d(1970, 8, 23), None, None, None, None]
    assert values(spark, ["08062026", "", "1306"], dates.iso_date) == ["2026-08-06", "", ""]


def test_url_keys(spark):
    rows = [
        "https://n.example/jobs?gh_jid=77", "https://boards.greenhouse.io/acme/jobs/12", "https://jobs.lever.co/x/ABCDEF01-2345-6789-abcd-ef0123456789",
        "https://acme.recruitee.com/o/Role-X?y", "https://acme.jobs.personio.de/job/5", "https://example.com", "",
    ]
    got = values(spark, rows, lambda c: textnorm.url_key(c, textnorm.JOB_URL_RULES))
    assert got == ["gh:77", "gh:12", "lever:abcdef01-2345-6789-abcd-ef0123456789", "recruitee:acme/role-x", "personio:5", None, None]


def test_terms(spark):
    word = lambda c: any_term(textnorm.normalize_text(c), ("intern", "C++"))
    assert values(spark, ["Intern, sales", "International", "internal"], word) == [True, False, False]
    alnum = lambda c: any_term(textnorm.normalize_text(c), ("c++", ".net", "go"), "alnum")
    assert values(spark, ["C++ dev", "a .NET role", "cargo", "Go_lang", "x"], alnum) == [True, True, False, True, False]
    assert values(spark, ["x"], lambda c: any_term(c, (), empty=True)) == [True]


def test_locations(spark):
    region = {"countries": ("Germany",), "cities": ("Cork", "Dublin"), "remote": ("remote - eu",), "exclude": ("remote - us",)}
    got = values(spark, ["Cork", "Corktown", "Dublin, CA", "remote - EU", "", "München, Germany"], lambda c: screens.in_region(c, region))
    assert got == [True, False, True, True, False, True]
    assert values(spark, ["Dublin, CA", "Berlin, DE", "U.S.", "London"], screens.is_us) == [True, True, True, False]
    assert values(spark, ["a | b |", "  ", None], screens.location_parts) == [["a", "b"], ["  "], [""]]


def test_numbers_and_support(spark):
    assert values(spark, ["106 and 82% of T4, 100K+ at 1:1"], keywords.numbers) == [["106", "82%", "100k+", "1:1"]]


def test_support_equals_plain_python(spark):
    """Whole spellings and close words, against regular expressions and pairs of words."""
    import random
    import re

    def stem(w):
        return next((w[: -len(e)] for e in keywords.SUFFIXES if w.endswith(e) and len(w) - len(e) >= 4), w)

    def close(a, b):
        a, b = stem(a), stem(b)
        return a == b if min(len(a), len(b)) < 4 else a.startswith(b) or b.startswith(a)

    def supported(text, spellings):
        words = re.findall("[a-z0-9+#]+", (text or "").lower())
        for s in [s for s in spellings or () if s is not None]:
            if re.search(rf"(?<!\w){re.escape(s.lower())}(?!\w)", (text or "").lower()):
                return True
            if all(any(close(t, w) for w in words) for t in re.findall("[a-z0-9+#]+", s.lower())):
                return True
        return False

    rng = random.Random(4)
    parts = ["go", "Go", "cargo", "classifier", "classification", "class", "c", "c++", "C#", ".net", "asp", "naïve", "é", "日本", "data", "databases", "dat", "_x", "😀", "pre", "a", "aa", "©"]
    text = lambda n: "".join(rng.choice(parts) + rng.choice([" ", " ", "", "-", ".", "/", "😀", "_", "é"]) for _ in range(rng.randint(0, n)))
    cases = [("built classification models", ["classifier"]), ("wrote Go", ["go"]), ("cargo", ["go"]), (None, ["go"]), ("go", None), ("go", []), ("go", [None]), ("", ["©"]), ("xa a a", ["a a"]), ("x" * 300_000 + " end", ["ending"])]
    cases += [(text(8), [rng.choice([text(3), None]) for _ in range(rng.randint(0, 2))]) for _ in range(1_500)]
    cases += cases[:300]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], "id int, text string, spellings array<string>")
    got = [r.id for r in keywords.unsupported(df).select("id").collect()]
    assert sorted(got) == [i for i, (t, s) in enumerate(cases) if not supported(t, s)]
    assert keywords.unsupported(df.limit(0)).columns == ["id", "text", "spellings"]
    lacking = keywords.unsupported(df.unionAll(df).where("id = 2"))  # rows that repeat are kept
    assert lacking.count() == 2


def test_decomposition_of_every_code_point(spark):
    """Alone and inside a text, each character loses what NFKD without combining characters loses."""
    import unicodedata

    plain = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    chars = [chr(n) for n in range(0x110000) if not 0xD800 <= n <= 0xDFFF]
    texts = ["".join(chars[i : i + 500]) for i in range(0, len(chars), 500)] + ["한국어 글자, ﬁne … ½ ㎏", "가", "힣힣", "ﷺ", "", "e\u0301ﬁ각"]
    texts += [f"a{c}b" for c in chars[:0x3400] + [c for c in chars[0xF900:0x20000] if plain(c) != c]]
    got = values(spark, texts, textnorm.strip_diacritics)
    assert [(t, g) for t, g in zip(texts, got) if g != plain(t)] == []
    assert values(spark, ["한글 Ltd", None], textnorm.normalize_text) == [plain("한글 ltd"), ""]
