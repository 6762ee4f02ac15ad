"""Character references against the standard library's reading of them."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from tideline.functions.entities import unescape
from tideline.operators import keywords


def decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(4)
    return [r.t for r in df.select("n", unescape(F.col("t")).alias("t")).orderBy("n").collect()]


def test_all_names(spark):
    texts = [x for n in html5 for x in (f"&{n}", f"a&{n}b", f"&{n};&{n}")]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_numbers_and_odd_references(spark):
    rng = random.Random(5)
    codes = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 99_999_999, *(rng.randrange(0x110000) for _ in range(500))]
    texts = [x for n in codes for x in (f"&#{n};", f"&#{n}", f"&#x{n:x};", f"&#X{n:06X}z")]
    texts += ["&", "&;", "&#;", "&#x;", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "&lt&lt;", "& amp;", "a && b", "&#00000000000065;", "&unknown;", "&copycat", "&\n", "", "caf&eacute; &#8211; C&#43;&#43;"]
    alphabet = "&&&#xX0159afgltmp;; \n\t<>é😀"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_keywords_behind_references(spark):
    text = "&amp;lt;h2&amp;gt;Requirements&amp;lt;/h2&amp;gt;&lt;ul&gt;&lt;li&gt;C&#43;&#43; and caf&amp;eacute; &amp;#8211; Go&lt;/li&gt;&lt;/ul&gt;"
    df = spark.createDataFrame([(1, text), (2, None), (3, "<p>C&#43;&#43;</p>")], "doc int, text string")
    found = {(r.doc, r.line) for r in keywords.lines(df).collect()}
    assert found == {(1, "Requirements"), (1, "- C++ and café – Go"), (3, "C++")}
    hits = keywords.section_keywords(df, ("C++", "Go"), {}, {}).collect()
    assert {(r.doc, r.term) for r in hits} == {(1, "C++"), (1, "Go"), (3, "C++")}
