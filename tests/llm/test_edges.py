"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from tideline.llm import ann, chat, licenses, mixing, ngram_join, packing, pii, quality_rules, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
PLAIN = " ".join(f"alpha{i} beta" for i in range(60))
ROWS = [
    (1, PLAIN, "en", "a"), (1, PLAIN, "en", "a"), (2, PLAIN + " more", None, None), (3, None, "en", "a"), (4, "", None, "b"),
    (5, " \n\t ", "en", None), (6, LONG, "de", "b"), (None, "one two", "en", "a"), (None, PLAIN, "en", "b"), (7, "x", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    # further columns whose names the operators use inside
    for name in ("n_words", "h", "sid", "size", "copies", "__text", "label", "key", "block", "kept", "__id", "again"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_quality(spark, docs):
    out = {(r.doc_id, r.n_words): r.kept for r in quality_rules.judge(docs).collect()}
    assert out[1, 120] and not out[3, 0] and not out[4, 0] and len(quality_rules.judge(docs).collect()) == len(ROWS)
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality_rules.judge(docs.limit(0)).count() == 0 and quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_ngram_join(spark, docs):
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()), key=str)
    assert [c for i, n, c in out if i in (1, 2)] == [1, 1, 1]
    assert (3, 0, 3) in out and (4, 0, 4) in out and (5, 0, 5) in out and (7, 1, 7) in out and (None, 1, None) in out and len(out) == len(ROWS)
    assert [c for i, n, c in out if i is None and n > 1] == [1]
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert ngram_join.components(docs.limit(0)).count() == 0


def test_pii(spark, docs):
    docs = docs.withColumn("__found", F.lit("mine")).withColumn("__row", F.lit(1)).withColumn("a.b", F.lit(2))
    out = pii.replace_entities(docs, "k")
    assert out.columns == [*docs.columns, "__entities"] and out.count() == len(ROWS) and out.where("__found <> 'mine'").isEmpty()
    assert out.where("text IS NULL").count() == 1 and pii.surrogates(docs.limit(0), "k").count() == 0
    long = LONG + " mail a@b.cc " + LONG
    ends = spark.createDataFrame([(1, "a@b.cc"), (2, "a@b.cc\n+1 555 123 4567"), (3, long), (3, long)], "doc_id int, text string")
    got = pii.surrogates(ends, "k").orderBy("doc_id", "text").collect()
    assert [r.n_entities for r in got] == [1, 2, 1, 1] and got[2] == got[3] and len(got[2].text) > len(LONG) * 2 and "a@b.cc" not in got[2].text
    with pytest.raises(ValueError):
        pii.surrogates(docs, "")


def test_mixing(spark, docs):
    out = mixing.taken_words(docs).collect()
    assert len(out) == len(ROWS) and all(r.taken <= 2 * r.size for r in out)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.taken_words(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    out = packing.pack(docs, PATH).toPandas().sort_values(["doc_id", "piece"])
    assert out[out.doc_id == 3].length.tolist() == [1] and out[out.doc_id == 6].length.iloc[1:].eq(1024).all()
    assert (out.groupby("sequence_id").length.sum() <= 1024).all()
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_licences_and_toxicity(spark, docs):
    assert licenses.scan(docs).where(F.size("found") == 0).count() == len(ROWS)
    assert licenses.scan(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (99, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).count() == len(ROWS)
    assert toxicity.classify(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 1.0, 0.5]) for i in range(30)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, None, 1.0]), (104, [inf, 1.0, 1.0]), (105, [1.0]), (0, [0.0, 1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("list", F.lit("x"))
    out = ann.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in out if r.query_id == 0] == [5, 10, 15, 20, 25, 1, 6, 11, 16, 21] and out[0].score == 0.0
    assert {r.query_id for r in out} == {0, 10, 20} and ann.search(df.limit(0), F.lit(True)).count() == 0
    twice = ann.search(spark.createDataFrame([(1, [3.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.5]), (3, [3.0, 1.1])], "vec_id long, embedding array<float>"), F.col("vec_id") == 1).orderBy("rank").collect()
    assert [r.vec_id for r in twice] == [2, 3] and twice[0].score == 0.5  # the least vector asks
    assert ann.search(df.where("vec_id < 4 AND vec_id > 0"), F.col("vec_id") == 1).count() == 2


def test_chat(spark):
    rows = [
        (1, 0, "user", "a\\<|im_end|>\nb"), (1, 1, "user", None), (1, 2, "assistant", "<\\|x"), (1, 3, "assistant", "é<|im_sep|>"), (2, None, None, "x"), (None, 0, "assistant", ""),
        (3, 0, "us\\ner\n<|", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(0)).withColumn("formatted", F.lit(0))
    made = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r or "", t or "") for c, _, r, t in rows if c == 1] and back[1].loss_text == "<\\|xé<|im_sep|>"
    assert back[1].formatted.count("<|im_start|>") == 2 and [tuple(t) for t in back[3].turns] == [("us\\ner\n<|", "t")]
    assert [tuple(t) for t in back[2].turns] == [("", "x")] and back[None].loss_text == ""
    assert chat.digests(df.limit(0)).count() == 0


def test_urls_of_any_length_and_tied_purities(spark):
    deep = "http://h.com" + "".join(f"/s{chr(97 + i)}" for i in range(9))
    rows = [(i, f"{deep}/{'bad' if i % 2 else 'good'}") for i in range(80)] + [(100, "http://h.com/" + "x" * 50_000), (101, "http://tie.com/a"), (102, "http://tie.com/b")]
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(80)] + [(101, False), (102, False)], "page_id long, good boolean")
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=()).collect()}
    # paths that part in their tenth segment
    assert out[1].verdict == "block" and out[0].verdict == "allow" and out[1].template.endswith("/bad")
    assert len(out[100].path) == 50_001 and out[100].verdict == "allow" and out[101].purity == out[102].purity and out[101].verdict == out[102].verdict


def test_urls(spark):
    rows = [(1, "http://a.EXAMPLE.com/en/7x?q"), (2, "https://b.net/de/1"), (3, None), (4, "no scheme"), (5, "x://y"), (1, "http://a.EXAMPLE.com/en/7x?q"), (6, "http://notexample.com/en/7")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(0)).withColumn("template", F.lit(0))
    labels = spark.createDataFrame([(1, True), (2, None)], "page_id long, good boolean")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, labels).collect()}
    assert out[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and out[2] == ("b.net", "/de/1", "net/de/", "allow")
    assert out[3] == ("", "", None, "allow") and out[4][:2] == ("", "") and out[5] == ("y", "", None, "allow") and out[6][2:] == ("com/en/", "block")
    assert url_filter.judge(df.limit(0), labels).count() == 0 and url_filter.judge(df, labels.limit(0)).count() == len(rows)
