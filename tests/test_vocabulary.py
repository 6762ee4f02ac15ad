from pyspark.sql import functions as F

from tideline.operators import keywords, memo, vocabulary


def test_tables_equal_lists(spark):
    """Tables and plain lists give the same vocabulary, spellings and keywords."""
    bank, aliases = ["k8s", "Go", "ML", "go", ""], {"Kubernetes": ["k8s", "K8S", None], "ML": ["machine learning"], "Machine": ["ml"], "Go": None}
    taxonomy = {"cloud": {"implies": ["AWS", "k8s"]}, "k8s": {"implies": ["containers"], "factor": 0.25}, "none": None}
    assert sorted(r.term for r in vocabulary.vocabulary_table(spark, bank, aliases, taxonomy).collect()) == ["AWS", "Go", "Kubernetes", "Machine", "cloud", "containers", "none"]
    # "ml" is a spelling of both ML and Machine: the last entry has it
    assert "ML" not in keywords.vocabulary([b for b in bank if b], {t: [s for s in x or () if s] for t, x in aliases.items()}, taxonomy)
    tables = (vocabulary.terms_table(spark, bank), vocabulary.aliases_table(spark, aliases), vocabulary.taxonomy_table(spark, taxonomy))
    assert vocabulary.spelling_table(spark, *tables[:2]).exceptAll(vocabulary.spelling_table(spark, bank, aliases)).isEmpty()
    docs = spark.createDataFrame([(1, "Requirements\nGo, k8s and machine learning in the cloud"), (2, None), (3, "")], "doc int, text string")
    plain = keywords.section_keywords(docs, ["Go", "Kubernetes", "ML", "cloud"], aliases, taxonomy).collect()
    vocab = vocabulary.terms_table(spark, ["Go", "Kubernetes", "ML", "cloud"])
    assert sorted(map(str, plain)) == sorted(map(str, keywords.section_keywords(docs, vocab, *tables[1:]).collect()))
    got = {r.term: (r.weight, r.evidence) for r in plain if r.source == "inferred"}
    assert got == {"AWS": (0.5, "cloud -> AWS"), "containers": (0.25, "Kubernetes -> containers")}


def test_case_of_spellings(spark):
    said = ["C++", "ASP.NET", "Go", "go", "REST", "Rest", "R&D", "1234", "NG+1", "ÄÖÜ-X", "ǅABC", "αβγδ"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", vocabulary.keeps_case(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in rows} == {s: s.isupper() or len(s) <= 3 for s in said}


def test_a_million_terms(spark):
    """A vocabulary and a taxonomy of a million terms: the work is joins, nothing is listed on the driver."""
    n = 1_000_000
    terms = spark.range(n).select(F.concat(F.lit("term"), "id").alias("term"))
    tree = spark.range(n).select(F.col("id").alias("nth"), F.concat(F.lit("term"), "id").alias("parent"), F.concat(F.lit("topic"), F.col("id") % 1000).alias("child"), F.lit(0.5).alias("factor"))
    docs = spark.createDataFrame([(1, "Skills\nTerm7, term999999 and term1000000 with term1007")], "doc int, text string")
    found = keywords.section_keywords(docs, terms, {}, tree).collect()
    assert {(r.term, r.weight, r.source) for r in found} == {
        ("term7", 1.0, "exact"), ("term999999", 1.0, "exact"), ("term1007", 1.0, "exact"), ("topic7", 0.5, "inferred"), ("topic999", 0.5, "inferred"),
    }


def test_memo(spark, tmp_path):
    """A content is worked on once, also where nothing is found in it; another version is another content."""
    kept, worked = memo.Memo(spark, str(tmp_path / "memo"), "words long", buckets=4), []

    def work(docs):
        worked.append(sorted(" ".join((r.text or "").split()) for r in docs.collect()))
        return docs.where(F.col("text") != "").select("doc", F.size(F.split(F.trim("text"), " +")).cast("long").alias("words"))

    def run(rows, version="1"):
        docs = spark.createDataFrame(rows, "doc int, text string, company string")
        return sorted((r.doc, r.words) for r in kept.results(memo.with_key(docs, version, "company"), work).collect())

    assert run([(1, "a b", "X"), (2, " a  b ", "x"), (3, "", "X"), (4, None, "X")]) == [(1, 2), (2, 2)]
    assert worked == [["", "a b"]]
    assert [d for d, _ in run([(5, "a b", "X "), (6, "", "x")])] == [5] and len(worked) == 1
    assert run([(7, "a b", "Y"), (8, "a b", "X")])[0] == (7, 2) and worked[1] == ["a b"]
    assert run([(9, "a b", "X")], "2") == [(9, 2)] and len(worked) == 3
    assert run([]) == []
    assert kept.ledger.rows().count() == 4


def test_memo_reads_texts_for_keys_once(spark, tmp_path):
    """A run without unknown texts makes the key of each text once."""
    made = spark.sparkContext.accumulator(0)

    def key(text):
        made.add(1)
        return text

    docs = spark.range(100, numPartitions=2).select(F.col("id").alias("doc"), F.concat(F.lit("text "), F.col("id") % 40).alias("text"))
    keyed = docs.withColumn("key", F.udf(key, "string")("text"))
    kept = memo.Memo(spark, str(tmp_path / "memo"), "size int", buckets=4)
    work = lambda rows: rows.select("doc", F.length("text").alias("size"))
    assert sorted((r.doc, r.size) for r in kept.results(keyed, work).collect()) == [(i, len(f"text {i % 40}")) for i in range(100)]
    first, made.value = made.value, 0
    assert first <= 300  # once for all keys, then at most twice to look up unknown texts
    assert kept.results(keyed, work).count() == 100 and made.value == 100
