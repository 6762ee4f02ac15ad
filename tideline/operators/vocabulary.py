"""A vocabulary as tables: terms of the bank, aliases and taxonomy of any size, joined and never listed on the driver.

``aliases``: nth, canonical, spelling (a row a spelling; a canonical term need not be its own);
``taxonomy``: nth, parent, child, factor.  ``nth`` is the order of the entries: of several canonical
terms for one spelling the last counts, of several equal parents the first.  Spellings are compared without regard to
case.  Null and empty terms are no terms; null factors are the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a clause falls into runs of word characters, + and #, and single other characters; a spelling matches whole pieces
PIECES = r"(?U)[\w+#]+|[^\w+#]"
FACTOR = 0.5


def terms_table(spark: SparkSession, terms) -> DataFrame:
    """``terms`` as a table with column term, if they are a list."""
    return terms if isinstance(terms, DataFrame) else spark.createDataFrame([(t,) for t in terms], "term string")


def aliases_table(spark: SparkSession, aliases) -> DataFrame:
    """``aliases`` as a table, if they are canonical term -> spellings."""
    if isinstance(aliases, DataFrame):
        return aliases
    rows = [(i, term, s) for i, (term, spellings) in enumerate(aliases.items()) for s in (term, *(spellings or ()))]
    return spark.createDataFrame(rows, "nth long, canonical string, spelling string")


def taxonomy_table(spark: SparkSession, taxonomy, factor: float = FACTOR) -> DataFrame:
    """``taxonomy`` as a table, if it is parent -> {implies, factor}; a parent without children has one null child."""
    if isinstance(taxonomy, DataFrame):
        return taxonomy
    rows = [
        (i, parent, child, float((entry or {}).get("factor", factor)))
        for i, (parent, entry) in enumerate(taxonomy.items())
        for child in (entry or {}).get("implies") or (None,)
    ]
    return spark.createDataFrame(rows, "nth long, parent string, child string, factor double")


def canonical_spellings(aliases: DataFrame) -> DataFrame:
    """spelling (lower case) and the one canonical term it stands for."""
    every = aliases.select("nth", "canonical", "spelling").union(aliases.select("nth", "canonical", F.col("canonical")))
    named = every.where("canonical <> '' AND spelling <> ''")
    return named.groupBy(F.lower("spelling").alias("spelling")).agg(F.max_by("canonical", F.struct("nth", "canonical")).alias("canonical"))


def canonical_terms(rows: DataFrame, aliases: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` with ``term`` replaced by its canonical form: an equality join with ``aliases`` (spelling, canonical) without regard to case."""
    table = aliases.select(F.lower("spelling").alias("__s"), F.col("canonical").alias("__c"))
    joined = rows.join(table, F.lower(term) == F.col("__s"), "left")
    return joined.withColumn(term, F.coalesce("__c", term)).drop("__s", "__c")


def vocabulary_table(spark: SparkSession, bank, aliases, taxonomy) -> DataFrame:
    """Column term: every canonical term of the bank, the aliases and the taxonomy, once."""
    bank, aliases, taxonomy = terms_table(spark, bank), aliases_table(spark, aliases), taxonomy_table(spark, taxonomy)
    every = bank.select("term").union(aliases.select("canonical")).union(taxonomy.select("parent")).union(taxonomy.select("child"))
    return canonical_terms(every.where("term <> ''").distinct(), canonical_spellings(aliases)).distinct()


def canonical_tree(spark: SparkSession, taxonomy, aliases, factor: float = FACTOR) -> DataFrame:
    """nth, parent, child, factor: the taxonomy in canonical terms, entries without a child left out."""
    known = canonical_spellings(aliases_table(spark, aliases))
    tree = taxonomy_table(spark, taxonomy, factor).where("parent <> '' AND child <> ''")
    tree = canonical_terms(canonical_terms(tree, known, "parent"), known, "child")
    return tree.select("nth", "parent", "child", F.coalesce("factor", F.lit(factor)).alias("factor"))


def keeps_case(spelling: Column) -> Column:
    """All capitals and up to three letters keep their case."""
    capitals = spelling.rlike(r"\p{IsUppercase}") & ~spelling.rlike(r"[\p{IsLowercase}\p{Lt}]")
    return capitals | (F.length(spelling) <= 3)


def spelling_table(spark: SparkSession, vocab, aliases) -> DataFrame:
    """(term, spelling, key, pieces, exact): every spelling of every term; ``key`` is what clauses are joined by."""
    terms, aliases = terms_table(spark, vocab).select("term").distinct(), aliases_table(spark, aliases)
    others = terms.join(aliases, F.col("term") == F.col("canonical")).select("term", "spelling")
    rows = terms.select("term", F.col("term").alias("spelling")).union(others).where("spelling <> ''").distinct()
    spelling = F.col("spelling")
    return rows.select(
        "term", "spelling", F.lower(spelling).alias("key"), F.size(F.regexp_extract_all(spelling, F.lit(PIECES), F.lit(0))).alias("pieces"), keeps_case(spelling).alias("exact")
    )
