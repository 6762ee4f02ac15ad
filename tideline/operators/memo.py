"""Results kept by content: a document is worked on only if no document of the same content was before.

The key of a document is made of a version (of the bank and the rules), its company and its text
without regard to white space (:func:`tideline.functions.textnorm.content_key`).  Results lie in a
:class:`~tideline.operators.ledger.Ledger`: new keys meet the known ones without a shuffle of
these, each run writes what is new, and a stopped run leaves the results before it.
A content without a result is recorded too, so it is not tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.textnorm import content_key
from tideline.operators.ledger import Ledger
from tideline.operators.state import checkpoint

#: up to so many unknown documents are looked up without a shuffle of the others
BROADCAST_KEYS = 200_000


def with_key(docs: DataFrame, version: str, company: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with their content key as column key; rows that are landed with it can skip this."""
    return docs.withColumn("key", content_key(F.lit(version), F.col(company) if company else F.lit(None).cast("string"), F.col(text), 64))


class Memo:
    """Results in ``path``; ``columns`` is the schema of what the work gives beside doc."""

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64) -> None:
        self.ledger = Ledger(spark, path, f"key string, found boolean, {columns}", "key", None, buckets)

    def unknown(self, docs: DataFrame) -> DataFrame:
        """One of the documents of each key without a recorded result, with the key as doc."""
        return self._texts(docs, self._chosen(docs.select("doc", "key")))

    def _chosen(self, keys: DataFrame) -> DataFrame:
        """key, doc and how often this pair is there: one document of each key without a recorded result."""
        rows = self.ledger.unseen(keys.where("key IS NOT NULL")).groupBy("key", "doc").agg(F.count("*").alias("n"))
        return checkpoint(rows.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("d")).select("key", "d.doc", "d.n"))

    def _texts(self, docs: DataFrame, chosen: DataFrame) -> DataFrame:
        """The chosen rows of ``docs`` with the key as doc; few are looked up by doc before keys are made."""
        known = chosen.agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
        pairs = chosen.select("doc", "key")
        if known["rows"] <= BROADCAST_KEYS:
            docs, pairs = docs.join(F.broadcast(chosen.select("doc").distinct()), "doc", "left_semi"), F.broadcast(pairs)
        some = docs.join(pairs.hint("shuffle_hash") if known["rows"] > BROADCAST_KEYS else pairs, ["doc", "key"], "left_semi")
        some = some.dropDuplicates(["key"]) if (known["most"] or 0) > 1 else some
        return some.drop("doc").withColumnRenamed("key", "doc")

    def results(self, docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``docs`` (doc, key and what ``work`` reads) with their results, those without one left out.

        ``work`` gets unknown documents, one of each content, and returns at most one row a doc.
        Documents with a null key are errors of the caller: they have no content to go by, and no result.
        """
        # The texts are read once for their keys, and those of unknown content once more for the work; they are not moved for the rest.
        keys = checkpoint(docs.select("doc", "key")).where("key IS NOT NULL")  # a condition before would make them twice
        chosen = self._chosen(keys)
        if not chosen.isEmpty():
            made = work(self._texts(docs, chosen)).withColumn("found", F.lit(True)).withColumnRenamed("doc", "key")
            rows = chosen.select("key").join(made, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))
            self.ledger.append(rows)
        return keys.join(self.ledger.rows().where("found").drop("found"), "key")
