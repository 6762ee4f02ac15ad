"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal when they are the same after ASCII blanks are deleted.  The work follows
the partitions of the input (blocks), and only texts that may have a copy move:

1. Each block keeps its rows in the shared folder, in a table bucketed by block, with the
   SHA-256 of the normalised text.  A fingerprint is a prefix of that, ten bits longer than
   the count of rows, so that one text in about a thousand is suspected for nothing.
2. A block sends each owner (a range of fingerprints) its distinct ones, sorted, as a
   Golomb-Rice code of their gaps.  An owner answers with a bitmap for each message: which
   of these some other block has too.
3. A block joins the answers with its own repeats to one bitmap over its rows.  The bucketed
   table meets it without an exchange; rows outside it are alone.
4. The suspects are shuffled by hash and normalised text, copies within a task first
   aggregated, and so compared byte by byte.  What comes out is one row a class.

One class may hold any share of the rows: a block sends its fingerprint once, its texts are
aggregated before they move, and the last join, of rows without texts with classes, is an
equality join that Spark splits where a key is skewed.

Edge cases: a null text counts as empty, and empty texts are copies of each other; of equal
texts the one with the most code points stays, then the smallest doc_id (null last), then
the earlier row of the table as it was read; repeated rows are copies like others, of which
one stays; an empty table gives an empty result.  Further columns, whatever their names,
pass through :func:`keep_one`.  Two unlike texts of one SHA-256 stop the job.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, ensure_checkpoint_dir, shuffle_partitions

BLANKS = "\t\n\x0b\x0c\r "
#: bits by which a fingerprint is longer than the count of rows
SPARE_BITS = 10
#: fingerprints that one owner merges, about
OWNED = 2_000_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


# --- the code --------------------------------------------------------------------


def golomb_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """(bits of a remainder, quotients in unary, remainders) of the Golomb-Rice code of ``gaps``, which are not negative."""
    mean = float(gaps.mean()) if len(gaps) else 0.0
    k = max(0, int(np.log2(max(1.0, mean * np.log(2)))))
    quotients = gaps >> np.uint64(k)
    ends = np.cumsum(quotients + np.uint64(1)).astype(np.int64)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    remainders = (bits << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return (quotients << np.uint64(k)) + remainders


# --- the exchange ------------------------------------------------------------------

MESSAGE = "block int, owner int, n int, k int, unary binary, rest binary"
ANSWER = "block int, owner int, bits binary"


def sent(step: int):
    """Messages of a block: for each owner, a range of ``step`` fingerprints, the sorted distinct ones of the block."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(rows["fp"].to_numpy(np.uint64))
        owner = own // np.uint64(step)
        out = []
        for o in np.unique(owner):
            part = own[np.searchsorted(owner, o) : np.searchsorted(owner, o, side="right")]
            out.append((int(rows["block"].iloc[0]), int(o), len(part), *golomb_encode(np.diff(part, prepend=o * np.uint64(step)))))
        return pd.DataFrame(out, columns=["block", "owner", "n", "k", "unary", "rest"])

    return encode


def answered(messages: pd.DataFrame) -> pd.DataFrame:
    """For each message to an owner which of its fingerprints another message holds too."""
    # Positions from the start of the owner's range are as good as the fingerprints.
    lists = [np.cumsum(golomb_decode(m.n, m.k, m.unary, m.rest)) for m in messages.itertuples()]
    _, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    parts = np.split(counts[where] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"block": messages["block"], "owner": messages["owner"], "bits": [np.packbits(p).tobytes() for p in parts]})


def suspected(step: int):
    """One bitmap over the rows of a block: their fingerprint is another block's too, or comes twice in this one."""

    def apply(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, where, counts = np.unique(rows["fp"].to_numpy(np.uint64), return_inverse=True, return_counts=True)
        sizes = np.unique(own // np.uint64(step), return_counts=True)[1]
        bits = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for b, n in zip(answers.sort_values("owner")["bits"], sizes, strict=True)]
        twice = (np.concatenate(bits) > 0) | (counts > 1)
        flags = np.zeros(int(rows["pos"].max()) + 1, dtype=np.uint8)
        flags[rows["pos"].to_numpy()] = twice[where]
        return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    return apply


def _marked(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bits, F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), 7 - F.pmod(pos, F.lit(8)))), F.lit(2)) == 1


def _kept_in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` as a table in the shared folder: block, pos, chars, sha and the columns as the struct ``row``.

    It is bucketed by block, so that joins by block leave it in place.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"tideline_blocks_{uuid.uuid4().hex}"
    at = F.monotonically_increasing_id()
    rows = docs.select(
        F.shiftright(at, 33).cast("int").alias("block"), at.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("pos"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), F.sha2(normalised(F.col("text")), 256).alias("sha"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    rows.write.bucketBy(shuffle_partitions(spark), "block").option("path", folder).saveAsTable(name)
    kept = spark.table(name)
    # The name goes; the folder stays, as that of a checkpoint does.
    spark.sql(f"DROP TABLE {name}")
    return kept


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (chars, sha, row, ``__at``: where the row stands) and, of texts that come twice, one row each.

    The latter have sha, n and stays: struct of the chars (negative), ``no_id``, doc_id and ``__at`` of the row that stays.
    The rows have ``suspect``, false for those that are surely alone.
    """
    kept = _kept_in_blocks(docs)
    n = kept.count()
    width = max(1, min(60, n.bit_length() + SPARE_BITS))
    owners = max(shuffle_partitions(docs.sparkSession), -(-n // OWNED))
    step = -(-(1 << width) // owners)
    fp = F.shiftright(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), 60 - width)
    prints = kept.select("block", "pos", fp.alias("fp"))
    answers = prints.groupBy("block").applyInPandas(sent(step), MESSAGE).groupBy("owner").applyInPandas(answered, ANSWER)
    bitmaps = checkpoint(prints.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(suspected(step), "block int, bits binary"))
    rows = (
        kept.join(bitmaps.hint("shuffle_hash"), "block")
        .withColumn("suspect", _marked(F.col("bits"), F.col("pos")))
        .withColumn("__at", F.struct("block", "pos"))
        .drop("bits", "block", "pos")
    )
    doc_id = F.col("row.doc_id")
    stays = F.struct((-F.col("chars")).alias("less"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), "__at")
    found = (
        rows.where("suspect")
        .select("sha", normalised(F.col("row.text")).alias("body"), stays.alias("stays"))
        .groupBy("sha", "body")
        .agg(F.count("*").alias("n"), F.min("stays").alias("stays"))
        .drop("body")
    )
    unlike = F.raise_error(F.concat(F.lit("two unlike texts have the SHA-256 "), F.col("sha"))).cast("boolean")
    one_each = found.groupBy("sha").agg(F.count("*").alias("texts"), F.min("n").alias("n"), F.min("stays").alias("stays"))
    return rows, checkpoint(one_each.where(F.when(F.col("texts") > 1, unlike).otherwise(True)).where("n > 1").drop("texts"))


def _judged(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (as ``row``) with sha, keep_id, group_size and kept."""
    rows, twice = classes(docs)
    alone = (F.col("row.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = rows.where("suspect").join(twice, "sha", "left").select(
        "row", "sha", F.when(F.col("n").isNull(), F.col("row.doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("stays.__at") == F.col("__at"), F.lit(True)).alias("kept"),
    )
    return rows.where("NOT suspect").select("row", "sha", *alone).union(some)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (the row that stays), group_size, kept and text_sha256 of every row."""
    judged = _judged(docs.select("doc_id", "text"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of equal texts."""
    return _judged(docs).where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


#: The same rows in SQL (for DuckDB).
SQL = r"""
WITH bodies AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
placed AS (
  SELECT doc_id, body, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM bodies WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM placed
"""
