"""What each filter removes in every order of the filters, by difference arrays over Lehmer ranks.

A document is a mask of the filters that it fails.  In an order of the filters it goes at
the first one of its mask.  All orders that begin with some filters outside of the mask and
then one of it are an interval in the lexicographic ranking of orders (the Lehmer rank), so
a mask's removals at a step cover a few intervals.  The counts of the masks are added where
intervals begin and taken off where they end; a running sum over the ranks gives what each
step of each order removes.

The table is read once for the flags of each text; first copies are found by an equality
join on (hash of the text, smallest doc_id), where no key holds more than repeated rows.
All that follows are counts: at most 32 masks a part, whatever the number of documents.

Edge cases: a null text is empty; a null lang is the part of the empty string; a row without
doc_id has no smaller one before it and is no smaller one of others; repeated rows of one doc_id are no
copies of each other; of repeated labels a document has the greatest; an empty table has no
parts and gives no rows; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint

FILTERS = "ABCDE"
BLANKS, MARKS, CAPITALS = r"[\x20\x09-\x0D]+", "[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, the hash ``sha`` of each text and whether it fails the filters A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.btrim(text, F.lit("\t\n\x0b\x0c\r ")).alias("trimmed"))
    worded = base.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", BLANKS)))
    n, capitals = F.size("words"), F.char_length("text") - F.char_length(F.translate("text", CAPITALS, ""))
    return worded.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), (n < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
        (100 * capitals > 3 * F.char_length("text")).alias("C"), F.col("text").rlike(MARKS).alias("D"),
    )


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row: bit i is set if it fails the i-th filter."""
    flags = checkpoint(text_flags(docs))
    firsts = flags.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    named = flags.where("doc_id IS NOT NULL").join(firsts.withColumn("first", F.lit(True)), ["sha", "doc_id"], "left")
    all_rows = named.withColumn("E", F.col("first").isNull()).drop("first").unionByName(flags.where("doc_id IS NULL").withColumn("E", F.lit(False)))
    return all_rows.select("doc_id", "part", sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic of each (part, mask) of ``failed``."""
    of_doc = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = failed.where("doc_id IS NOT NULL").join(of_doc, "doc_id", "left")
    no = F.lit(False)
    rows = named.select("part", "mask", "good", "toxic").union(failed.where("doc_id IS NULL").select("part", "mask", no, no))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, low, high): in the orders of rank low to high - 1 a document of the mask goes at the step, by the filter.

    A step counts from 1.  One interval for each way to begin with filters outside of the mask.
    """
    found = []
    for step in range(1, n + 1):
        for begin in permutations(range(n), step):
            # The Lehmer code: how many smaller filters are still free at each place.
            low = sum(sum(x < f and x not in begin[:i] for x in range(n)) * factorial(n - 1 - i) for i, f in enumerate(begin))
            passed = sum(1 << f for f in begin[:-1])
            for mask in range(1 << n):
                if mask >> begin[-1] & 1 and not mask & passed:
                    found.append((mask, step, begin[-1], low, low + factorial(n - step)))
    return found


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for all orders of the filters.

    ``failed`` has doc_id, part and mask; ``labels`` has doc_id, quality and toxic.
    """
    spark, n = failed.sparkSession, len(FILTERS)
    counts = checkpoint(mask_counts(failed, labels))
    spans = spark.createDataFrame(intervals(), "mask int, step int, filter int, low int, high int")
    orders = [(r, s + 1, FILTERS[f], "".join(FILTERS[x] for x in p)) for r, p in enumerate(permutations(range(n))) for s, f in enumerate(p)]
    grid = spark.createDataFrame(orders, "rank int, step int, letter string, filter_order string")

    # Counts begin where an interval does and end behind it.
    of_mask = ("n", "good", "toxic")
    event = lambda at, sign: F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in of_mask))
    events = counts.join(F.broadcast(spans), "mask").select("part", "step", F.explode(F.array(event("low", 1), event("high", -1))).alias("e"))
    changes = events.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*(F.sum(f"e.{c}").alias(c) for c in of_mask))

    # Per part how many fail a filter, how many fail it alone, and all.
    fails = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    letters = F.array(*(F.struct(F.lit(f).alias("letter"), fails(i).alias("fails"), (F.col("mask") == 1 << i).alias("alone")) for i, f in enumerate(FILTERS)))
    of_filter = counts.select("part", "n", F.explode(letters).alias("x")).groupBy("part", F.col("x.letter").alias("letter")).agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("x.fails"), F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("x.alone"), F.col("n")).otherwise(0)).alias("unique_fails"),
    )
    cells = of_filter.join(F.broadcast(grid), "letter").join(changes, ["part", "step", "rank"], "left")

    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.select(
        "part", "rank", "step", "letter", "filter_order", "all", "fails", "unique_fails",
        *(F.sum(F.coalesce(c, F.lit(0))).over(over_ranks).alias(c) for c in of_mask),
    )
    so_far = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return summed.select(
        "part", "filter_order", "step", (F.col("all") - so_far).alias("kept"), F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


#: The same rows in SQL (for DuckDB): each order applied in turn to the counts of the masks.
SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
flags AS (
  SELECT doc_id, part,
         list_filter([CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' END,
                      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
                      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN coalesce(doc_id > first_id, false) THEN 'E' END],
                     lambda x: x IS NOT NULL) AS failed
  FROM worded),
of_doc AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM flags LEFT JOIN of_doc USING (doc_id) GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
gone AS (
  SELECT part, filter_order, n, good, toxic, failed,
         list_min(list_transform(failed, lambda x: position(x IN filter_order))) AS place
  FROM counts, orders),
steps AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step] AS f,
         sum(n) FILTER (place IS NULL OR place > step) AS kept, sum(n) FILTER (place = step) AS removed,
         sum(n) FILTER (list_contains(failed, filter_order[step]) AND place < step) AS redundant,
         sum(n) FILTER (failed = [filter_order[step]]) AS unique_fails,
         sum(good) FILTER (place = step) AS good_lost, sum(toxic) FILTER (place = step) AS toxic_lost
  FROM gone, range(1, 6) AS r(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM steps
"""
