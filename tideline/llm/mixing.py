"""Mixing sources to target weights by capped water-filling.

Each source should give its weight's share of the words of the mix, but no document is
taken more than ``max_epochs`` times.  Sources that would need more are clamped and
their excess goes to the others in proportion to their weights, until none is above its
cap.  A source whose target is r times its size is taken floor(r) times whole; the
fractional repetition is a seeded prefix of its documents in the order of a keyed hash,
followed by up to ``FILLS`` documents that close the gap best.

A source is never sorted as a whole: the hash order is cut into 4,096 ranges, or as many
more as keep one near ``RANGE_ROWS`` hashes, whose sizes are summed, and only the range in
which the prefix ends is ordered.  Rows of one hash are summed first and taken together.

Edge cases: null texts have size 0; a null source is a source of its own; rows that
repeat an id in a source (null ids too) share a hash and are taken alike, so that the taken
words come as near to the target as the largest such group allows; a source without words gets
target 0; an empty table gives an empty result; further columns pass through :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
FILLS = 2
BROADCAST_SOURCES = 20_000
RANGE_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def same_source(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Give the sources, one row each, repeating weights in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank - 1) % len(weights) + 1))


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): min(cap, level * weight) at the level that uses ``total``.

    ``total`` is an aggregate over ``source_size``.  Each round sums the clamped caps and the
    free weights anew and raises the level; it ends when no further source is clamped.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    whole = sources.agg(total.alias("t"), F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    goal, clamped = float(whole["t"] or 0), 0
    level = goal / whole["w"] if whole["w"] else 0.0
    for _ in range(int(whole["n"]) + 1):
        over = cap <= level * F.col("weight")
        now = sources.agg(
            F.sum(over.cast("int")).alias("n"),
            F.sum(F.when(over, cap)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
        ).first()
        if not now["free"] or now["n"] == clamped:
            break
        clamped = now["n"]
        level = (goal - (now["fixed"] or 0.0)) / now["free"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """How each source is taken: source_size, target, whole repetitions, the hash up to which
    its documents are taken once more, and the hashes of the documents that close the gap.

    ``sized`` has source, size and h, the order key.
    """
    sized = checkpoint(sized.groupBy("source", "h").agg(F.sum("size").alias("size")))
    n = sized.count()
    digits = next(d for d in range(3, 33) if n <= RANGE_ROWS * 16**d)
    prefix = F.substring("h", 1, digits)
    ranges = checkpoint(sized.withColumn("range", prefix).groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    sources = checkpoint(cyclic_weights(sources, weights))
    sources = water_fill(sources, F.sum("source_size") * share, max_epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = checkpoint(sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")))

    def of_source(df: DataFrame, columns: list[str], of: DataFrame, how: str = "inner") -> DataFrame:
        small = of.select(F.col("source").alias("__s"), *columns)
        if of.count() <= BROADCAST_SOURCES:
            small = F.broadcast(small)
        return df.join(small, same_source("source", "__s"), how).drop("__s")

    # The range in which the running size passes the wanted extra.
    running = Window.partitionBy("source").orderBy("range")
    cut_range = (
        of_source(ranges, ["extra"], sources)
        .withColumn("until", F.sum("range_size").over(running))
        .where(F.col("until") > F.col("extra"))
        .groupBy("source")
        .agg(F.min(F.struct("range", (F.col("until") - F.col("range_size")).alias("before"), "extra")).alias("c"))
        .select("source", "c.*")
    )
    cut_range = checkpoint(cut_range)
    inside = of_source(sized, ["range", "before", "extra"], cut_range).where(prefix == F.col("range"))
    taken = inside.withColumn("until", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("h"))).where(
        F.col("until") <= F.col("extra")
    )
    last = taken.groupBy("source").agg(F.max("h").alias("last"))
    cut = of_source(cut_range.select("source", "range"), ["last"], last, "left").select("source", F.coalesce("last", "range").alias("cut"))
    plans = of_source(sources, ["cut"], cut, "left").withColumn("cut", F.coalesce("cut", F.lit("g")))  # g: beyond every hash
    plans = checkpoint(plans)
    fills: list[str] = []
    for i in range(FILLS):
        once = of_source(sized, ["extra", "cut", *fills], plans)
        counted = _is_extra(fills)
        gap = once.groupBy("source", "extra").agg(F.sum(F.when(counted, F.col("size")).otherwise(0)).alias("have"))
        gap = gap.select("source", (F.col("extra") - F.col("have")).alias("gap"))
        plans = checkpoint(of_source(plans, ["gap"], gap, "left"))
        best = (
            of_source(sized, ["cut", "gap", *fills], plans)
            .where(~counted & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
            .groupBy("source")
            .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "h")).getField("h").alias(f"fill_{i}"))
        )
        plans = checkpoint(of_source(plans, [f"fill_{i}"], best, "left").drop("gap"))
        fills.append(f"fill_{i}")
    return plans


def _is_extra(fills: list[str]) -> Column:
    found = F.col("h") <= F.col("cut")
    for f in fills:
        found = found | F.coalesce(F.col("h") == F.col(f), F.lit(False))
    return found


def with_copies(sized: DataFrame, plans: DataFrame) -> DataFrame:
    """Add source_size, target and ``copies`` to rows that have source and h."""
    fills = [f"fill_{i}" for i in range(FILLS)]
    small = plans.select(F.col("source").alias("__s"), "source_size", "target", "whole", "cut", *fills)
    if plans.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    joined = sized.join(small, same_source("source", "__s"))
    return joined.withColumn("copies", F.col("whole") + _is_extra(fills).cast("long")).drop("__s", "whole", "cut", *fills)


def sized_documents(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("h"))


def taken_words(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every row."""
    sized = checkpoint(sized_documents(docs, seed))
    found = with_copies(sized, plan(sized, weights, share, max_epochs))
    return found.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as it is taken, with its own columns."""
    plans = plan(checkpoint(sized_documents(docs, seed)), weights, share, max_epochs)
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), "source", order_key(F.col("doc_id"), seed).alias("h"))
    repeated = with_copies(keyed, plans).where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


#: The same rows in SQL (for DuckDB), at the default parameters.  The water level follows from sorting the sources by cap over weight.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0 * source_size / weight AS ratio, (SELECT 1.5 * sum(source_size) FROM weighed) AS goal FROM weighed),
levels AS (
  SELECT ratio, (goal - coalesce(sum(2.0 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lvl
  FROM ranked WINDOW w AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT coalesce(min_by(lvl, ratio) FILTER (WHERE lvl < ratio), 1e300) AS lvl FROM levels),
targets AS (
  SELECT source, source_size, least(2.0 * source_size, lvl * weight)::DOUBLE AS target FROM weighed, water),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
units AS (SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
running AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS until
  FROM units s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source),
g0 AS (SELECT source, any_value(extra) - coalesce(sum(size) FILTER (until <= extra), 0) AS gap FROM running GROUP BY source),
f0 AS (
  SELECT r.source, min_by(h, (abs(size - gap), h)) AS fill
  FROM running r JOIN g0 ON r.source IS NOT DISTINCT FROM g0.source
  WHERE until > extra AND size > 0 AND size < 2 * gap GROUP BY r.source),
one AS (
  SELECT r.*, (until <= extra OR coalesce(h = f0.fill, false)) AS is_extra
  FROM running r LEFT JOIN f0 ON r.source IS NOT DISTINCT FROM f0.source),
g1 AS (SELECT source, any_value(extra) - coalesce(sum(size) FILTER (is_extra), 0) AS gap FROM one GROUP BY source),
f1 AS (
  SELECT r.source, min_by(h, (abs(size - gap), h)) AS fill
  FROM one r JOIN g1 ON r.source IS NOT DISTINCT FROM g1.source
  WHERE NOT is_extra AND size > 0 AND size < 2 * gap GROUP BY r.source)
SELECT s.doc_id, s.source, s.size, source_size, target,
       (whole + (is_extra OR coalesce(o.h = f1.fill, false))::INT)::BIGINT AS copies,
       (s.size * (whole + (is_extra OR coalesce(o.h = f1.fill, false))::INT))::BIGINT AS taken
FROM one o LEFT JOIN f1 ON o.source IS NOT DISTINCT FROM f1.source JOIN sized s ON s.h = o.h AND s.source IS NOT DISTINCT FROM o.source
"""
