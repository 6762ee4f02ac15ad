"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; only where none is set (tests), take a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-ckpt-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` keys, those of the least hashes (column ``o``), with the least value of each other column.

    The same ones whatever the partitioning.  A first count gives a bound on the hash that
    about ``n`` rows pass, so that no task and no driver meets more than those, however many
    partitions there are; rows that repeat a key are aggregated before they move.
    """
    total, o = rows.count(), F.xxhash64(key, F.lit(seed))
    share = min(1.0, (n + 6 * n**0.5 + 16) / max(1, total))
    few = rows.withColumn("o", F.pmod(o, F.lit(1 << 40))).where(F.col("o") < int(share * (1 << 40)))
    one = few.groupBy(key, "o").agg(F.lit(0).alias("__"), *(F.min(c).alias(c) for c in rows.columns if c != key)).drop("__")
    return one.orderBy("o", key).limit(n)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two long columns ``src`` and ``dst`` of any order, without nulls.
    Returns ``node`` and ``label``, the smallest node of its component, for every
    node of an edge between different nodes.  Each round is one aggregation and one
    join over the edges; no neighbour list is ever gathered in a row.
    """
    e = checkpoint(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        # Large-star: hang every larger neighbour of a node on the smallest one of its neighbourhood.
        both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small-star: hang a node and its smaller neighbours on the smallest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
            .distinct()
        )
        e = checkpoint(small)
        state = e.agg(
            F.count("*").alias("n"),
            F.countDistinct("v").alias("nodes"),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("digest"),
        ).first()
        if (state["n"] == state["nodes"] and seen == tuple(state)) or state["n"] == 0:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("label")).union(
        e.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    )
