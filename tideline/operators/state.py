"""What was seen before: greedy two-key dedupe, new rows against saved state, upsert, prune."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.commits import Commits, Files, StateError


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's ``spark.checkpoint.dir`` and cut its lineage; without a shared folder that is an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


#: rows that one component may have to be folded in a task
FOLD_ROWS = 200_000


def greedy_dedupe(df: DataFrame, id_col: str, key_col: str, order: str) -> DataFrame:
    """Keep a row unless an earlier *kept* row has its id or its key (null keys never clash); ``order`` tells rows apart.

    This equals the fold in arrival order.  Rows alone in both groups are kept at once.  A round
    then keeps every open row that comes first both among its id and among its key, and drops
    what shares an id or key with those; that empties groups of any size.  Rounds go on while each leaves at
    most half of the rows.  What they would not empty are long chains: they fall into components of rows that share
    ids or keys, each of which is folded in a task of its own.  Only a component beyond
    :data:`FOLD_ROWS` goes on in rounds.
    """
    columns = df.columns
    alone, open_rows = _alone(df, id_col, key_col, order)
    kept, n, folded = [alone], open_rows.count(), False
    while n:
        now, open_rows = _round(open_rows, id_col, key_col, order)
        kept.append(now)
        before, n = n, open_rows.count()
        if n > before / 2 and not folded:
            small, open_rows = _by_component(open_rows, id_col, key_col, order)
            kept.append(small)
            n, folded = open_rows.count(), True
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return out.select(columns)


def _firsts(rows: DataFrame, id_col: str, key_col: str, order: str) -> DataFrame:
    """Add of each row's id and key the first row and the count; null keys stay out of the grouping."""
    by_id = rows.groupBy(F.col(id_col).alias("__i")).agg(F.min(order).alias("__fi"), F.count("*").alias("__ni"))
    by_key = rows.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.min(order).alias("__fk"), F.count("*").alias("__nk"))
    return rows.join(by_id, F.col(id_col).eqNullSafe(F.col("__i"))).drop("__i").join(by_key, key_col, "left")


def _alone(rows: DataFrame, id_col: str, key_col: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id and key no other row has, and the rest."""
    marked = _firsts(rows, id_col, key_col, order)
    alone = (F.col("__ni") == 1) & (F.coalesce("__nk", F.lit(1)) == 1)
    return marked.where(alone).select(rows.columns), checkpoint(marked.where(~alone).select(rows.columns))


def _round(rows: DataFrame, id_col: str, key_col: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows first in both groups, and those that share nothing with them."""
    first = (F.col("__fi") == F.col(order)) & (F.coalesce("__fk", F.col(order)) == F.col(order))
    now = checkpoint(_firsts(rows, id_col, key_col, order).where(first).select(rows.columns))
    ids, keys = now.select(F.col(id_col).alias("__i")), now.select(F.col(key_col).alias("__k")).where("__k IS NOT NULL")
    left = rows.join(ids, F.col(id_col).eqNullSafe(F.col("__i")), "left_anti").join(keys, F.col(key_col) == F.col("__k"), "left_anti")
    return now, checkpoint(left)


def _by_component(rows: DataFrame, id_col: str, key_col: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Kept rows of the components that one task can fold, and all rows of the larger ones."""
    columns = rows.columns
    # Ids and keys are nodes, named by a hash (one that two share only joins their components); a row is an edge.
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    marked = checkpoint(rows.withColumn("__n", node("id", id_col)))
    parts = components(marked.where(F.col(key_col).isNotNull()).select(F.col("__n").alias("a"), node("key", key_col).alias("b")))
    named = marked.join(parts.withColumnRenamed("node", "__n"), "__n", "left").withColumn("__c", F.coalesce("component", "__n")).drop("component", "__n")
    named = checkpoint(named)
    large = named.groupBy("__c").agg(F.count("*").alias("__size")).where(F.col("__size") > FOLD_ROWS).select("__c")
    light = named.join(large, "__c", "left_anti").select("__c", F.col(order).alias("o"), F.col(id_col).alias("i"), F.col(key_col).alias("k"))

    def fold(part):
        ids, keys, kept = set(), set(), []
        for o, i, k in part.sort_values("o")[["o", "i", "k"]].astype(object).itertuples(index=False):
            k = None if k is None or k != k else k
            if i not in ids and (k is None or k not in keys):
                kept.append(o)
                ids.add(i)
                keys.add(k)
        return part[part["o"].isin(kept)][["o"]]

    found = light.groupBy("__c").applyInPandas(fold, f"o {rows.schema[order].dataType.simpleString()}")
    kept = checkpoint(rows.join(found.withColumnRenamed("o", "__o"), F.col(order) == F.col("__o"), "left_semi"))
    return kept.select(columns), checkpoint(named.join(large, "__c", "left_semi").select(columns))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b: longs): the smallest node that is connected with each.

    Every round hangs nodes on the smallest neighbour of their neighbourhood, first the larger
    neighbours of each node, then the smaller ones; the distance to the smallest node shrinks by a
    factor each round, so chains take rounds by the logarithm of their length.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        hung = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = hung.groupBy("v").agg(F.min("u").alias("m"))
        again = hung.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        e = checkpoint(again.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.countDistinct("v"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        # Stars that a round leaves as they are: every node hangs on one, the smallest.
        if now[0] == now[1] and now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def unseen(df: DataFrame, seen, id_col: str = "id", key_col: str = "ats_key") -> DataFrame:
    """Rows whose id and (non-null) key are not in ``seen``: two anti joins, never one with OR.

    ``seen`` is a DataFrame, or a :class:`tideline.operators.ledger.Ledger`, which is not shuffled.
    """
    if not isinstance(seen, DataFrame):
        return seen.unseen(df)
    ids = seen.select(F.col(id_col).alias("__i")).distinct()
    keys = seen.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("__k")).distinct()
    return df.join(ids, F.col(id_col) == F.col("__i"), "left_anti").join(keys, F.col(key_col) == F.col("__k"), "left_anti")


def split_new(df: DataFrame, seen, groups: DataFrame, order: str = "ord") -> DataFrame:
    """New rows with ``silent``: rows of groups that were never fetched before are recorded without notice.  ``seen`` as in :func:`unseen`."""
    # Few rows are new as a rule; the feed behind them is made once.
    fresh = greedy_dedupe(checkpoint(unseen(df, seen)), "id", "ats_key", order)
    known = groups.select(F.col(groups.columns[0]).alias("seed_group")).distinct().withColumn("known", F.lit(True))
    return fresh.join(known, "seed_group", "left").withColumn("silent", F.col("known").isNull()).drop("known")


def newest(df: DataFrame, n: int, date: str = "date_posted", order: str = "ord", by: str = "chronological") -> DataFrame:
    """The ``n`` newest rows; ``by="mmddyyyy"`` orders by the date's text, month before year."""
    key = F.date_format(date, "MMddyyyy") if by == "mmddyyyy" else F.col(date)
    return df.orderBy(key.desc_nulls_last(), order).limit(n)


def batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Number rows of a capped result and deal them into batches (one window: the rows are few by then)."""
    n = F.row_number().over(Window.orderBy(*order))
    return df.withColumn("n", n).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("long"))


def upsert_seen(seen: DataFrame, rows: DataFrame, now: dt.datetime, seeded: Column | bool = False) -> DataFrame:
    """``seen`` with ``rows`` recorded under their ids; earlier records stay."""
    flag = seeded if isinstance(seeded, Column) else F.lit(seeded)
    new = rows.select("id", F.lit(now).alias("first_seen"), "company", "title", "ats_key", flag.alias("seeded"))
    return seen.unionByName(new.join(seen.select("id"), "id", "left_anti"))


def mark_groups(groups: DataFrame, fetched: DataFrame) -> DataFrame:
    return groups.union(fetched.select("seed_group")).distinct()


def migrated_groups(spark, configured, bootstrapped: bool) -> DataFrame:
    """Groups of a state that recorded none: all configured sources count as fetched before if the state was ever filled."""
    return spark.createDataFrame([(name,) for name in configured] if bootstrapped else [], "seed_group string")


def groups_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether ``after`` has a group that ``before`` lacks."""
    return not after.exceptAll(before).isEmpty()


def prune(seen: DataFrame, days: int, now: dt.datetime) -> DataFrame:
    """Without records first seen more than ``days`` before ``now``; unreadable times stay, 0 keeps all."""
    if days <= 0:
        return seen
    at = F.col("first_seen").try_cast("timestamp")
    return seen.where(at.isNull() | (at >= F.lit(now - dt.timedelta(days=days))))


def read_state(spark, path: str, schema: str) -> DataFrame:
    """The last version that was committed.  A path that was never written is empty state; one that holds versions but no commit raises.

    State of the older layout, whose file ``current`` names the version, is read as well.
    """
    files = Files(spark)
    newest = Commits(spark, path, files).newest()
    if newest:
        version = newest[1]["version"]
    elif files.exists(f"{path}/current"):
        version = spark.read.text(f"{path}/current").orderBy(F.desc("value")).first()["value"]
    elif any(name.startswith("v=") for name, _ in files.names(path)):
        raise StateError(f"{path} holds versions but no commit")
    else:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={version}")


def write_state(df: DataFrame, path: str, version: str, files: Files | None = None) -> None:
    """Write a version and commit it; until the commit readers find the one before, and of two writers at once one fails."""
    commits = Commits(df.sparkSession, path, files)
    number = max(commits.numbers(), default=0) + 1
    df.write.mode("errorifexists").parquet(f"{path}/v={version}")
    commits.add(number, {"version": version})
