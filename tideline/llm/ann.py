"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

An index is fitted on a bounded sample (``sample`` rows of the least hashes of their ids):
a random rotation, list centres by k-means, and the number of lists to probe, which grows
until queries of the sample find ``recall`` of their neighbours by the very scan below.  There
are lists for a quarter of the square root of the number of rows.  Where the sample has not
40 rows for each, every coarse list is divided by the same finer centres, fitted on what the
coarse ones leave over; a list is then a pair of centres, and the lists go on growing with
the table (to a square of the 500 of a full sample).  Every row is put in the list of its
nearest centres.  A query is held against the rows of its probed lists: the
rotated vectors are read in column blocks, and after each block a hypothesis test on the
partial distance abandons candidates that cannot be among the nearest so far; the distances
of those that look best then tighten the limit.  Survivors are ranked by their exact
distance on the original vectors.

Lists are dealt into cells of about ``cell`` rows by a hash of the id, and the queries that
probe a list into blocks of about ``query_block``, so a list with a third of all rows is
many tasks; each gives its best k only.

Edge cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; equal vectors tie and are ranked by id; of rows that
repeat a query's id the least vector asks, and none is its neighbour; a query that finds
fewer than k neighbours in its lists is held against eight times as many, in the end against
all; an empty table gives an
empty result; columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, hash_sample

BLOCK_DIMS = 16
#: strictness of the hypothesis test: larger keeps more candidates
EPSILON = 2.5
#: rows of the sample that measure recall
TESTS = 200


def valid(df: DataFrame) -> DataFrame:
    v = F.col("embedding")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select("vec_id", v.cast("array<double>").alias("v")).where("vec_id IS NOT NULL").where(F.coalesce(ok, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T


def _k_means(x: np.ndarray, n: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(steps):
        near = _square(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=n)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def n_lists(index: dict) -> int:
    return len(index["centres"]) * len(index["finer"])


def lists_of(index: dict, x: np.ndarray) -> np.ndarray:
    """The list of each vector: of its nearest coarse centre, and of the finer one nearest to what that leaves over."""
    near = _square(x, index["centres"]).argmin(1)
    if len(index["finer"]) == 1:
        return near
    return near * len(index["finer"]) + _square(x - index["centres"][near], index["finer"]).argmin(1)


def by_nearness(index: dict, q: np.ndarray, probes: int) -> np.ndarray:
    """For each vector the ``probes`` lists of the nearest pairs of centres, nearest first."""
    centres, finer = index["centres"], index["finer"]
    # |q - c - r|^2 without a product for each pair
    both = 2 * centres @ finer.T + (finer * finer).sum(1)
    found, rows = [np.zeros((0, probes), dtype=np.int64)], max(1, (1 << 22) // n_lists(index))
    for i in range(0, len(q), rows):
        part = q[i : i + rows]
        apart = _square(part, centres)[:, :, None] + (both[None] - 2 * (part @ finer.T)[:, None, :])
        found.append(apart.reshape(len(part), -1).argsort(1, kind="stable")[:, :probes])
    return np.concatenate(found)


def fit(rows: DataFrame, sample: int, lists: int | None, k: int, recall: float, seed: int = 11) -> dict:
    """Rotation, centres and number of probes from a sample of at most ``sample`` rows."""
    taken = hash_sample(rows, "vec_id", sample, seed).select("vec_id", "v").toArrow()
    ids, x = taken.column("vec_id").to_numpy(), _matrix(taken.column("v").combine_chunks())
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    wanted, most = lists or int(rows.count() ** 0.5 / 4), max(1, len(x) // 40)
    coarse = max(1, min(wanted, most))
    centres = _k_means(x, coarse, rng) if len(x) else np.zeros((1, dims))
    finer = np.zeros((1, dims))
    if len(x) and wanted > coarse:
        finer = _k_means(x - centres[_square(x, centres).argmin(1)], min(-(-wanted // coarse), most), rng)
    index = {"rotation": rotation, "centres": centres, "finer": finer, "dims": dims}
    every = n_lists(index)
    index["probes"] = every
    if len(x) <= k + 1:
        return index
    # Neighbours of some sampled rows, themselves left out, and in which of their lists by nearness they lie.
    at = np.arange(0, len(x), max(1, len(x) // TESTS))[:TESTS]
    apart = _square(x[at], x)
    apart[np.arange(len(at)), at] = np.inf
    truth = np.argpartition(apart, k - 1, axis=1)[:, :k]
    near = lists_of(index, x)
    order = by_nearness(index, x[at], every)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(every), order.shape), axis=1)
    needed = np.take_along_axis(rank, near[truth], axis=1)
    probes = next((p for p in range(1, every + 1) if (needed < p).mean() >= recall), every)
    turned = x @ rotation
    while probes < every:
        hit = 0
        for j, i in enumerate(at):
            there = np.flatnonzero(rank[j][near] < probes)
            found, _ = nearest(ids[there], x[there], turned[there], int(ids[i]), x[i], turned[i], k)
            hit += len(np.intersect1d(found, ids[truth[j]]))
        if hit >= recall * truth.size:
            break
        probes += max(1, probes // 4)
    return index | {"probes": min(probes, every)}


def _assign(index: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = lists_of(index, _matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    return run


def _probe(index: dict, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = by_nearness(index, _matrix(batch.column(1)), probes)
            rows = np.repeat(np.arange(len(batch)), probes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(order.ravel().astype(np.int32))],
                ["vec_id", "v", "list"],
            )

    return run


def nearest(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, query_id: int, q: np.ndarray, q_turned: np.ndarray, k: int):
    """(ids, distances) of the k nearest of ``x`` to ``q`` but for ``query_id``, by the adaptive scan."""
    dims = x.shape[1]
    other = np.flatnonzero(ids != query_id)
    if not len(other):
        return ids[:0], np.zeros(0)
    exact = lambda at: np.sqrt(((x[at] - q) ** 2).sum(1))
    kth = lambda d: np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
    limit = kth(exact(other[: 8 * k]))
    alive, partial = other, np.zeros(len(other))
    for d in range(0, dims, BLOCK_DIMS):
        partial += ((turned[alive, d : d + BLOCK_DIMS] - q_turned[d : d + BLOCK_DIMS]) ** 2).sum(1)
        seen = min(d + BLOCK_DIMS, dims)
        if seen == dims:
            break
        # Those that look nearest so far show how near the k-th of all is at most.
        if len(alive) > 2 * k:
            limit = min(limit, kth(exact(alive[np.argpartition(partial, 2 * k)[: 2 * k]])))
        # Under the hypothesis that the distance is within the limit, the scaled partial distance rarely exceeds this.
        stay = np.sqrt(partial * dims / seen) <= (1 + EPSILON / np.sqrt(seen)) * limit * (1 + 1e-9)
        alive, partial = alive[stay], partial[stay]
    if len(alive) > k:
        cut = np.sqrt(np.partition(partial, k - 1)[k - 1]) * (1 + 1e-9) + 1e-12
        alive = alive[np.sqrt(np.maximum(partial, 0)) <= cut]
    score = exact(alive)
    best = np.lexsort((ids[alive], score))[:k]
    return ids[alive][best], score[best]


def _scan(index: dict, k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks())
            q_ids, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v").combine_chunks())
            turned, q_turned = x @ index["rotation"], q @ index["rotation"]
            for i in range(len(q_ids)):
                found, score = nearest(ids, x, turned, int(q_ids[i]), q[i], q_turned[i], k)
                for column, value in zip(out, (np.full(len(found), q_ids[i]), found, score)):
                    column.append(value)
        join = lambda c, t: pa.array(np.concatenate([np.zeros(0, dtype=t), *c]).astype(t))
        return pa.table({"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], np.float64)})

    return run


def search(
    embeddings: DataFrame, is_query, k: int = 10, sample: int = 20_000, lists: int | None = None, recall: float = 0.97,
    cell: int = 16_384, query_block: int = 4_096, seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row for which ``is_query`` holds."""
    rows = valid(embeddings)
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = usual["dims"] if usual else 1
    rows = rows.where(F.size("v") == dims)
    index = fit(rows, sample, lists, k, recall, seed)
    placed = checkpoint(rows.mapInArrow(_assign(index), "vec_id long, v array<double>, list int"))
    queries = checkpoint(placed.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n_rows = placed.count()

    def run(asked: DataFrame, probes: int) -> DataFrame:
        probing = checkpoint(asked.mapInArrow(_probe(index, probes), "vec_id long, v array<double>, list int"))
        parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
        # A row goes to as many blocks as there are of queries that probe its list.
        sizes = placed.groupBy("list").agg(F.count("*").alias("rows")).join(probing.groupBy("list").agg(F.count("*").alias("asked")), "list")
        sizes = F.broadcast(sizes.select("list", parts("rows", cell).alias("cells"), parts("asked", query_block).alias("blocks")))  # one row a list
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        dealt = placed.join(sizes, "list").select("list", of("cells").alias("cell"), each("blocks").alias("block"), "vec_id", "v")
        probing = probing.join(sizes, "list").select("list", each("cells").alias("cell"), of("blocks").alias("block"), "vec_id", "v")
        keys = ["list", "cell", "block"]
        found = dealt.groupBy(keys).cogroup(probing.groupBy(keys)).applyInArrow(_scan(index, k), "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    wanted, probes = min(k, n_rows - 1), index["probes"]
    found = checkpoint(run(queries, probes))
    while probes < n_lists(index):
        full = found.groupBy("query_id").count().where(F.col("count") >= wanted).select(F.col("query_id").alias("vec_id"))
        short = checkpoint(queries.join(full, "vec_id", "left_anti"))
        if short.isEmpty():
            break
        probes = min(8 * probes, n_lists(index))
        again = run(short, probes)
        found = checkpoint(found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(again))
    return found
