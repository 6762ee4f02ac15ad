"""A Merkle manifest of a table, with the proof of every row, by a butterfly exchange.

Each source is a tree over its rows by doc_id, and the sources' roots are the leaves of one
more tree.  Rows get their places by a range partitioning and running counts of partitions,
and are dealt into blocks of ``fanout ** 3`` consecutive ones of a source.  Each block makes the
root of its own subtree; then the blocks exchange roots round by round:

* in round r the 16 neighbouring groups of ``16 ** r`` blocks that form the next larger group
  swap their roots: a block sends its group's to the block at its own offset in each
  other group (in a group with fewer blocks, offsets repeat), and gets one from each;
* every block then hashes the parent itself, as all others of the larger group do, and so
  keeps what stands left and right of its own group: the proof grows by one step;
* after the rounds inside a source, groups of sources do the same up to the root.

So each block ends with the root and its rows' proof above itself, and nothing travels back
down.  A round is one shuffle of 16 small rows a block; their count is the logarithm of
the count of blocks.  At last each block meets its rows again and makes their proofs.

Edge cases: null values are hashed as ``-``; a null source is a source, the first; null doc_ids come
before others; rows that repeat a doc_id in a source are ordered by their hash; rows alike in
all are told apart by their place in the input, which no hash depends on; a source of one
row has its leaf as subroot; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint, shuffle_partitions

FANOUT = 16
#: levels of the tree that one block makes alone
BLOCK_LEVELS = 3
#: rows of counts (of partitions, of sources) up to which they are broadcast; beyond, Spark joins them as it does others
BROADCAST_COUNTS = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """``-`` for null, else the count of its UTF-8 bytes, a colon and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_hash(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(encoded(values[c]) for c in COLUMNS)), 256)


def _small(df: DataFrame) -> DataFrame:
    """A checked-in table of counts, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_COUNTS else df


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


# --- places ------------------------------------------------------------------------


def placed(leaves: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (source, doc_id, leaf, ``__at``, ...) with i, their place in the source (from 0), and block, numbered over all sources; and the sources.

    Both have t (rank of the source), n (its rows), blocks and first_block.
    """
    at_row = F.monotonically_increasing_id()
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "__at"]
    sorted_rows = leaves.repartitionByRange(shuffle_partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
    rows = checkpoint(sorted_rows.withColumn("g", at_row).withColumn("p", F.shiftright("g", 33).cast("int")))
    # One row for each partition and source in it: the place where the source begins there, and how many are before.
    parts = rows.groupBy("p", "source").agg(F.count("*").alias("own"), F.min("g").alias("from_g"))
    before = F.sum("own").over(Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = checkpoint(parts.withColumn("before", F.coalesce(before, F.lit(0))))
    sources = parts.groupBy("source").agg(F.sum("own").alias("n"), F.min("from_g").alias("from_g"))
    sources = sources.withColumn("p", F.shiftright("from_g", 33).cast("int")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
    # Sources and their blocks are numbered in the same two steps: within a partition, and by running sums over the partitions.
    sums = sources.groupBy("p").agg(F.count("*").alias("t0"), F.sum("blocks").alias("b0"))
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.select("p", F.coalesce(F.sum("t0").over(upto), F.lit(0)).alias("t0"), F.coalesce(F.sum("b0").over(upto), F.lit(0)).alias("b0"))
    within = Window.partitionBy("p").orderBy("from_g").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.join(_small(checkpoint(sums)), "p").select(
        "source", "n", "blocks", (F.col("t0") + F.count("*").over(within)).alias("t"), (F.col("b0") + F.coalesce(F.sum("blocks").over(within), F.lit(0))).alias("first_block"),
    )
    sources = checkpoint(sources)
    known = parts.join(_small(sources.select(F.col("source").alias("__s"), "t", "n", "blocks", "first_block")), _same("source", "__s"))
    known = checkpoint(known.select(F.col("p").alias("__p"), "__s", "n", "blocks", "first_block", "t", "before", "from_g"))
    found = rows.join(_small(known), (F.col("p") == F.col("__p")) & _same("source", "__s"))
    i = F.col("g") - F.col("from_g") + F.col("before")
    block = F.col("first_block") + F.floor(i / block_rows)
    return found.withColumn("i", i).withColumn("block", block).drop("g", "p", "__p", "__s", "before", "from_g", "__at"), sources


# --- the exchange ------------------------------------------------------------------


def swapped(state: DataFrame) -> DataFrame:
    """One round: every block gets the root of each group in ``groups`` and hashes their parent.

    ``state`` has block, root, befores, afters (the proof so far), groups (array of first
    block and size of at most :data:`FANOUT` neighbouring groups) and own, the place (from 0) of its own one.
    """
    carried = [c for c in state.columns if c not in ("block", "root", "groups")]
    mine = F.get("groups", F.col("own"))
    offset = F.col("block") - mine["first"]
    to = F.transform(
        "groups",
        lambda g: F.when(offset < g["size"], F.sequence(g["first"] + offset, g["first"] + g["size"] - 1, mine["size"])).otherwise(F.array().cast("array<bigint>")),
    )
    sent = state.withColumn("to", F.explode(F.flatten(to))).select(
        F.col("to").alias("block"), F.struct(F.col("own").alias("from"), "root").alias("said"), F.when(F.col("to") == F.col("block"), F.struct(*carried)).alias("kept")
    )
    # At most FANOUT rows a block; one of them is its own.
    got = sent.groupBy("block").agg(F.sort_array(F.collect_list("said")).alias("run"), F.first("kept", ignorenulls=True).alias("kept")).select("block", "run", "kept.*")
    roots = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["root"]), "")
    return got.select(
        "block", F.sha2(roots(lambda x: F.lit(True)), 256).alias("root"), *(c for c in carried if c not in ("befores", "afters", "own")),
        F.array_append("befores", roots(lambda x: x["from"] < F.col("own"))).alias("befores"), F.array_append("afters", roots(lambda x: x["from"] > F.col("own"))).alias("afters"),
    )


def butterfly(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``blocks`` (block, t, first_block, blocks, root) with subroot, root, and the proof above them: befores and afters, level by level."""
    most = sources.agg(F.max("blocks").alias("blocks"), F.count("*").alias("sources")).first()
    none = F.array().cast("array<string>")
    state = checkpoint(blocks.withColumn("befores", none).withColumn("afters", none))
    width = 1
    while width < (most["blocks"] or 0):
        place = F.col("block") - F.col("first_block")
        group = F.floor(place / (FANOUT * width)) * FANOUT * width + F.col("first_block")
        end = F.col("first_block") + F.col("blocks")
        groups = F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda j: F.struct((group + j * width).alias("first"), F.least(F.lit(width), end - group - j * width).alias("size")))
        joined = state.where(F.col("blocks") > width).select(
            "*", F.filter(groups, lambda g: g["size"] > 0).alias("groups"), F.pmod(F.floor(place / width), F.lit(FANOUT)).cast("int").alias("own")
        )
        done = state.where(F.col("blocks") <= width)
        state = checkpoint(done.unionByName(swapped(joined)))
        width *= FANOUT
    state = state.withColumn("subroot", F.col("root"))
    width = 1
    while width < (most["sources"] or 0):
        # Groups of sources and, joined to each block, those that make the next larger one.
        larger = lambda c: F.floor(F.col(c) / (FANOUT * width))
        groups = sources.groupBy(F.floor(F.col("t") / width).alias("u")).agg(F.min("first_block").alias("first"), F.sum("blocks").alias("size"))
        runs = groups.groupBy(F.floor(F.col("u") / FANOUT).alias("larger")).agg(F.sort_array(F.collect_list(F.struct("first", "size"))).alias("groups"))
        joined = state.withColumn("larger", larger("t")).join(_small(checkpoint(runs)), "larger").drop("larger")
        state = checkpoint(swapped(joined.withColumn("own", F.pmod(F.floor(F.col("t") / width), F.lit(FANOUT)).cast("int"))))
        width *= FANOUT
    return state


# --- inside a block ------------------------------------------------------------------


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return next(k for k in range(64) if FANOUT**k >= n)


def climbed(leaves: list[str], n: int, block_levels: int) -> list[list[str]]:
    """The levels of a block's subtree, its leaves first, its root last, in a tree of ``n`` leaves."""
    levels = [leaves]
    for _ in range(min(block_levels, levels_of(n))):
        below = levels[-1]
        levels.append([_digest("".join(below[a : a + FANOUT])) for a in range(0, len(below), FANOUT)])
    return levels


def proof_in_block(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of the i-th leaf and its ancestors in their runs."""
    steps = []
    for level in levels[:-1]:
        first = i - i % FANOUT
        steps.append(("".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])))
        i //= FANOUT
    return steps


def folded(node: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        node = _digest(before + node + after)
    return node


def _leaves(docs: DataFrame, tampered: Column | None) -> DataFrame:
    """source, doc_id, leaf and, where the text is tampered with, the leaf of that."""
    values = {c: F.col(c) for c in COLUMNS}
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_hash(values | {"text": tampered}))
    made = docs.select("source", "doc_id", leaf_hash(values).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("__at"))
    return checkpoint(made)


def _proved(docs: DataFrame, tampered: Column | None, block_levels: int, make, schema: str) -> DataFrame:
    """``make`` applied to the rows of each block, with their proofs."""
    block_rows = FANOUT**block_levels
    rows, sources = placed(_leaves(docs, tampered), block_rows)
    rows = rows.select("block", "i", "n", "t", "first_block", "blocks", "source", "doc_id", "leaf", "tampered")

    def root(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("i")
        one = block[["block", "t", "first_block", "blocks"]].iloc[:1].copy()
        one["root"] = climbed(block["leaf"].tolist(), int(block["n"].iloc[0]), block_levels)[-1]
        return one

    roots = rows.drop("source", "doc_id", "tampered").groupBy("block").applyInPandas(root, "block long, t long, first_block long, blocks long, root string")
    above = butterfly(roots, sources)

    def proofs(block: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        block, up = block.sort_values("i").reset_index(drop=True), up.iloc[0]
        levels = climbed(block["leaf"].tolist(), int(block["n"].iloc[0]), block_levels)
        higher = list(zip(up["befores"], up["afters"], strict=True))
        return make(block, [proof_in_block(levels, i) + higher for i in range(len(block))], up["subroot"], up["root"])

    return rows.select("block", "i", "n", "source", "doc_id", "leaf", "tampered").groupBy("block").cogroup(above.groupBy("block")).applyInPandas(proofs, schema)


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """source, doc_id, leaf, subroot, root and proof of every row.

    The proof lists, from the leaf up, what to put before and after a node to hash its parent.
    """

    def make(block: pd.DataFrame, steps: list, subroot: str, root: str) -> pd.DataFrame:
        said = [[{"before": b, "after": a} for b, a in s] for s in steps]
        return block[["source", "doc_id", "leaf"]].assign(subroot=subroot, root=root, proof=said)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return _proved(docs, None, block_levels, make, f"source string, doc_id {doc_id}, leaf string, subroot string, root string, proof array<struct<before: string, after: string>>")


def verified(docs: DataFrame, tampered: Column, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (all siblings, from the leaf up), folded_root and verified of every row.

    ``tampered`` is the text to check instead of the row's; where it is null the row's own text is checked.
    """

    def make(block: pd.DataFrame, steps: list, subroot: str, root: str) -> pd.DataFrame:
        checked = block["tampered"].where(block["tampered"].notna(), block["leaf"])
        ends = [folded(x, s) for x, s in zip(checked, steps, strict=True)]
        proof = [_digest("".join(b + a for b, a in s)) for s in steps]
        return block[["doc_id", "leaf"]].assign(subroot=subroot, root=root, proof_sha256=proof, folded_root=ends, verified=[e == root for e in ends])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _proved(docs, tampered, block_levels, make, schema)


def lower_cased() -> Column:
    """The contract's tampering: texts of doc_ids whose CRC-32 5 divides, in lower case (A-Z alone); null elsewhere."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return F.when(hit, F.translate("text", CAPITALS, SMALL))


#: The same rows in SQL (for DuckDB), which has no CRC-32 and gets it bit by bit.
SQL = r"""
WITH RECURSIVE coded AS (
  SELECT source, doc_id, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(4294967295 - list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))) , 1) % 5 = 0 AS hit
  FROM documents),
leaves AS (
  SELECT row_number() OVER () AS r, source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM coded),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree(t, level, i, h, n) AS (
  SELECT t, 0, i, leaf, n FROM ranked
  UNION ALL
  SELECT t, any_value(level) + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM tree WHERE n > 1 GROUP BY t, i // 16),
subroots AS (SELECT t, h, level AS depth FROM tree WHERE n = 1),
top(level, i, h, n) AS (
  SELECT 0, t, h, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY i // 16),
beside AS (
  SELECT 1 AS upper, -1 AS t, level, i,
         coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
         coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM top WHERE n > 1
  UNION ALL
  SELECT 0, t, level, i,
         coalesce(string_agg(h, '') OVER (PARTITION BY t, level, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
         coalesce(string_agg(h, '') OVER (PARTITION BY t, level, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM tree WHERE n > 1),
steps AS (
  SELECT r, upper * 100 + level AS step, b, a FROM ranked JOIN beside ON upper = 0 AND beside.t = ranked.t AND beside.i = ranked.i // (16 ** level)::BIGINT
  UNION ALL
  SELECT r, 100 + level, b, a FROM ranked JOIN beside ON upper = 1 AND beside.i = ranked.t // (16 ** level)::BIGINT),
numbered AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS k, b, a FROM steps),
fold(r, k, node) AS (
  SELECT r, 0, coalesce(other, leaf) FROM ranked
  UNION ALL
  SELECT fold.r, fold.k + 1, sha256(b || node || a) FROM fold JOIN numbered ON numbered.r = fold.r AND numbered.k = fold.k + 1),
ends AS (SELECT r, arg_max(node, k) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(b || a, '' ORDER BY k) AS p FROM numbered GROUP BY r),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroots.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked JOIN subroots USING (t) JOIN ends USING (r) LEFT JOIN proofs USING (r), root
"""
