"""Quality rules with adaptive thresholds.

Each document gets counts from its whole text.  Ratios of those counts are summarised per
(lang, source) in mergeable quantile sketches, and a ratio's thresholds are fences beyond
the quantiles of its own group, so no fixed cutoff has to suit every language and source.

A sketch counts values by logarithmic buckets: bucket b holds values from GAMMA^b up to
GAMMA^(b + 1), so a quantile is off by half a per cent at most.  Sketches are merged by
adding counts; they depend neither on the order nor on the partitioning of the rows, so
reruns agree.  Group sketches are merged to languages, and those to the whole.  On the
scale of logarithms the fences are q80 + times * d and q20 - times * d, where d is the
larger of q80 - q50 and q50 - q20, so that copies of one text that make up most of one
side do not narrow them.  A group's quantiles are drawn towards those of its language, and
these towards the whole, with the weight of ``prior`` documents: small groups follow their
parents, large ones themselves, without a switch in between.  Ratios are smoothed by half
a count, so that a text without a symbol counts for as much as its length tells.

Edge cases: a null or empty text has no words and fails the base rule; null ``lang``
or ``source`` form groups of their own; a group all of whose documents fail the base rule
has its parents' fences; repeated rows are judged alike; equal values share a bucket and a
verdict; an empty table gives an empty result; columns of the input that clash with the
names made here are left out of the counts and untouched by :func:`apply_rules`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import checkpoint
from tideline.llm.textops import Block, blocks, mix

U = np.uint64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: ratio -> (how many times the distance of the quantiles its fences lie beyond them, the count it is made of: only upwards; or none: both ways)
RULES = {
    "symbols_per_word": (4.0, "n_symbols"),
    "dup_line_share": (2.0, "n_dup_lines"),
    "repeat_word_share": (5.0, "n_repeat_words"),
    "chars_per_word": (5.0, None),
}
#: guards of groups whose texts are all alike: the least distance of quantiles (on the scale of logarithms), and counts that never fail a text
LEAST_DISTANCE, LEAST_COUNT = 0.02, 2
#: distances are (1 + FEW / documents) times as wide, since quantiles of a handful tell little
FEW = 20.0
#: the inner and the outer quantile, counted from the middle outwards
MIDDLE, OUTER = 0.5, 0.8
GAMMA = 1.01
PRIOR = 200.0


def _sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def counts_of(block: Block) -> dict[str, np.ndarray]:
    """The counts of every text of a block."""
    doc_salt = mix(np.arange(1, block.n + 1, dtype=np.uint64))
    out = {"n_words": block.n_words}
    out["word_chars"] = block.per_doc(block.solid & ((block.data & 0xC0) != 0x80))
    out["n_symbols"] = block.per_doc(_SYMBOL[block.data])

    lines, doc, wordy = block.line_hashes()
    keys, doc = (lines[wordy] ^ doc_salt[doc[wordy]]), doc[wordy]
    order, sorted_keys = _sorted_groups(keys)
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = sorted_keys[1:] == sorted_keys[:-1]
    out["n_dup_lines"] = np.bincount(doc[again], minlength=block.n)
    out["n_lines"] = np.bincount(doc, minlength=block.n)

    triples, at = block.windows(block.word_hashes(), 3)
    order, sorted_keys = _sorted_groups(triples ^ doc_salt[block.doc_of_word[at]])
    same = sorted_keys[1:] == sorted_keys[:-1]
    found = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
    covered = np.zeros(len(block.starts), dtype=bool)
    for i in range(3):
        covered[found + i] = True
    out["n_repeat_words"] = np.bincount(block.doc_of_word[covered], minlength=block.n)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch and, as a struct, the counts of its last column, the text."""
    for batch in batches:
        for block in blocks(batch.column(batch.num_columns - 1)):
            counts = counts_of(block)
            made = pa.StructArray.from_arrays([pa.array(counts[c], type=pa.int64()) for c in COUNTS], list(COUNTS))
            own = [x.slice(block.first, block.n) for x in batch.columns]
            yield pa.RecordBatch.from_arrays([*own, made], [*batch.schema.names, "__counts"])


def with_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, ``__text`` and the struct ``__counts``, in one pass over the texts."""
    given = docs.select(*columns, F.col("text").alias("__text"))
    schema = T.StructType([*given.schema.fields]).add("__counts", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
    return given.mapInArrow(_count_batches, schema)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    return with_counts(docs, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "__counts.*")


def ratios() -> dict[str, Column]:
    """Smoothed ratios, all above 0."""
    more = lambda c: F.col(c) + 1.0
    return {
        "symbols_per_word": (F.col("n_symbols") + 0.5) / more("n_words"),
        "dup_line_share": (F.col("n_dup_lines") + 0.5) / more("n_lines"),
        "repeat_word_share": (F.col("n_repeat_words") + 0.5) / more("n_words"),
        "chars_per_word": (F.col("word_chars") + 0.5) / more("n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(values: DataFrame, keys: list[str], gamma: float = GAMMA) -> DataFrame:
    """Quantile sketches of ``value`` (above 0) by ``keys``: a row (keys, bucket, n) for each bucket that occurs."""
    bucket = F.floor(F.log("value") / math.log(gamma)).cast("int")
    return values.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], of: dict[str, float], gamma: float = GAMMA) -> DataFrame:
    """keys, size and, for each name of ``of``, the logarithm of that quantile.

    The window runs over the buckets of one sketch, some thousands at most whatever the rows.
    """
    upto = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("size"), F.col("bucket")))
    return ranked.groupBy(*keys).agg(F.first("size").alias("size"), *(((at(q) + 0.5) * math.log(gamma)).alias(name) for name, q in of.items()))


def thresholds(counts: DataFrame, rules: dict = RULES, prior: float = PRIOR) -> DataFrame:
    """One row per (lang, source): the fence ``t_<ratio>`` above each ratio, and ``l_<ratio>`` below those that have two.

    Sketches are made over every document that passes the base rule.
    """
    made = ratios()
    values = (
        counts.where(~base_failed())
        .select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), made[r].alias("value")) for r in rules))).alias("x"))
        .select("lang", "source", "x.*")
    )
    own = checkpoint(sketches(values, ["lang", "source", "rule"]))
    of_lang = merged(own, ["lang", "rule"])
    names = {"low": 1 - OUTER, "mid": MIDDLE, "high": OUTER}

    def level(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
        found = quantiles(sketch, keys, names)
        return found.select(*(F.col(k).alias(f"{tag}_{k}") for k in keys), *(F.col(c).alias(f"{tag}_{c}") for c in ("size", *names)))

    a, b, c = level(own, ["lang", "source", "rule"], "own"), level(of_lang, ["lang", "rule"], "lang"), level(merged(of_lang, ["rule"]), ["rule"], "all")
    every = counts.select("lang", "source").distinct().select("*", F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    joined = (
        every.join(a, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")) & (F.col("rule") == F.col("own_rule")), "left")
        .join(b, F.col("lang").eqNullSafe(F.col("lang_lang")) & (F.col("rule") == F.col("lang_rule")), "left")
        .join(F.broadcast(c), F.col("rule") == F.col("all_rule"), "left")  # one row a rule
    )

    def drawn(name: str) -> Column:
        """The group's quantile drawn towards its language's, and that towards the whole."""
        q = F.col(f"all_{name}")
        for tag in ("lang", "own"):
            n = F.coalesce(F.col(f"{tag}_size"), F.lit(0))
            q = (n * F.coalesce(F.col(f"{tag}_{name}"), F.lit(0.0)) + prior * q) / (n + prior)
        return q

    q = joined.select("lang", "source", "rule", "all_size", *(drawn(n).alias(n) for n in names))
    times = F.element_at(F.create_map(*(x for r, (k, _) in rules.items() for x in (F.lit(r), F.lit(float(k))))), F.col("rule"))
    apart = times * F.greatest(F.col("high") - F.col("mid"), F.col("mid") - F.col("low"), F.lit(LEAST_DISTANCE))
    apart = apart * (1 + FEW / F.col("all_size"))
    upper, lower = F.exp(F.col("high") + apart), F.exp(F.col("low") - apart)
    pick = lambda r, c: F.max(F.when(F.col("rule") == r, c))
    return q.groupBy("lang", "source").agg(
        *(pick(r, upper).alias(f"t_{r}") for r in rules), *(pick(r, lower).alias(f"l_{r}") for r, (_, count) in rules.items() if count is None)
    )


def failed(rules: dict = RULES) -> Column:
    """The ratios of the row that lie beyond their group's fences."""
    made = ratios()

    def beyond(r: str) -> Column:
        count, out = rules[r][1], made[r] > F.col(f"t_{r}")
        out = out & (F.col(count) > LEAST_COUNT) if count else out | (made[r] < F.col(f"l_{r}"))
        return F.coalesce(out, F.lit(False))

    return F.filter(F.array(*(F.when(beyond(r), F.lit(r)) for r in rules)), lambda x: x.isNotNull())


def _join_limits(rows: DataFrame, limits: DataFrame, broadcast_rows: int) -> DataFrame:
    """Left join of the fences; they are broadcast only if counted to be few."""
    limits = limits.withColumnsRenamed({"lang": "__l", "source": "__s"})
    if limits.count() <= broadcast_rows:
        limits = F.broadcast(limits)
    return rows.join(limits, rows["lang"].eqNullSafe(F.col("__l")) & rows["source"].eqNullSafe(F.col("__s")), "left")


def judge(docs: DataFrame, rules: dict = RULES, prior: float = PRIOR, broadcast_rows: int = 20_000) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and ``failed`` (ratios beyond their fences) of every row of ``docs``."""
    counts = checkpoint(text_counts(docs))
    limits = checkpoint(thresholds(counts, rules, prior))
    joined = _join_limits(counts, limits, broadcast_rows).withColumn("failed", failed(rules))
    return joined.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & (F.size("failed") == 0)).alias("kept"), "lang", "source", "failed"
    )


def apply_rules(docs: DataFrame, rules: dict = RULES, prior: float = PRIOR, broadcast_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only.

    The texts are counted twice, once for the sketches and once beside the rows, so
    that no text is shuffled or stored for the join.
    """
    counts = checkpoint(text_counts(docs))
    limits = checkpoint(thresholds(counts, rules, prior))
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("lang", "source", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__row"), "text")
    rows = with_counts(packed, ["lang", "source", "__row"]).select("lang", "source", "__row", "__text", "__counts.*")
    kept = _join_limits(rows, limits, broadcast_rows).where(~base_failed() & (F.size(failed(rules)) == 0))
    return kept.select(*(F.col("__text").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
