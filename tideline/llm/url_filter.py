"""URL filters: listed rules first, then a path-template tree for each host.

Paths are cut into segments.  Segments of a fixed shape (numbers, hexadecimal ids, dates)
are wildcards from the start; level by level, a branch with more than ``max_children``
children gives up those that are rare in it to a wildcard, and sibling branches whose
labelled purity cannot be told apart (a two-proportion test against the other siblings)
and that go on alike are merged.  A template's purity is the share of good labels,
smoothed by the share over all labels; labelled templates below ``least_purity`` are
rejected.  Segments beyond ``depth`` stay as they are, so branches that part below it are
told apart too.

Only DataFrame expressions, joins and aggregations are used.  The tree is built over
counts by (host, path of shapes), never over rows, and the rows meet their verdict in one
join, which Spark may split where a host is hot; it is a broadcast only if the verdicts
are counted to be few.

Edge cases: a null url, or one without ``://``, has an empty host and path and forms a
tree of its own; templates without labels have the purity of all labels and are not
rejected; equal purities have one verdict; a url of any length is read whole; repeated
pages are counted and judged each; an empty table, or one without labels, is allowed: then
nothing is rejected; columns beside page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import checkpoint

#: (allow or block, rule) as given by the query's contract; a rule is a host and the start of a path
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
BROADCAST_TEMPLATES = 20_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, rule in rules:
        rule_host, _, rest = rule.partition("/")
        start = "/" + rest
        ok = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def shape(segment: Column) -> Column:
    """The segment, or a wildcard for its shape."""
    return (
        F.when(segment.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.lit("{date}"))
        .when(segment.rlike(r"^\d+$"), F.lit("{n}"))
        .when(segment.rlike(r"^(?=.*\d)[0-9a-f-]{8,}$"), F.lit("{id}"))
        .when(segment.rlike(r"\d"), F.regexp_replace(segment, r"\d+", "{n}"))
        .otherwise(segment)
    )


def templates(
    counts: DataFrame, max_children: int = 16, rare: float = 0.05, z: float = 1.96, depth: int = 8
) -> DataFrame:
    """(host, shapes) -> template, for ``counts`` (host, shapes, n, good, bad)."""
    tree = counts.select("host", "shapes", "n", "good", "bad", F.lit("").alias("template"))
    deepest = counts.agg(F.max(F.size("shapes"))).first()[0] or 0
    for level in range(1, min(depth, deepest) + 1):
        child = F.get("shapes", F.lit(level - 1))
        at = tree.withColumn("child", child).withColumn("next", F.coalesce(F.get("shapes", F.lit(level)), F.lit("")))
        labelled = F.col("good") + F.col("bad")
        branches = checkpoint(
            at.where("child IS NOT NULL")
            .groupBy("host", "template", "child")
            .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max(F.when(F.col("next").startswith("{"), F.col("next")).otherwise(F.lit(""))).alias("on"))
        )
        # Sums over siblings are aggregated and joined back: no task meets all children of a branch.
        siblings = branches.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("total"))
        alike = branches.groupBy("host", "template", "on").agg(F.sum("good").alias("all_good"), F.sum(labelled).alias("all_labelled"))
        beside = branches.join(siblings, ["host", "template"]).join(alike, ["host", "template", "on"])
        others, others_good = F.col("all_labelled") - labelled, F.col("all_good") - F.col("good")
        pooled = F.try_divide(F.col("all_good"), F.col("all_labelled"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), others) + F.try_divide(F.lit(1.0), labelled)))
        apart = F.abs(F.try_divide(F.col("good"), labelled) - F.try_divide(others_good, others))
        same = F.when((labelled >= 10) & (others >= 10), apart <= z * spread).otherwise(False)
        renamed = (
            F.when(F.col("child").startswith("{"), F.col("child"))
            .when((F.col("children") > max_children) & (F.col("n") < rare * F.col("total")), F.lit("{*}"))
            .when(same, F.concat(F.lit("{~"), F.col("on"), F.lit("}")))
            .otherwise(F.col("child"))
        )
        names = beside.select("host", "template", "child", renamed.alias("name"))
        tree = checkpoint(
            at.join(names, ["host", "template", "child"], "left").select(
                "host", "shapes", "n", "good", "bad",
                F.when(F.col("name").isNotNull(), F.concat_ws("/", "template", "name")).otherwise(F.col("template")).alias("template"),
            )
        )
    deeper = F.slice("shapes", F.lit(depth + 1), F.greatest(F.size("shapes") - depth, F.lit(0)))
    return tree.withColumn("template", F.concat_ws("/", "template", deeper))


def judge(
    pages: DataFrame, labels: DataFrame, rules=RULES, least_purity: float = 0.5, prior: float = 10.0, **options
) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of ``pages``.

    ``labels`` has page_id and good (boolean, null: no label).
    """
    url = F.col("url")
    rows = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("shapes", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), shape))
    seen = labels.where("good IS NOT NULL").groupBy("page_id").agg(F.avg(F.col("good").cast("double")).alias("good"))
    counts = (
        rows.join(seen, "page_id", "left")
        .groupBy("host", "shapes")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum(1 - F.col("good")), F.lit(0.0)).alias("bad"))
    )
    tree = templates(checkpoint(counts), **options)
    overall = tree.agg(F.try_divide(F.sum("good"), F.sum(F.col("good") + F.col("bad"))).alias("p")).first()["p"]
    overall = 1.0 if overall is None else overall
    purity = tree.groupBy("host", "template").agg(
        (F.sum(F.col("good") + F.col("bad")) > 0).alias("labelled"), ((F.sum("good") + prior * overall) / (F.sum(F.col("good") + F.col("bad")) + prior)).alias("purity"),
    )
    known = checkpoint(tree.select("host", "shapes", "template").join(purity, ["host", "template"]))
    known = known.select(F.col("host").alias("__h"), F.col("shapes").alias("__s"), "template", "purity", "labelled")
    if known.count() <= BROADCAST_TEMPLATES:
        known = F.broadcast(known)
    best = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("labelled") & (F.col("purity") < least_purity), F.lit("block")).otherwise(F.lit("allow"))
    return (
        rows.join(known, (F.col("host") == F.col("__h")) & (F.col("shapes") == F.col("__s")), "left")
        .withColumn("b", best)
        .select(
            "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", own).alias("verdict"),
            "template", F.round("purity", 9).alias("purity"),
        )
    )
