"""Boards, backlog, coverage, health and notifications over matched rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_new_flag(rows: DataFrame, seen: DataFrame, now: dt.datetime, hours: int) -> DataFrame:
    """``is_new``: first seen no more than ``hours`` ago."""
    at = seen.select(F.col("id").alias("__id"), "first_seen")
    recent = F.col("first_seen") >= F.lit(now - dt.timedelta(hours=hours))
    return rows.join(at, F.col("id") == F.col("__id"), "left").withColumn("is_new", F.coalesce(recent, F.lit(False))).drop("__id", "first_seen")


def max_age(rows: DataFrame, days: int, today: dt.date, date: str = "date_posted") -> DataFrame:
    """Rows no older than ``days``; undated rows stay, 0 keeps all."""
    return rows if not days else rows.where(F.col(date).isNull() | (F.col(date) >= F.lit(today - dt.timedelta(days=days))))


def parse_cutoff(text: str) -> dt.date:
    """A day written MMDDYYYY or YYYY-MM-DD."""
    for form in ("%m%d%Y", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, form).date()
        except ValueError:
            pass
    raise ValueError(f"{text!r} is no day; write MMDDYYYY or YYYY-MM-DD")


def since(rows: DataFrame, cutoff: dt.date | str, date: str = "date_posted") -> DataFrame:
    """Rows of ``cutoff`` and later; undated rows go."""
    cutoff = parse_cutoff(cutoff) if isinstance(cutoff, str) else cutoff
    return rows.where(F.col(date) >= F.lit(cutoff))


def search(rows: DataFrame, text: str, tiers, reviewed: DataFrame, columns=("company", "title", "location")) -> DataFrame:
    """Rows of the tiers, not yet reviewed, that hold ``text`` in any of the columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return rows.where(F.col("tier").isin(*tiers)).where(hay.contains(text.lower())).join(reviewed.select("id"), "id", "left_anti")


def tiles(rows: DataFrame, group: str = "tier") -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"))


def per_day(rows: DataFrame, date: str = "date_posted") -> DataFrame:
    """Rows a day; the row without a day counts the undated."""
    return rows.groupBy(F.col(date).alias("day")).agg(F.count("*").alias("n"))


def day_headings(rows: DataFrame, date: str, order: str) -> DataFrame:
    """``heading``: whether a row is the first of its day."""
    first = Window.partitionBy(date).orderBy(order)
    return rows.withColumn("heading", F.row_number().over(first) == 1)


def missing_count(seen: DataFrame, live: DataFrame) -> DataFrame:
    """How many recorded ids are no longer live."""
    return seen.select("id").join(live.select("id"), "id", "left_anti").agg(F.count("*").alias("missing"))


def backlog(rows: DataFrame, seen: DataFrame, cutoff: dt.date, order: dict[str, int]) -> DataFrame:
    """Live rows that were seen, since a day, with the rank of their group and a table line; newest first within a group."""
    first = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), "ord").alias("r")).select("id", "r.*")
    rank = F.lit(len(order))
    for name, at in order.items():
        rank = F.when(F.col("tier") == name, F.lit(at)).otherwise(rank)
    cell = lambda c, bar="/": F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(bar))
    link = F.when(F.col("url").startswith("http"), F.concat(F.lit("[apply]("), F.col("url"), F.lit(")"))).otherwise(F.lit("—"))
    day = F.coalesce(F.date_format("date_posted", "MM/dd"), F.lit("?"))
    inner = F.concat_ws(" | ", day, cell("company"), cell("title"), cell("location", " / "), link)
    line = F.concat(F.lit("| "), inner, F.lit(" |"))
    kept = since(first, cutoff).join(seen.select("id").distinct(), "id", "left_semi")
    return kept.withColumn("rank", rank).withColumn("line", line).orderBy("rank", F.col("date_posted").desc(), "ord")


def coverage(boards: DataFrame, baseline: DataFrame, week_start: dt.date) -> DataFrame:
    """Per board: jobs, in region, of those known to the baseline by key, new, of this week, and keyless baseline rows of the company.

    ``boards`` has board, company_key, key, in_region and day; ``baseline`` key and company_key.
    """
    known = baseline.where("key IS NOT NULL").select("key").distinct().withColumn("have", F.lit(1))
    keyless = baseline.where("key IS NULL").groupBy("company_key").agg(F.count("*").alias("keyless"))
    hit = F.col("in_region") & F.col("have").isNotNull()
    counts = (
        boards.join(known, "key", "left")
        .groupBy("board", "company_key")
        .agg(
            F.count("*").alias("jobs"),
            F.count_if("in_region").alias("region"),
            F.count_if(hit).alias("have"),
            F.count_if(F.col("in_region") & (F.col("day") >= F.lit(week_start))).alias("week"),
        )
    )
    return (
        counts.join(keyless, "company_key", "left")
        .select("board", "jobs", "region", "have", (F.col("region") - F.col("have")).alias("new"), "week", F.coalesce("keyless", F.lit(0)).alias("keyless"))
        .orderBy(F.desc("new"), F.desc("region"), "board")
    )


def run_health(runs: DataFrame, own=("check", "weekly"), main: str = "check", sampled: int = 8, recent: int = 5, quota: int = 2000) -> DataFrame:
    """One row on a run log (name, status, conclusion, updated_at, run_id, duration_ms).

    Longest and mean duration of own workflows among the latest ``sampled`` runs, minutes
    billed (each run rounds up) scaled to all runs, failures among the latest ``recent``
    completed main runs, a meter and a status.
    """
    seconds = F.coalesce("duration_ms", F.lit(0)) / 1000.0
    latest = runs.orderBy(F.desc("updated_at"), F.desc("run_id")).limit(sampled).withColumn("s", seconds).where("s > 0")
    billed = F.greatest(F.lit(1), F.ceil(F.col("s") / 60))
    mine = F.col("name").isin(*own)
    sample = latest.agg(
        F.max(F.when(mine, F.col("s"))).alias("max_s"), F.avg(F.when(mine, F.col("s"))).alias("avg_s"), F.avg(billed).alias("avg_billed")
    )
    last = runs.where((F.col("name") == main) & (F.col("status") == "completed")).orderBy(F.desc("updated_at"), F.desc("run_id")).limit(recent)
    done = last.agg(
        F.count_if(F.col("conclusion") == "failure").alias("failures"),
        F.max_by("conclusion", F.struct("updated_at", "run_id")).alias("last_conclusion"),
        F.max("updated_at").alias("last_at"),
    )
    total = runs.agg(F.count("*").alias("runs"))
    used = F.ceil(F.col("runs") * F.coalesce("avg_billed", F.lit(1.0))).cast("long")
    left = F.greatest(F.lit(quota) - F.col("used"), F.lit(0))
    # one row each
    row = total.join(sample, F.lit(True)).join(done, F.lit(True)).withColumn("used", used).withColumn("remaining", left)
    share = F.col("remaining") / F.lit(float(quota))
    problem = (F.col("failures") > 0) | (F.coalesce("last_conclusion", F.lit("success")) != "success") | (F.col("remaining") <= 0)
    warning = (share < 0.15) | (F.bround(F.coalesce("max_s", F.lit(0.0)), 0) > 45)
    filled = F.least(F.floor(F.bround(100.0 * F.col("used") / quota, 0) / 10), F.lit(10)).cast("int")
    return row.select(
        "runs", F.bround("max_s", 0).cast("long").alias("max_s"), F.bround("avg_s", 0).cast("long").alias("avg_s"), "used", "remaining",
        "failures", "last_conclusion", "last_at", F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), 10 - filled)).alias("meter"),
        F.when(problem, "fail").when(warning, "warn").otherwise("ok").alias("status"),
    )


# Colours and remarks of notification cards by tier.
COLOURS = {"confirmed": 0x2ECC71, "region": 0x3B88C3, "listed": 0x2ECC71, "unverified": 0xE67E22}
REMARKS = {"confirmed": "\U0001f6c2 Sponsors internationals", "listed": "\U0001f6c2 Known H-1B employer", "unverified": "\u26a0\ufe0f Sponsorship unconfirmed"}


def _by_tier(of: dict, otherwise: Column) -> Column:
    found = otherwise
    for name, value in of.items():
        found = F.when(F.col("tier") == name, F.lit(value)).otherwise(found)
    return found


def cards(rows: DataFrame) -> DataFrame:
    """``card``: title of 256 characters at most, description of 4,096, colour, footer, and the address if it is one.

    The description has the place, what is known of sponsorship, and the reason (``match_reason``
    or the tier) with the source; empty parts are left out.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    reason = F.concat(F.lit("_"), F.concat_ws(" \u00b7 ", F.coalesce(has("match_reason"), F.col("tier")), has("source_repo")), F.lit("_"))
    place = F.concat(F.lit("\U0001f4cd "), F.coalesce(F.col("location"), F.lit("Unspecified")))
    card = F.struct(
        F.substring(F.concat_ws(" \u2014 ", F.coalesce("company", F.lit("Unknown")), F.coalesce("title", F.lit("Unknown role"))), 1, 256).alias("title"),
        F.substring(F.concat_ws(" \u00b7 ", place, _by_tier(REMARKS, F.lit(None).cast("string")), reason), 1, 4096).alias("description"),
        _by_tier(COLOURS, F.lit(COLOURS["unverified"])).alias("colour"),
        F.concat(F.lit("Posted "), pretty_date(F.col("date_posted"))).alias("footer"),
        F.when(F.col("url").startswith("http"), F.col("url")).alias("url"),
    )
    return rows.withColumn("card", card)


def messages(rows: DataFrame, cap: int, size: int = 10) -> DataFrame:
    """The newest ``cap`` rows as messages of ``size`` cards each, in order."""
    from tideline.operators.state import batches, newest

    dealt = batches(cards(newest(rows, cap)), size, F.col("date_posted").desc_nulls_last(), F.col("ord"))
    return dealt.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "card"))), lambda x: x["card"]).alias("cards"))


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def pretty_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MM/dd/yyyy"), F.lit("unknown date"))


def compact_rows(rows: DataFrame) -> DataFrame:
    """The board's export: short names, the last part of the source, dates as text."""
    return rows.select(
        F.col("id").alias("i"), F.col("company").alias("c"), F.col("title").alias("t"), F.col("location").alias("l"), F.col("url").alias("u"),
        F.coalesce(F.col("date_posted").cast("string"), F.lit("")).alias("d"), F.col("tier").alias("g"),
        F.substring_index("source_repo", "/", -1).alias("s"), F.col("is_new").alias("n"),
    )
