"""User-level pipelines over the operators."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import keywords, reports, screens, state


@dataclass
class RunResult:
    """What one incremental run sends, defers and records."""

    notify: DataFrame
    deferred: DataFrame
    silent: DataFrame
    seen: DataFrame
    groups: DataFrame


def _matched(postings: DataFrame, region: dict, settings: dict, names: DataFrame | None) -> DataFrame:
    found = screens.match_postings(postings, region, settings, names)
    return found.where(F.col("outcome").isin(*screens.MATCHED)).withColumn("tier", screens.tier(F.col("sponsorship_flag"), F.col("outcome")))


def outcome_counts(postings: DataFrame, region: dict, settings: dict, names: DataFrame | None = None) -> DataFrame:
    """How many postings had each outcome."""
    return screens.match_postings(postings, region, settings, names).groupBy("outcome").agg(F.count("*").alias("n"))


def incremental_run(
    postings: DataFrame, seen: DataFrame, groups: DataFrame, region: dict, settings: dict, now: dt.datetime, names: DataFrame | None = None
) -> RunResult:
    """Match, drop what was seen, keep new groups silent, cap the rest and record what is sent.

    ``postings`` carries ``ord``, its arrival order.  Deferred rows are not recorded, so the
    next run finds them again; groups count as known once fetched, matched or not.
    """
    if postings.isEmpty():
        raise ValueError("no postings; saved state stays as it is")
    new = state.checkpoint(state.split_new(_matched(postings, region, settings, names), seen, groups))
    loud, silent = new.where("NOT silent"), new.where("silent")
    cap = settings.get("max_notifications_per_run", 0)
    sent = state.newest(loud, cap, by=settings.get("order", "chronological")) if cap else loud
    sent = state.checkpoint(sent)
    deferred = loud.join(sent.select("id"), "id", "left_anti")
    recorded = state.upsert_seen(state.upsert_seen(seen, sent, now), silent, now, True)
    return RunResult(sent, deferred, silent, state.prune(recorded, settings.get("prune_days", 0), now), state.mark_groups(groups, postings))


def board(
    postings: DataFrame, seen: DataFrame, region: dict, settings: dict, now: dt.datetime, names: DataFrame | None = None, days: int = 0, new_hours: int = 24
) -> DataFrame:
    """Board rows, newest first: every match, unknown sponsorship included."""
    matched = _matched(postings, region, {**settings, "allow_unknown": True}, names)
    kept = reports.max_age(state.greedy_dedupe(matched, "id", "ats_key", "ord"), days, now.date())
    flagged = reports.with_new_flag(kept, seen.select("id", "first_seen"), now, new_hours)
    return flagged.orderBy(F.col("date_posted").desc_nulls_last(), "ord")


def backlog(
    postings: DataFrame, seen: DataFrame, region: dict, settings: dict, cutoff: dt.date, names: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Seen and still live rows since ``cutoff`` by group, and the count of recorded ids no longer live."""
    matched = _matched(postings, region, {**settings, "allow_unknown": True}, names)
    order = {"confirmed": 0, "region": 1, "listed": 2, "unverified": 3}
    return reports.backlog(matched, seen, cutoff, order), reports.missing_count(seen, matched.select("id").distinct())


def health(seen: DataFrame, runs: DataFrame, now: dt.datetime, **options) -> DataFrame:
    """One row: records tracked, new in seven days (silent ones apart), and the health of the runs."""
    at = F.col("first_seen").try_cast("timestamp")
    recent = (at >= F.lit(now - dt.timedelta(days=7))) & ~F.coalesce("seeded", F.lit(False))
    tracked = seen.agg(F.count("*").alias("tracked"), F.count_if(recent).alias("new_week"))
    return tracked.join(reports.run_health(runs, **options), F.lit(True))  # one row each


def coverage_report(boards: DataFrame, baseline: DataFrame, now: dt.datetime) -> DataFrame:
    """Coverage of each board against the baseline, with the rows of the last seven days."""
    return reports.coverage(boards, baseline, (now - dt.timedelta(days=7)).date())


def title_screened_snapshot(rows: DataFrame, companies: DataFrame, options: dict) -> tuple[DataFrame, DataFrame]:
    """Rows of a tagged snapshot that pass, and the count of each drop reason."""
    found = screens.screen_tagged(
        rows, companies, options.get("roles", ()), options.get("exclude_seniority", ()), options.get("senior_terms"), options.get("require", ())
    )
    return found.where("drop_reason IS NULL").drop("drop_reason"), found.groupBy("drop_reason").agg(F.count("*").alias("n"))


def document_match(docs: DataFrame, variant_keywords: DataFrame, vocab, aliases, taxonomy) -> DataFrame:
    """Match percent of each document with a bank of variants.

    Only terms that a document names count, so what ``taxonomy`` infers beside them, and their evidence, is not made.
    """
    found = keywords.exact_keywords(docs, vocab, aliases, evidence=False)
    return keywords.match_percent(keywords.covers(found, variant_keywords))
