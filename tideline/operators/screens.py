"""Row screens: term lists, tags, locations, curated names; the verdict keeps its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.terms import any_substring, any_term
from tideline.functions.textnorm import matching_key, normalize_text

# Codes that follow a comma in locations of the United States.
US_CODES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI "
    "SC SD TN TX UT VT VA WA WV WI WY DC PR"
).split()
US_PATTERN = rf"(?i),\s*({'|'.join(US_CODES)})\b|\b(united states|u\.?s\.?a?\.?)\b"


# Words of senior titles, where a feed's options name none.
SENIOR_TERMS = ("senior", "sr", "staff", "principal", "lead", "head", "director", "vp", "chief", "architect", "manager")


def drop_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null for rows to keep."""
    reason = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        reason = F.when(F.coalesce(fails, F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def screen(df: DataFrame, column: str, require=None, forbid=None) -> DataFrame:
    """Rows whose text has a required term (if any are given) and no forbidden one."""
    text = normalize_text(F.col(column))
    return df.where(any_term(text, require, "alnum", empty=True) & ~any_term(text, forbid, "alnum"))


def screen_tagged(
    df: DataFrame, dim: DataFrame, roles=(), exclude_seniority=(), senior_terms=None, require=()
) -> DataFrame:
    """Tagged postings with ``drop_reason``: company, role, seniority, senior_title, title or off_topic.

    ``df`` has company_slug, title, seniority and role_family; ``dim`` has slug and name.
    Missing tags are kept; the senior terms (none given: :data:`SENIOR_TERMS`) apply to rows without a seniority tag only.
    """
    senior_terms = SENIOR_TERMS if senior_terms is None else senior_terms
    title = normalize_text(F.col("title"))
    joined = df.join(dim.select(F.col("slug").alias("company_slug"), F.col("name").alias("company")), "company_slug", "left")
    rules = [
        ("company", F.col("company").isNull()),
        ("role", F.lit(bool(roles)) & F.col("role_family").isNotNull() & ~F.col("role_family").isin(*roles or ("",))),
        ("seniority", F.col("seniority").isin(*exclude_seniority or ("",))),
        ("senior_title", F.col("seniority").isNull() & any_term(title, senior_terms, "alnum")),
        ("title", title == ""),
        ("off_topic", ~any_term(title, require, "alnum", empty=True)),
    ]
    return joined.withColumn("drop_reason", drop_reason(rules))


def visible_companies(dim: DataFrame, excluded_tags=()) -> DataFrame:
    """Companies with a name of their own and no excluded tag; of rows for one slug the last (by row_ord) counts."""
    tags = F.transform(F.coalesce("industry_tags", F.array().cast("array<string>")), normalize_text)
    excluded = F.array(*(F.lit(t.lower()) for t in excluded_tags)).cast("array<string>")
    ok = (F.coalesce("slug", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "") & (F.col("name") != F.col("slug"))
    ok = ok & ~F.col("slug").startswith("via-") & ~F.arrays_overlap(tags, excluded)
    return dim.where(ok).groupBy("slug").agg(F.max_by("name", "row_ord").alias("name"))


def prefix_semi(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with ``listed``: whether the name's key equals or begins with the key of a listed name.

    Only the distinct lengths of listed keys are cut from a key, so that the theta join
    becomes an equality join.
    """
    keys = names.select(matching_key(F.col(names.columns[0])).alias("k")).where("k <> ''").distinct()
    lengths = sorted(r[0] for r in keys.select(F.length("k")).distinct().collect())  # lengths of names: a few dozen
    own = df.select(column).distinct().withColumn("k", matching_key(F.col(column)))
    cuts = F.array_distinct(F.array(*(F.substring("k", 1, n) for n in lengths))) if lengths else F.array().cast("array<string>")
    hits = own.select(column, F.explode(cuts).alias("k")).join(keys, "k", "left_semi").select(column).distinct()
    return df.join(hits.withColumn("listed", F.lit(True)), column, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def is_us(part: Column) -> Column:
    return part.rlike(US_PATTERN)


def in_region(part: Column, region: dict) -> Column:
    """Excluded substrings veto, remote substrings accept, then whole words decide."""
    text = normalize_text(part)
    terms = [*region.get("countries", ()), *region.get("cities", ())]
    if region.get("include_extra"):
        terms += region.get("extra", ())
    return (text != "") & ~any_substring(text, region.get("exclude")) & (any_substring(text, region.get("remote")) | any_term(text, terms))


def location_parts(location: Column) -> Column:
    location = F.coalesce(location, F.lit(""))
    parts = F.filter(F.transform(F.split(location, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(location))


def first_decisive(parts: Column, flag: Column, listed: Column, region_only: Column, region: dict, allow_unknown: bool) -> Column:
    """What the first decisive part says: sponsored, listed, unverified, region or refused; else rejected."""

    def verdict(p: Column) -> Column:
        domestic = (
            F.when(region_only, F.lit("skip")).when(flag == "no", F.lit("refused")).when(flag == "yes", F.lit("sponsored"))
            .when(listed, F.lit("listed")).otherwise(F.lit("unverified" if allow_unknown else "skip"))
        )
        return F.when(is_us(p), domestic).when(in_region(p, region), F.lit("region")).otherwise(F.lit("skip"))

    said = F.get(F.filter(F.transform(parts, verdict), lambda v: v != "skip"), F.lit(0))
    return F.coalesce(said, F.lit("rejected"))


def match_postings(df: DataFrame, region: dict, settings: dict, names: DataFrame | None = None) -> DataFrame:
    """Postings with ``outcome``; those whose outcome is inactive, title, refused or rejected do not match."""
    found = prefix_semi(df, "company", names) if names is not None else df.withColumn("listed", F.lit(False))
    inactive = ~F.coalesce("active", F.lit(True)) if settings.get("require_active", True) else F.lit(False)
    title = any_term(normalize_text(F.col("title")), settings.get("exclude_title_patterns"))
    region_only = F.coalesce("region_only", F.lit(False)) if "region_only" in df.columns else F.lit(False)
    decided = first_decisive(
        location_parts(F.col("location")), F.coalesce("sponsorship_flag", F.lit("unknown")), F.col("listed"), region_only,
        region, settings.get("allow_unknown", False),
    )
    return found.withColumn("outcome", F.when(inactive, "inactive").when(title, "title").otherwise(decided))


MATCHED = ("region", "sponsored", "listed", "unverified")


def tier(flag: Column, outcome: Column) -> Column:
    return (
        F.when(flag == "yes", "confirmed").when(outcome == "region", "region").when(outcome == "listed", "listed").otherwise("unverified")
    )
