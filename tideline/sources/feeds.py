"""Landed feeds as postings: listings JSON, pipe tables, three kinds of board, tagged snapshots.

Every reader gives id, company, title, location, url, sponsorship_flag, source_repo,
date_posted, active, ats_key, seed_group, region_only and arrival order (src_ord, row_ord).
Files have landed before; nothing here fetches.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.dates import coerce_date, mmddyyyy
from tideline.functions.textnorm import JOB_URL_RULES, content_id, posting_id, url_key
from tideline.operators.screens import visible_companies
from tideline.operators.state import checkpoint

# What feeds say about sponsorship, in lower case.
FLAGS = {"offers sponsorship": "yes", "does not offer sponsorship": "no", "u.s. citizenship is required": "no", "other": "unknown"}
COLUMNS = (
    "id", "company", "title", "location", "url", "sponsorship_flag", "source_repo", "date_posted", "active", "ats_key", "seed_group",
    "region_only", "src_ord", "row_ord",
)


def _finish(df: DataFrame, source: str, src_ord: int, id_: Column | None = None) -> DataFrame:
    made = posting_id(F.col("company"), F.col("title"), mmddyyyy(F.col("date_posted")))
    full = (
        df.withColumn("ats_key", url_key(F.col("url"), JOB_URL_RULES) if "ats_key" not in df.columns else F.col("ats_key"))
        .withColumn("id", made if id_ is None else id_)
        .withColumn("source_repo", F.lit(source))
        .withColumn("src_ord", F.lit(src_ord))
    )
    for name, value in (("seed_group", F.lit(source)), ("region_only", F.lit(False)), ("active", F.lit(True)), ("sponsorship_flag", F.lit("unknown"))):
        if name not in full.columns:
            full = full.withColumn(name, value)
    return full.select(*COLUMNS)


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


LISTING = "company_name string, title string, locations string, url string, company_url string, sponsorship string, date_posted string, active variant, is_visible variant"


def said(field: Column, missing: bool = True) -> Column:
    """Whether a field (a VARIANT) says yes: ``missing`` where the key is not there, no for null, false, zero and empty values."""
    kind = F.schema_of_variant(field)
    empty = F.to_json(field).isin("null", "false", "0", '""', "[]", "{}")
    number = kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(field, "$", "double") == 0)
    return F.when(field.isNull(), F.lit(missing)).otherwise(~(empty | number))


def listings_json(spark: SparkSession, path: str, source: str, now: dt.datetime, src_ord: int = 0) -> DataFrame:
    """One array of objects a file; ``locations`` is a list or a string; hidden rows and rows without company or title go.

    A row without ``active`` is active, one where it is null or empty is not; only a false
    ``is_visible`` hides a row.  A file that is no JSON array fails the read; elements of the
    array that are no objects are skipped.  A file is one value, so it has to fit in a row (2 GB).
    """
    listed = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(listed).alias("row_ord", "element"))
    objects = raw.where(F.ltrim("element").startswith("{")).select("row_ord", F.from_json("element", f"struct<{_struct(LISTING)}>").alias("r"))
    rows = objects.select("row_ord", "r.*").where(~_blank("company_name") & ~_blank("title") & (F.coalesce(F.to_json("is_visible"), F.lit("")) != "false"))
    places = F.array_join(F.from_json("locations", "array<string>"), " | ")
    place = F.when(F.col("locations").startswith("["), places).otherwise(F.col("locations"))
    flag = F.coalesce(_flag(F.col("sponsorship")), F.lit("unknown"))
    return _finish(
        rows.select(
            F.col("row_ord").cast("long"), F.trim("company_name").alias("company"), F.trim("title").alias("title"),
            F.coalesce(F.nullif(place, F.lit("")), F.lit("Unspecified")).alias("location"),
            F.coalesce(F.nullif("url", F.lit("")), F.nullif("company_url", F.lit("")), F.lit("")).alias("url"),
            flag.alias("sponsorship_flag"), coerce_date(F.col("date_posted"), now).alias("date_posted"), said(F.col("active")).alias("active"),
        ),
        source, src_ord,
    )


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in ddl.split(",")))


def _flag(c: Column) -> Column:
    found = F.lit(None).cast("string")
    for said, flag in FLAGS.items():
        found = F.when(F.lower(F.trim(c)) == said, F.lit(flag)).otherwise(found)
    return found


def clean_cell(c: Column) -> Column:
    """A table cell as text: breaks become bars, markup, links, arrows and emoji go."""
    # What feeds put into cells.
    for pattern, to in (
        (r"(?i)</?br\s*/?>", " | "), (r"<[^>]+>", ""), (r"\*\*", ""), ("↳", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", ""), (r"(?U)\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.btrim(c, F.lit(" |"))


# Links in cells, and the marks of closed and of sponsored postings.
HREF, LINK = r"""(?i)href=["'](https?://[^"']+)["']""", r"\]\((https?://[^)]+)\)"
CLOSED, SPONSOR = "🔒", "🛂"


#: parts of files up to which their headers are broadcast
BROADCAST_PARTS = 20_000
#: column of a table -> what its header says
HEADERS = {"company": ("company",), "title": ("role", "position"), "location": ("location",), "link": ("link", "application"), "date": ("date",)}


def _named_columns(cells: Column) -> Column:
    """struct of the place (from 1, 0: none) of each column of :data:`HEADERS` in a header row.

    Cells are read from left to right; each gives the first column that it names and that is still free.
    """
    none = F.struct(*(F.lit(0).alias(c) for c in HEADERS))
    numbered = F.transform(cells, lambda x, i: F.struct(F.lower(x).alias("says"), (i + 1).alias("at")))

    def step(found: Column, cell: Column) -> Column:
        fields, taken = [], F.lit(False)
        for name, words in HEADERS.items():
            fits = ~taken & _any_in(cell["says"], words) & (found[name] == 0)
            fields.append(F.when(fits, cell["at"]).otherwise(found[name]).alias(name))
            taken = taken | fits
        return F.struct(*fields)

    return F.aggregate(numbered, none, step)


def pipe_table(spark: SparkSession, path: str, source: str, now: dt.datetime, src_ord: int = 0) -> DataFrame:
    """Markdown tables; a header row, which may come again, names the columns of the rows after it.

    A header has a cell that says ``company`` and nothing else, and one that names a role.  Rows
    before it, separators, closed postings, and rows too short for the named columns go.  A
    file without a table, or a header whose columns cannot be told apart, fails the read.

    A file of any size is read by lines and may fall into several tasks: the last header of each
    part is carried into the parts behind it, then each part names its own rows.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")
    )
    cells = F.transform(F.split(F.btrim("line", F.lit("|")), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.col("line").startswith("|")).select("file", "part", "at", "line", cells.alias("cells"))
    is_header = F.exists("cells", lambda x: F.lower(x) == "company") & F.exists("cells", lambda x: _any_in(F.lower(x), HEADERS["title"]))
    rows = rows.withColumn("own", F.when(is_header, _named_columns(F.col("cells"))))
    unclear = F.raise_error(F.concat(F.lit("no columns of company and role in "), F.col("line"))).cast(rows.schema["own"].dataType)
    rows = rows.withColumn("own", F.when(F.col("own.title") == 0, unclear).otherwise(F.col("own")))
    rows = checkpoint(rows)
    if rows.isEmpty():
        raise ValueError(f"no table in {path}")
    # Parts are few, and so are the rows of a file's window here.
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("file", "part").agg(F.count("*").alias("n"), F.max_by("own", F.when(F.col("own").isNotNull(), F.col("at"))).alias("last"))
    parts = checkpoint(parts.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.last("last", ignorenulls=True).over(before).alias("carried")))
    joined = rows.join(F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts, ["file", "part"])
    upto = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = joined.withColumn("h", F.coalesce(F.last("own", ignorenulls=True).over(upto), "carried")).withColumn("pos", F.col("rows_before") + F.count("*").over(upto))
    rows = rows.where("own IS NULL AND h IS NOT NULL").where(~F.col("line").rlike(r"^[\s|:-]+$"))
    rows = rows.where(F.size("cells") >= F.greatest(*(F.col(f"h.{c}") for c in HEADERS)))
    cell = lambda f: F.when(F.col(f"h.{f}") > 0, F.try_element_at("cells", F.col(f"h.{f}").cast("int")))
    some = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    link = F.coalesce(cell("link"), F.lit(""))
    found = rows.select(
        F.col("pos").cast("long").alias("row_ord"), clean_cell(cell("company")).alias("company"), clean_cell(cell("title")).alias("title"),
        F.coalesce(F.nullif(clean_cell(cell("location")), F.lit("")), F.lit("Unspecified")).alias("location"),
        (link.contains(CLOSED) & ~link.rlike(HREF)).alias("closed"),
        some(F.regexp_extract(link, HREF, 1), F.regexp_extract(cell("title"), HREF, 1), F.regexp_extract(link, LINK, 1), F.regexp_extract(cell("title"), LINK, 1)).alias("url"),
        F.when(cell("title").contains(SPONSOR), "yes").otherwise("unknown").alias("sponsorship_flag"),
        coerce_date(clean_cell(cell("date")), now).alias("date_posted"),
    )
    return _finish(found.where(~_blank("company") & ~_blank("title") & ~F.col("closed")).drop("closed"), source, src_ord)


def _any_in(text: Column, names) -> Column:
    hit = F.lit(False)
    for n in names:
        hit = hit | text.contains(n)
    return hit


def _board(jobs: DataFrame, kind: str, src_ord: int) -> DataFrame:
    """Jobs (board, company, key, title, places, url, day, listed) as postings, all or nothing for each board."""
    bad = jobs.where(F.col("key").isNull() | F.col("title").isNull() | F.col("url").isNull()).select("board").distinct()
    good = jobs.join(bad, "board", "left_anti").where("listed")
    pieces = F.flatten(F.transform("places", lambda p: F.split(F.coalesce(p, F.lit("")), ";")))
    flat = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")
    key = F.concat_ws(":", F.lit({"greenhouse": "gh"}.get(kind, kind)), "key")
    rows = good.select(
        "company", F.trim("title").alias("title"), F.coalesce(F.nullif(F.array_join(flat, " | "), F.lit("")), F.lit("Unspecified")).alias("location"), "url",
        F.col("day").alias("date_posted"), key.alias("ats_key"), F.concat(F.lit(f"ats/{kind}/"), "board").alias("seed_group"), F.lit(True).alias("region_only"), "row_ord",
    )
    return _finish(rows, f"ats/{kind}", src_ord, content_id(F.col("ats_key")))


def quarantined_boards(jobs: DataFrame) -> DataFrame:
    """Boards that :func:`_board` leaves out, with how many of their jobs lack a required field."""
    missing = F.col("key").isNull() | F.col("title").isNull() | F.col("url").isNull()
    return jobs.groupBy("board").agg(F.count_if(missing).alias("bad")).where("bad > 0")


def _landed(spark: SparkSession, path: str, schema: str, registry: DataFrame, jobs: str) -> DataFrame:
    """Jobs (board, company, row_ord, x) of the files under ``path``/board=NAME/, with companies from the registry (board, name).

    A file that cannot be read as ``schema``, or lacks its list of jobs, gives one null job,
    so that the board is quarantined instead of looking empty.
    """
    text = spark.read.option("basePath", path).text(f"{path}/board=*", wholetext=True)
    parsed = text.select(F.col("board").cast("string").alias("board"), F.from_json("value", schema).alias("j")).select("board", F.col(jobs).alias("jobs"))
    listed = F.coalesce("jobs", F.array(F.get("jobs", F.lit(0))))
    own = registry.select(F.col("board").alias("b"), F.col("name").alias("company"))
    return parsed.join(own, F.col("board") == F.col("b")).select("board", "company", F.posexplode(listed).alias("row_ord", "x"))


def greenhouse_jobs(spark: SparkSession, path: str, registry: DataFrame, now: dt.datetime) -> DataFrame:
    schema = "struct<jobs: array<struct<id: string, title: string, location: struct<name: string>, absolute_url: string, first_published: string>>>"
    return _landed(spark, path, schema, registry, "j.jobs").select(
        "board", "company", F.col("row_ord").cast("long"), F.col("x.id").alias("key"), F.col("x.title").alias("title"), F.array("x.location.name").alias("places"),
        F.col("x.absolute_url").alias("url"), coerce_date(F.col("x.first_published"), now).alias("day"), F.lit(True).alias("listed"),
    )


def ashby_jobs(spark: SparkSession, path: str, registry: DataFrame, now: dt.datetime) -> DataFrame:
    schema = "struct<jobs: array<struct<id: string, title: string, location: string, secondaryLocations: array<struct<location: string>>, isListed: variant, publishedAt: string, jobUrl: string>>>"
    more = F.coalesce(F.transform("x.secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>"))
    return _landed(spark, path, schema, registry, "j.jobs").select(
        "board", "company", F.col("row_ord").cast("long"), F.lower("x.id").alias("key"), F.col("x.title").alias("title"), F.concat(F.array("x.location"), more).alias("places"),
        F.col("x.jobUrl").alias("url"), coerce_date(F.col("x.publishedAt"), now).alias("day"), said(F.col("x.isListed")).alias("listed"),
    )


def lever_jobs(spark: SparkSession, path: str, registry: DataFrame, now: dt.datetime) -> DataFrame:
    schema = "array<struct<id: string, text: string, categories: struct<location: string, allLocations: array<string>>, createdAt: bigint, hostedUrl: string>>"
    # Without categories a job cannot be read, and neither can its board.
    key = F.when(F.col("x.categories").isNotNull(), F.lower("x.id"))
    every = F.when(F.size("x.categories.allLocations") > 0, F.col("x.categories.allLocations")).otherwise(F.array("x.categories.location"))
    return _landed(spark, path, schema, registry, "j").select(
        "board", "company", F.col("row_ord").cast("long"), key.alias("key"), F.col("x.text").alias("title"), every.alias("places"),
        F.col("x.hostedUrl").alias("url"), coerce_date(F.col("x.createdAt").cast("string"), now).alias("day"), F.lit(True).alias("listed"),
    )


BOARDS = {"greenhouse": greenhouse_jobs, "ashby": ashby_jobs, "lever": lever_jobs}


def boards(spark: SparkSession, root: str, registry: DataFrame, now: dt.datetime, src_ord: int = 0) -> DataFrame:
    """All kinds of board that have landed under ``root``/KIND/board=NAME/ and are in the registry (ats, board, name)."""
    kinds = [r["ats"] for r in registry.select("ats").distinct().collect()]  # kinds of board: three
    out = None
    for n, kind in enumerate(sorted(k for k in kinds if k in BOARDS)):
        part = _board(BOARDS[kind](spark, f"{root}/{kind}", registry.where(F.col("ats") == kind), now), kind, src_ord + n)
        out = part if out is None else out.unionByName(part)
    return out


SNAPSHOT_COLUMNS = ("id", "company_slug", "title", "url", "location", "seniority", "role_family", "posted_at")


def tagged_snapshot(spark: SparkSession, path: str, companies: str, exclude_tags=()) -> tuple[DataFrame, DataFrame]:
    """The eight needed columns of a snapshot, and its company dimension (slug, name) without those of excluded industries."""
    dim = spark.read.parquet(companies).select("slug", "name", "industry_tags", F.col("_metadata.row_index").alias("row_ord"))
    return spark.read.parquet(path).select(*SNAPSHOT_COLUMNS), visible_companies(dim, exclude_tags)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: doc (its path) and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))


def _boards_adapter(spark: SparkSession, config: dict, now: dt.datetime, src_ord: int) -> DataFrame:
    return boards(spark, config["path"], config["registry"], now, src_ord)


#: adapter name -> (spark, config, now, src_ord) -> postings; further adapters are added here
ADAPTERS = {
    "listings_json": lambda spark, c, now, n: listings_json(spark, c["path"], c["name"], now, n),
    "pipe_table": lambda spark, c, now, n: pipe_table(spark, c["path"], c["name"], now, n),
    "boards": _boards_adapter,
}


def read_sources(spark: SparkSession, configs: list[dict], now: dt.datetime) -> tuple[DataFrame, dict[str, str]]:
    """All sources that can be read, in config order, and what was wrong with the others.

    A source is tried by reading all of it once, into the checkpoint folder, so that one bad
    file or schema does not stop the others; all of them failing, or all being empty, does.
    """
    good, failed = [], {}
    for n, config in enumerate(configs):
        try:
            good.append(checkpoint(ADAPTERS[config["adapter"]](spark, config, now, n * 10)))
        except Exception as e:  # whatever one source throws is reported, and its rows are left out
            failed[config["name"]] = f"{type(e).__name__}: {e}"[:500]
    if not good:
        raise ValueError(f"no source can be read: {failed}")
    return union_sources(good), failed


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources in order; arrival order is (src_ord, row_ord)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    if out.isEmpty():
        raise ValueError("every source is empty; saved state stays as it is")
    return out
