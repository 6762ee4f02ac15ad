"""The registered queries over the driver's tables, one or more for each family of operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import dates, textnorm
from tideline.functions.terms import any_term
from tideline.operators import keywords, memo, reports, screens, state, vocabulary
from tideline.operators.commits import Conflict
from tideline.operators.ledger import Ledger
from tideline.plans import pipelines
from tideline.sources import feeds
from tideline.streaming import incremental

NOW = dt.datetime(2024, 1, 31)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS norm_md5,
       length(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g'))::BIGINT AS slug_chars FROM documents""")
def normalize_text(spark, d):
    norm = textnorm.normalize_text(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(norm.cast("binary")).alias("norm_md5"), F.length(textnorm.slug(F.col("text"))).cast("long").alias("slug_chars")
    )


@query(r"""
WITH x AS (SELECT p_partkey, p_brand || CASE p_partkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Co' ELSE '' END AS company,
                  p_name AS title, CASE WHEN p_size > 25 THEN '01022024' ELSE '' END AS day FROM part)
SELECT p_partkey, substr(sha1(regexp_replace(regexp_replace(lower(company), '[,\s]+(inc|llc|ltd|limited|corp|corporation|co|gmbh|plc|sa|nv)\.?$', ''), '[^a-z0-9]+', '', 'g')
       || '|' || regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') || '|' || day), 1, 16) AS id FROM x""")
def posting_id(spark, d):
    k = F.col("p_partkey") % 4
    form = F.when(k == 0, ", Inc.").when(k == 1, " GmbH").when(k == 2, " Co").otherwise("")
    day = F.when(F.col("p_size") > 25, "01022024").otherwise("")
    return table(spark, d, "part").select("p_partkey", textnorm.posting_id(F.concat("p_brand", form), F.col("p_name"), day).alias("id"))


@query(r"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE
       WHEN 3 THEN CASE WHEN strftime(o_orderdate, '%m%d') <= '0201' THEN make_date(2024, month(o_orderdate), day(o_orderdate))
                        WHEN strftime(o_orderdate, '%m%d') = '0229' THEN NULL
                        ELSE make_date(2023, month(o_orderdate), day(o_orderdate)) END
       WHEN 4 THEN o_orderdate::DATE END AS day,
       CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN strftime(o_orderdate, '%m%d%Y')
            WHEN o_orderkey % 6 = 3 AND strftime(o_orderdate, '%m%d') <= '0201' THEN strftime(o_orderdate, '%m%d') || '2024'
            WHEN o_orderkey % 6 = 3 AND strftime(o_orderdate, '%m%d') <> '0229' THEN strftime(o_orderdate, '%m%d') || '2023' ELSE '' END AS mmddyyyy
FROM orders""")
def coerce_dates(spark, d):
    k, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    epoch = F.datediff(at.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("long") * 86400
    text = (
        F.when(k == 0, epoch.cast("string")).when(k == 1, (epoch * 1000 + 5).cast("string")).when(k == 2, F.date_format(at, "yyyy-MM-dd"))
        .when(k == 3, F.date_format(at, "MMM d")).when(k == 4, F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T23:30:00-04:00")))
        .otherwise("soon")
    )
    day = dates.coerce_date(text, NOW)
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), dates.mmddyyyy(day).alias("mmddyyyy"))


PAGE_RULES = ((r"//(?:[^/]*\.)?example\.(com|org)/([a-z]{2})/(\d+)", "{0}:{1}/{2}"), (r"[?&]page=(\d+)", "page:{0}"), (r"example\.net/([a-z]{2})/", "net:{0}"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '//(?:[^/]*\.)?example\.(com|org)/([a-z]{2})/(\d+)')
         THEN regexp_replace(regexp_extract(url, '//(?:[^/]*\.)?example\.(com|org)/([a-z]{2})/(\d+)'), '.*example\.(com|org)/([a-z]{2})/(\d+)', '\1:\2/\3')
       WHEN regexp_matches(url, '[?&]page=(\d+)') THEN 'page:' || regexp_extract(url, '[?&]page=(\d+)', 1)
       WHEN regexp_matches(url, 'example\.net/([a-z]{2})/') THEN 'net:' || regexp_extract(url, 'example\.net/([a-z]{2})/', 1) END AS key FROM pages""")
def url_key(spark, d):
    return table(spark, d, "pages").select("page_id", textnorm.url_key(F.col("url"), PAGE_RULES).alias("key"))


def _tagged(spark, d):
    """Documents as tagged postings of one company."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("seniority"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.lit("all").alias("company_slug"), F.col("text").alias("title"), "seniority", F.col("lang").alias("role_family")
    )
    return rows, spark.range(1).select(F.lit("all").alias("slug"), F.lit("All").alias("name"))


@query(r"""
WITH x AS (SELECT d.doc_id, d.lang, l.quality, lower(strip_accents(text)) AS t FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT reason, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'role' WHEN quality = 0 THEN 'seniority'
              WHEN quality IS NULL AND regexp_matches(t, '(^|[^a-z0-9])(idiot|clown)([^a-z0-9]|$)') THEN 'senior_title'
              WHEN NOT regexp_matches(t, '(^|[^a-z0-9])(the|and|der|les)([^a-z0-9]|$)') THEN 'off_topic' END AS reason FROM x)
GROUP BY reason""")
def term_screen_reasons(spark, d):
    found = screens.screen_tagged(*_tagged(spark, d), ("en", "de", "fr"), ("0",), ("idiot", "clown"), ("the", "and", "der", "les"))
    return found.groupBy(F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"))


@query(r"""
WITH n(k) AS (VALUES ('brand1'), ('brand22'), ('thebolt')), x AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part)
SELECT p_partkey, p_brand, EXISTS (SELECT 1 FROM n WHERE starts_with(x.key, n.k)) AS listed FROM x""")
def prefix_semi(spark, d):
    names = spark.createDataFrame([("Brand#1",), ("The Brand#22",), ("",)], "name string")
    return screens.prefix_semi(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", names)


@query(r"""
WITH dim AS (SELECT n_nationkey::VARCHAR AS slug, n_name AS name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT name, count(*)::BIGINT AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN dim ON s_nationkey::VARCHAR = slug
WHERE r_name NOT IN ('ASIA') GROUP BY name""")
def dim_inner_visible(spark, d):
    region = table(spark, d, "region")
    dim = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("slug"), F.col("n_name").alias("name"), F.array("r_name").alias("industry_tags"), F.col("n_nationkey").alias("row_ord")
    )
    seen = screens.visible_companies(dim, ("asia",))
    joined = table(spark, d, "supplier").join(seen, F.col("s_nationkey").cast("string") == F.col("slug"))
    return joined.groupBy("name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


REGION = {"countries": ("france", "germany"), "cities": ("cork",), "remote": ("remote - eu",), "exclude": ("remote - us",), "extra": ("norway",)}


def _postings(spark, d):
    """Customers as postings with several locations."""
    k = F.col("c_custkey")
    place = lambda n: F.element_at(F.array(*map(F.lit, ("Austin, TX", "Berlin, Germany", "Corktown", "Paris, FRANCE", "Remote - EU", "Remote - US", "Lima", "Cork"))), (n % 8 + 1).cast("int"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("company"), F.concat(F.lit("intern "), F.lower("c_mktsegment")).alias("title_"),
        F.when(k % 11 == 0, "Intern engineer").otherwise("International engineer").alias("title"), (k % 13 != 0).alias("active"),
        F.concat_ws(" | ", place(k), place(F.floor(k / 8)), F.lit(" ")).alias("location"), (k % 5 == 0).alias("region_only"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("unknown").alias("sponsorship_flag"),
    )


@query(r"""
WITH p(i, v) AS (VALUES (0, 'us'), (1, 'eu'), (2, 'x'), (3, 'eu'), (4, 'eu'), (5, 'us'), (6, 'x'), (7, 'eu')),
c AS (SELECT c_custkey AS id, a.v AS a, b.v AS b, c_custkey % 5 = 0 AS ro, c_custkey % 3 AS f, c_mktsegment LIKE 'AUTO%' AS listed
      FROM customer JOIN p a ON a.i = c_custkey % 8 JOIN p b ON b.i = (c_custkey // 8) % 8),
v AS (SELECT *, CASE a WHEN 'us' THEN CASE WHEN ro THEN 'skip' WHEN f = 0 THEN 'sponsored' WHEN f = 1 THEN 'refused' WHEN listed THEN 'listed' ELSE 'skip' END WHEN 'eu' THEN 'region' ELSE 'skip' END AS va,
             CASE b WHEN 'us' THEN CASE WHEN ro THEN 'skip' WHEN f = 0 THEN 'sponsored' WHEN f = 1 THEN 'refused' WHEN listed THEN 'listed' ELSE 'skip' END WHEN 'eu' THEN 'region' ELSE 'skip' END AS vb FROM c)
SELECT id, CASE WHEN id % 13 = 0 THEN 'inactive' WHEN id % 11 = 0 THEN 'title' WHEN va <> 'skip' THEN va WHEN vb <> 'skip' THEN vb ELSE 'rejected' END AS outcome FROM v""")
def first_decisive_verdict(spark, d):
    names = spark.createDataFrame([("Auto",)], "name string")
    settings = {"exclude_title_patterns": ("intern",), "allow_unknown": False}
    return screens.match_postings(_postings(spark, d), REGION, settings, names).select("id", "outcome")


@query(r"""
WITH RECURSIVE r AS (SELECT doc_id, md5(text) AS i, CASE WHEN n_chars % 3 > 0 THEN source || ':' || n_chars END AS k, row_number() OVER (ORDER BY doc_id) AS o FROM documents),
f AS (SELECT 0::BIGINT AS o, []::VARCHAR[] AS ids, []::VARCHAR[] AS ks, NULL::BIGINT AS kept
  UNION ALL SELECT r.o, CASE WHEN ok THEN list_append(ids, r.i) ELSE ids END, CASE WHEN ok AND r.k IS NOT NULL THEN list_append(ks, r.k) ELSE ks END, CASE WHEN ok THEN r.doc_id END
  FROM (SELECT f.ids, f.ks, r.*, NOT list_contains(f.ids, r.i) AND (r.k IS NULL OR NOT list_contains(f.ks, r.k)) AS ok FROM f JOIN r ON r.o = f.o + 1) r)
SELECT kept AS doc_id FROM f WHERE kept IS NOT NULL""")
def two_key_dedupe(spark, d):
    key = F.when(F.col("n_chars") % 3 > 0, F.concat_ws(":", "source", "n_chars"))
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("i"), key.alias("k"))
    return state.greedy_dedupe(rows, "i", "k", "doc_id").select("doc_id")


def _events(spark, d):
    return _shape(table(spark, d, "events"))


CUT = dt.datetime(2024, 1, 29)
_EVENTS_SQL = r"""e AS (SELECT event_id AS ord, user_id || ':' || event_type || ':' || day(ts) AS id,
  CASE WHEN event_id % 3 > 0 THEN event_type || ':' || floor(value)::BIGINT || ':' || (user_id % 7) END AS ats_key, event_type AS seed_group, ts, ts::DATE AS date_posted FROM events)"""


def _split(spark, d):
    e = _events(spark, d)
    seen = e.where(F.col("at") < F.lit(CUT)).where("seed_group <> 'signup'")
    groups = seen.select("seed_group").distinct()
    return state.split_new(e.where(F.col("at") >= F.lit(CUT)), seen, groups)


@query(rf"""
WITH RECURSIVE {_EVENTS_SQL}, seen AS (SELECT * FROM e WHERE ts < '2024-01-29' AND seed_group <> 'signup'),
n AS (SELECT *, row_number() OVER (ORDER BY ord) AS o FROM e WHERE ts >= '2024-01-29' AND id NOT IN (SELECT id FROM seen)
      AND (ats_key IS NULL OR ats_key NOT IN (SELECT ats_key FROM seen WHERE ats_key IS NOT NULL))),
f AS (SELECT 0::BIGINT AS o, []::VARCHAR[] AS ids, []::VARCHAR[] AS ks, NULL::BIGINT AS kept
  UNION ALL SELECT r.o, CASE WHEN ok THEN list_append(ids, r.id) ELSE ids END, CASE WHEN ok AND r.ats_key IS NOT NULL THEN list_append(ks, r.ats_key) ELSE ks END, CASE WHEN ok THEN r.ord END
  FROM (SELECT f.ids, f.ks, n.*, NOT list_contains(f.ids, n.id) AND (n.ats_key IS NULL OR NOT list_contains(f.ks, n.ats_key)) AS ok FROM f JOIN n ON n.o = f.o + 1) r)
SELECT e.ord, e.id, e.seed_group = 'signup' AS silent FROM f JOIN e ON f.kept = e.ord""")
def incremental_split(spark, d):
    return _split(spark, d).select("ord", "id", "silent")


@query(rf"""
WITH {_EVENTS_SQL}, s AS (SELECT id, min(ts) AS first_seen FROM e GROUP BY id)
SELECT count(*)::BIGINT AS tracked, count(*) FILTER (WHERE first_seen >= '2024-01-24')::BIGINT AS new_week,
       count(*) FILTER (WHERE first_seen >= '2024-01-29 12:00:00')::BIGINT AS new_flagged FROM s WHERE first_seen >= '2024-01-11'""")
def state_prune_new_flag(spark, d):
    seen = _events(spark, d).groupBy("id").agg(F.min("at").alias("first_seen"))
    left = state.prune(seen, 20, NOW)
    flagged = reports.with_new_flag(left.select("id"), left, NOW, 36)
    week = F.col("first_seen") >= F.lit(NOW - dt.timedelta(days=7))
    return flagged.join(left, "id").agg(F.count("*").alias("tracked"), F.count_if(week).alias("new_week"), F.count_if("is_new").alias("new_flagged"))


def _new_sql(name: str, since: str, until: str, known: str) -> str:
    """The first event of each id in a span of days whose id and key ``known`` (a query of id and key) does not hold."""
    return f"""{name} AS (SELECT id, arg_min_null(ats_key, ord) AS ats_key, min(ord) AS ord, min_by(ts, ord) AS first_seen FROM e
      WHERE ts >= '{since}' AND ts < '{until}' AND id NOT IN (SELECT id FROM ({known}))
        AND (ats_key IS NULL OR ats_key NOT IN (SELECT ats_key FROM ({known}) WHERE ats_key IS NOT NULL)) GROUP BY id)"""


_RUNS = ("2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01")


@query(f"""
WITH {_EVENTS_SQL}, {_new_sql("r1", _RUNS[0], _RUNS[1], "SELECT '' AS id, '' AS ats_key")}, {_new_sql("r2", _RUNS[1], _RUNS[2], "SELECT id, ats_key FROM r1")},
{_new_sql("r3", _RUNS[2], _RUNS[3], "SELECT id, ats_key FROM r1 UNION ALL SELECT id, ats_key FROM r2")},
a AS (SELECT *, 1 AS version FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)
SELECT id, ord, version::INT AS version, first_seen >= '2024-01-11' AS kept FROM a""")
def state_ledger(spark, d):
    """Three runs over saved state, a late one that loses a race, and a pruning: each record with the version that has it first."""
    events = _events(spark, d)
    ledger = Ledger(spark, incremental.shared_folder(spark), "id string, ats_key string, ord bigint, first_seen timestamp", buckets=16)
    runs = [events.where((F.col("at") >= since) & (F.col("at") < until)) for since, until in zip(_RUNS, _RUNS[1:], strict=False)]
    for run in runs:
        new = ledger.unseen(run).groupBy("id").agg(F.min_by("ats_key", "ord").alias("ats_key"), F.min("ord").alias("ord"), F.min_by("at", "ord").alias("first_seen"))
        base = ledger.append(new)
    try:
        ledger.append(events.withColumn("first_seen", F.col("at")).withColumn("id", F.concat("id", F.lit(" late"))), base - 1)
    except Conflict:
        kept = ledger.rows(ledger.compact(20, NOW)).select("id", F.lit(True).alias("kept"))
    rows = ledger.rows(1).withColumn("version", F.lit(1)).unionByName(ledger.rows(2).withColumn("version", F.lit(2))).unionByName(ledger.rows(3).withColumn("version", F.lit(3)))
    first = rows.groupBy("id", "ord").agg(F.min("version").alias("version"))
    return first.join(kept, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def _board(spark, d):
    """All documents as board rows; their titles are whole texts."""
    labels = table(spark, d, "labels")
    flag = F.when((F.col("quality") == 1) & (F.col("doc_id") % 4 == 0), "yes").otherwise("unknown")
    outcome = F.when(F.col("toxic") == 1, "listed").when(F.col("doc_id") % 3 == 0, "region").otherwise("unverified")
    day = F.when(F.col("doc_id") % 7 > 0, F.date_sub(F.lit(NOW.date()), (F.col("n_chars") % 60).cast("int")))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.concat(F.lit("feeds/"), F.col("source")).alias("source_repo"),
        F.col("source").alias("company"), F.col("text").alias("title"), F.col("lang").alias("location"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id")).alias("url"), day.alias("date_posted"), screens.tier(flag, outcome).alias("tier"),
    )


_BOARD_SQL = r"""b AS (SELECT doc_id AS id, 'feeds/' || source AS source_repo, source AS company, text AS title, lang AS location,
  'https://jobs.example.com/' || doc_id AS url, CASE WHEN doc_id % 7 > 0 THEN DATE '2024-01-31' - (n_chars % 60)::INT END AS date_posted,
  CASE WHEN quality = 1 AND doc_id % 4 = 0 THEN 'confirmed' WHEN toxic = 1 THEN 'listed' WHEN doc_id % 3 = 0 THEN 'region' ELSE 'unverified' END AS tier
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query(rf"""WITH {_BOARD_SQL}
SELECT id AS i, company AS c, title AS t, location AS l, url AS u, coalesce(date_posted::VARCHAR, '') AS d, tier AS g, company AS s, id % 9 = 0 AS n
FROM b WHERE date_posted IS NULL OR date_posted >= DATE '2024-01-01'""")
def board_rows(spark, d):
    rows = reports.max_age(_board(spark, d), 30, NOW.date())
    seen = rows.select("id", F.when(F.col("id") % 9 == 0, F.lit(NOW)).otherwise(F.lit(CUT)).alias("first_seen"))
    return reports.compact_rows(reports.with_new_flag(rows, seen, NOW, 24))


@query(rf"WITH {_BOARD_SQL} SELECT tier, count(*)::BIGINT AS n FROM b GROUP BY tier")
def board_tiles(spark, d):
    return reports.tiles(_board(spark, d))


@query(rf"""WITH {_BOARD_SQL}, x AS (SELECT * FROM b WHERE tier IN ('confirmed', 'region') AND contains(lower(company || ' ' || title || ' ' || location), 'src1') AND id % 5 <> 0)
SELECT id, date_posted, row_number() OVER (PARTITION BY date_posted ORDER BY id) = 1 AS heading, count(*) OVER (PARTITION BY date_posted)::BIGINT AS of_day FROM x""")
def board_search(spark, d):
    rows = _board(spark, d)
    found = reports.search(rows, "SRC1", ("confirmed", "region"), rows.where("id % 5 = 0"))
    days = reports.per_day(found).select(F.col("day"), F.col("n").alias("of_day"))
    headed = reports.day_headings(found, "date_posted", "ord").select("id", "date_posted", "heading")
    return headed.join(days, F.col("date_posted").eqNullSafe(F.col("day"))).select("id", "date_posted", "heading", "of_day")


@query(rf"""WITH {_BOARD_SQL}, s AS (SELECT id FROM b WHERE id % 2 = 0)
SELECT id, CASE tier WHEN 'confirmed' THEN 0 WHEN 'region' THEN 1 ELSE 2 END AS rank,
       '| ' || strftime(date_posted, '%m/%d') || ' | ' || company || ' | ' || replace(title, '|', '/') || ' | ' || location || ' | [apply](' || url || ') |' AS line
FROM b JOIN s USING (id) WHERE date_posted >= DATE '2024-01-10'""")
def backlog(spark, d):
    rows = _board(spark, d)
    found = reports.backlog(rows, rows.where("id % 2 = 0"), dt.date(2024, 1, 10), {"confirmed": 0, "region": 1})
    return found.select("id", "rank", "line")


@query("SELECT count(*)::BIGINT AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000)")
def missing_count(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus = 'O' AND o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return reports.missing_count(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), live.distinct())


@query(r"""
WITH b AS (SELECT l_suppkey AS board, l_suppkey % 50 AS company_key, l_partkey AS key, l_returnflag = 'R' AS reg, l_shipdate::DATE AS day FROM lineitem),
base AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS key, p_partkey % 50 AS company_key FROM part WHERE p_size < 20),
k AS (SELECT DISTINCT key FROM base WHERE key IS NOT NULL), kl AS (SELECT company_key, count(*) AS keyless FROM base WHERE key IS NULL GROUP BY company_key)
SELECT board, count(*)::BIGINT AS jobs, count(*) FILTER (WHERE reg)::BIGINT AS region, count(*) FILTER (WHERE reg AND k.key IS NOT NULL)::BIGINT AS have,
       (count(*) FILTER (WHERE reg) - count(*) FILTER (WHERE reg AND k.key IS NOT NULL))::BIGINT AS new,
       count(*) FILTER (WHERE reg AND day >= DATE '2001-01-01')::BIGINT AS week, coalesce(any_value(keyless), 0)::BIGINT AS keyless
FROM b LEFT JOIN k USING (key) LEFT JOIN kl USING (company_key) GROUP BY board""")
def coverage_report(spark, d):
    return reports.coverage(*_coverage_inputs(spark, d), dt.date(2001, 1, 1))


def _coverage_inputs(spark, d):
    boards = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("board"), (F.col("l_suppkey") % 50).alias("company_key"), F.col("l_partkey").alias("key"),
        (F.col("l_returnflag") == "R").alias("in_region"), F.col("l_shipdate").cast("date").alias("day"),
    )
    base = table(spark, d, "part").where("p_size < 20").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("key"), (F.col("p_partkey") % 50).alias("company_key"))
    return boards, base


@query(r"""
WITH r AS (SELECT event_id AS run_id, CASE WHEN event_type IN ('view', 'error') THEN 'check' WHEN event_type = 'click' THEN 'weekly' ELSE 'other' END AS name,
  CASE WHEN event_type = 'signup' THEN 'queued' ELSE 'completed' END AS status, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion, ts AS updated_at, value AS s FROM events),
l AS (SELECT * FROM (SELECT * FROM r ORDER BY updated_at DESC, run_id DESC LIMIT 8) WHERE s > 0),
x AS (SELECT max(s) FILTER (WHERE name <> 'other') AS max_s, avg(s) FILTER (WHERE name <> 'other') AS avg_s, avg(greatest(1, ceil(s / 60))) AS b FROM l),
y AS (SELECT count(*) FILTER (WHERE conclusion = 'failure') AS failures, arg_max(conclusion, updated_at) AS last_conclusion, max(updated_at) AS last_at
      FROM (SELECT * FROM r WHERE name = 'check' AND status = 'completed' ORDER BY updated_at DESC, run_id DESC LIMIT 5)),
z AS (SELECT (SELECT count(*) FROM r)::BIGINT AS runs, x.*, y.*, ceil((SELECT count(*) FROM r) * b)::BIGINT AS used FROM x, y)
SELECT runs, round_even(max_s, 0)::BIGINT AS max_s, round_even(avg_s, 0)::BIGINT AS avg_s, used, greatest(2000 - used, 0)::BIGINT AS remaining, failures::BIGINT AS failures,
  last_conclusion, last_at, repeat('#', least(floor(round_even(100.0 * used / 2000, 0) / 10), 10)::INT) || repeat('-', 10 - least(floor(round_even(100.0 * used / 2000, 0) / 10), 10)::INT) AS meter,
  CASE WHEN failures > 0 OR last_conclusion <> 'success' OR used >= 2000 THEN 'fail' WHEN 2000 - used < 300 OR round_even(max_s, 0) > 45 THEN 'warn' ELSE 'ok' END AS status FROM z""")
def run_health(spark, d):
    return reports.run_health(_runs(spark, d))


def _runs(spark, d):
    """Events as the log of a workflow's runs."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.when(kind.isin("view", "error"), "check").when(kind == "click", "weekly").otherwise("other").alias("name"),
        F.when(kind == "signup", "queued").otherwise("completed").alias("status"), F.when(kind == "error", "failure").otherwise("success").alias("conclusion"),
        F.col("ts").alias("updated_at"), (F.col("value") * 1000).alias("duration_ms"),
    )


@query(r"""
WITH x AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders), y AS (SELECT * FROM x WHERE n <= 45)
SELECT ((n - 1) // 10)::BIGINT AS batch, count(*)::BIGINT AS cards, string_agg(o_orderpriority || ' — ' || o_orderkey, ';' ORDER BY n) AS titles FROM y GROUP BY 1""")
def notify_batches(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("company"), F.col("o_orderkey").cast("string").alias("title"),
        F.lit("here").alias("location"), F.lit("region").alias("tier"), F.lit("").alias("url"), F.col("o_orderdate").cast("date").alias("date_posted"),
    )
    sent = reports.messages(rows, 45)
    return sent.select("batch", F.size("cards").cast("long").alias("cards"), F.array_join(F.transform("cards", lambda c: c["title"]), ";").alias("titles"))


VOCABULARY = ("trash", "idiot", "apache license", "der", "les")
ALIASES = {"idiot": ["moron", "clown"]}
TAXONOMY = {"trash": {"implies": ["waste", "idiot"], "factor": 0.5}, "les": {"implies": ["french"]}, "der": {"implies": ["german", "waste"], "factor": 0.25}}


def _keywords(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return keywords.ranked(keywords.section_keywords(docs, VOCABULARY, ALIASES, TAXONOMY))


@query()
def section_keywords(spark, d):
    return _keywords(spark, d)


@query()
def page_keywords(spark, d):
    docs = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    return keywords.ranked(keywords.section_keywords(docs, VOCABULARY, ALIASES, TAXONOMY))


@query(r"""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)::BIGINT AS asked
FROM conversations""")
def turn_carry_forward(spark, d):
    own = F.when(F.col("role") == "user", F.length("text")).cast("long")
    turns = table(spark, d, "conversations").select("conv_id", "turn", own.alias("asked"))
    return keywords.fill_forward(turns, "asked", "conv_id", "turn", -1)


_HITS = r"""x AS (SELECT doc_id AS doc, lower(strip_accents(text)) AS t FROM documents),
k AS (SELECT doc, 'the' AS term, 1.0::DOUBLE AS weight FROM x WHERE regexp_matches(t, '(^|[^a-z0-9])the([^a-z0-9]|$)')
      UNION ALL SELECT doc, 'and', 0.9 FROM x WHERE regexp_matches(t, '(^|[^a-z0-9])and([^a-z0-9]|$)')
      UNION ALL SELECT doc, 'der', 0.5 FROM x WHERE regexp_matches(t, '(^|[^a-z0-9])der([^a-z0-9]|$)'))"""


def _hits(spark, d):
    text = textnorm.normalize_text(F.col("text"))
    flags = F.array(*(F.when(any_term(text, (t,), "alnum"), F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"))) for t, w in (("the", 1.0), ("and", 0.9), ("der", 0.5))))
    hit = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("h"))
    return hit.select("doc", "h.*", F.lit("exact").alias("source"), F.lit("").alias("evidence"))


TREE = {"the": {"implies": ["article", "and"], "factor": 0.5}, "der": {"implies": ["article"], "factor": 0.8}, "and": {"implies": ["conjunction"]}}


@query(rf"""
WITH {_HITS}, tree(nth, parent, child, factor) AS (VALUES (0, 'the', 'article', 0.5), (0, 'the', 'and', 0.5), (1, 'der', 'article', 0.8), (2, 'and', 'conjunction', 0.5)),
c AS (SELECT doc, child AS term, round_even(weight * factor, 3) AS w, parent, nth FROM k JOIN tree ON term = parent)
SELECT doc, term, max(w)::DOUBLE AS weight, 'inferred' AS source, arg_min(parent, (-w, nth)) || ' -> ' || term AS evidence FROM c
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc = c.doc AND k.term = c.term) GROUP BY doc, term""")
def taxonomy_expand(spark, d):
    return keywords.infer(_hits(spark, d), {}, TREE)


def _words(df: DataFrame, *by: str) -> DataFrame:
    """The distinct words of each text, as column term."""
    found = F.array_distinct(F.regexp_extract_all(textnorm.normalize_text(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)))
    return df.select(*by, F.explode_outer(found).alias("term")).where("term IS NOT NULL")  # a plain explode makes the words once more to see if there are any


def _variant_words(spark, d):
    """Benchmark texts as variants: the words they hold are their keywords."""
    return _words(table(spark, d, "benchmark").withColumn("variant_id", F.col("item_id").cast("string")), "variant_id")


def _word_weights(docs: DataFrame) -> DataFrame:
    """Every word of every document as a keyword, the longer the heavier; the weights are such that sums of them are exact."""
    n = F.length("term")
    weight = F.when(n >= 9, 1.0).when(n >= 7, 0.9375).when(n >= 4, 0.75).otherwise(0.5)
    return _words(docs, "doc").select("doc", "term", weight.alias("weight"), F.lit("exact").alias("source"))


_MATCH = r"""k AS (SELECT doc, term, CASE WHEN length(term) >= 9 THEN 1.0 WHEN length(term) >= 7 THEN 0.9375 WHEN length(term) >= 4 THEN 0.75 ELSE 0.5 END::DOUBLE AS weight
      FROM (SELECT DISTINCT doc, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS term FROM x)),
v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS term FROM benchmark),
s AS (SELECT doc, 100 * sum(CASE WHEN v.term IS NOT NULL THEN weight ELSE 0 END) / sum(weight) AS n,
             100 * sum(CASE WHEN v.term IS NOT NULL THEN weight ELSE 0 END) FILTER (WHERE weight >= 0.9) / sum(weight) FILTER (WHERE weight >= 0.9) AS c FROM k LEFT JOIN v USING (term) GROUP BY doc),
p AS (SELECT *, round_even(coalesce(0.6 * c + 0.4 * n, n), 0)::BIGINT AS percent FROM s)
SELECT doc, round_even(n, 0)::BIGINT AS named, round_even(c, 0)::BIGINT AS core, percent, CASE WHEN percent >= 75 THEN 'strong' WHEN percent >= 55 THEN 'fair' ELSE 'weak' END AS band FROM p"""


@query(rf"WITH x AS (SELECT doc_id AS doc, text FROM documents), {_MATCH}")
def coverage_match(spark, d):
    """Every word of the documents against every word of the benchmark's variants."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return keywords.match_percent(keywords.coverage(_word_weights(docs), _variant_words(spark, d)))


@query(rf"WITH x AS (SELECT 'd' || doc_id AS doc, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark), {_MATCH}")
def match_memo(spark, d):
    """The match of documents, then of documents and benchmark texts: the second run works on texts of unknown content only."""
    variants, texts = _variant_words(spark, d), table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), "text")
    more = texts.union(table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id"), "text"))
    results = memo.Memo(spark, f"{incremental.shared_folder(spark)}/memo", "named long, core long, percent long, band string")
    work = lambda docs: keywords.match_percent(keywords.covers(_word_weights(docs), variants))
    results.results(memo.with_key(texts, "1"), work)
    return results.results(memo.with_key(more, "1"), work).select("doc", "named", "core", "percent", "band")


def _part_vocabulary(spark, d):
    """Parts as a vocabulary: names with their brand as a spelling, and kinds that imply names."""
    p = table(spark, d, "part")
    bank = _variant_words(spark, d).select("term")
    aliases = p.select(F.col("p_partkey").alias("nth"), F.col("p_name").alias("canonical"), F.concat_ws(" ", "p_brand", F.col("p_size")).alias("spelling"))
    taxonomy = p.select(F.col("p_partkey").alias("nth"), F.col("p_type").alias("parent"), F.concat_ws(" ", "p_brand", F.col("p_size") + 1).alias("child"), F.lit(0.5).alias("factor"))
    return bank, aliases, taxonomy


@query(r"""
WITH a AS (SELECT p_partkey AS nth, p_name AS canonical, p_brand || ' ' || p_size AS spelling FROM part),
c AS (SELECT lower(s) AS k, arg_max(canonical, (nth, canonical)) AS canonical FROM (SELECT nth, canonical, spelling AS s FROM a UNION ALL SELECT nth, canonical, canonical FROM a) GROUP BY 1),
e AS (SELECT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS term FROM benchmark UNION SELECT canonical FROM a UNION SELECT p_type FROM part UNION SELECT p_brand || ' ' || (p_size + 1) FROM part),
t AS (SELECT DISTINCT coalesce(c.canonical, e.term) AS term FROM e LEFT JOIN c ON lower(e.term) = c.k),
s AS (SELECT term, term AS spelling FROM t UNION SELECT term, spelling FROM t JOIN a ON term = canonical)
SELECT term, spelling, lower(spelling) AS key, len(regexp_extract_all(spelling, '[A-Za-z0-9_+#]+|[^A-Za-z0-9_+#]'))::INTEGER AS pieces,
       (spelling = upper(spelling) AND spelling <> lower(spelling)) OR length(spelling) <= 3 AS exact FROM s""")
def vocabulary_spellings(spark, d):
    """Every spelling of every canonical term of a vocabulary that stays a table throughout."""
    bank, aliases, taxonomy = _part_vocabulary(spark, d)
    return vocabulary.spelling_table(spark, vocabulary.vocabulary_table(spark, bank, aliases, taxonomy), aliases)


@query(r"""
WITH l AS (SELECT o_orderkey % 100 AS layout_id, o_orderkey AS bullet_id, 'v' || (o_orderkey % 7) AS variant_id FROM orders),
vk(variant_id, term) AS (VALUES ('v0', 'a'), ('v1', 'a'), ('v1', 'b'), ('v2', 'c'), ('v3', 'c'), ('v4', 'd')), k(term, weight) AS (VALUES ('a', 1.0), ('b', 0.5), ('c', 0.8)),
t AS (SELECT layout_id, term, count(*) AS n FROM l JOIN vk USING (variant_id) GROUP BY ALL),
c AS (SELECT layout_id, sum(weight * CASE WHEN n >= 2 THEN 1.3 ELSE 1.0 END) AS covered FROM t JOIN k USING (term) GROUP BY layout_id),
e AS (SELECT o_orderkey % 100 AS layout_id, sum(CASE greatest(o_orderkey % 3 + 1, o_orderkey % 2 + 1) WHEN 1 THEN 0.03 WHEN 2 THEN 0.02 ELSE 0.01 END) AS extra FROM orders GROUP BY 1)
SELECT layout_id, round(coalesce(covered, 0) + extra, 9)::DOUBLE AS score FROM e LEFT JOIN c USING (layout_id)""")
def layout_scores(spark, d):
    o = table(spark, d, "orders")
    layouts = o.select((F.col("o_orderkey") % 100).alias("layout_id"), F.col("o_orderkey").alias("bullet_id"), F.concat(F.lit("v"), F.col("o_orderkey") % 7).alias("variant_id"))
    bullets = o.select(F.col("o_orderkey").alias("bullet_id"), (F.col("o_orderkey") % 3 + 1).alias("bullet_priority"), (F.col("o_orderkey") % 2 + 1).alias("section_priority"))
    pairs = (("v0", "a"), ("v1", "a"), ("v1", "b"), ("v2", "c"), ("v3", "c"), ("v4", "d"))
    vk = spark.createDataFrame(pairs, "variant_id string, term string")
    k = spark.createDataFrame((("a", 1.0), ("b", 0.5), ("c", 0.8)), "term string, weight double")
    return keywords.score_layouts(layouts, vk, k, bullets)


@query(r"""
WITH b AS (SELECT o_orderkey AS bullet_id, (o_orderkey % 10)::VARCHAR AS section_id, o_orderkey % 1000 = 1 AS mandatory FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT o_custkey % 40 AS layout_id, o_orderkey AS bullet_id, 'v' || (o_custkey % 40 % 9 // 8 * (o_orderkey % 2)) AS voice, 1.5::DOUBLE AS height FROM orders),
p AS (SELECT * FROM l JOIN b USING (bullet_id)), s AS (SELECT DISTINCT section_id, 15 AS lo, 45 AS hi FROM b),
n AS (SELECT i.layout_id, s.section_id, lo, hi, (SELECT count(*) FROM p WHERE p.layout_id = i.layout_id AND p.section_id = s.section_id) AS n FROM (SELECT DISTINCT layout_id FROM l) i, s)
SELECT layout_id, 'too_long' AS rule, NULL::VARCHAR AS item FROM p GROUP BY layout_id HAVING sum(height) + count(DISTINCT section_id) > 500
UNION ALL SELECT layout_id, 'too_few', section_id FROM n WHERE n < lo UNION ALL SELECT layout_id, 'too_many', section_id FROM n WHERE n > hi
UNION ALL SELECT i.layout_id, 'mandatory', b.bullet_id::VARCHAR FROM (SELECT DISTINCT layout_id FROM l) i, b WHERE mandatory AND NOT EXISTS (SELECT 1 FROM l WHERE l.layout_id = i.layout_id AND l.bullet_id = b.bullet_id)
UNION ALL SELECT layout_id, 'voices', count(DISTINCT voice)::VARCHAR FROM l GROUP BY layout_id HAVING count(DISTINCT voice) > 1""")
def layout_check(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    bullets = o.where("o_orderstatus <> 'P'").select(k.alias("bullet_id"), (k % 10).cast("string").alias("section_id"), (k % 1000 == 1).alias("mandatory"))
    at = F.col("o_custkey") % 40
    voice = F.concat(F.lit("v"), (F.floor(at % 9 / 8) * (k % 2)).cast("string"))
    layouts = o.select(at.alias("layout_id"), k.alias("bullet_id"), voice.alias("voice"), F.lit(1.5).alias("height"))
    sections = bullets.select("section_id").distinct().select("section_id", F.lit(15).alias("min_bullets"), F.lit(45).alias("max_bullets"))
    found = keywords.check_layouts(layouts, bullets, sections, 500.0)
    return found.select("layout_id", "rule", F.when(F.col("rule") != "too_long", F.col("item")).alias("item"))


@query(r"""
WITH s AS (SELECT 's' || n_nationkey AS section_id, CASE WHEN n_nationkey = 3 THEN 9 ELSE 1 END AS lo, 5 AS hi, CASE WHEN n_nationkey % 4 = 0 THEN 'Widgets' END AS stack FROM nation),
b AS (SELECT CASE WHEN s_suppkey = 9 THEN 's9' ELSE 'b' || s_suppkey END AS bullet_id, 's' || s_nationkey AS section_id, s_suppkey % 2 = 0 AS must, s_suppkey % 10 = 0 AS eight FROM supplier),
v AS (SELECT 'v' || p_partkey AS variant_id, 'b' || (p_partkey % 120) AS bullet_id, CASE WHEN p_size = 50 THEN 'odd' WHEN p_size = 49 THEN '' WHEN p_size % 2 = 0 THEN 'formal' ELSE 'plain' END AS voice,
             CASE WHEN p_size = 48 THEN '' ELSE p_name || ' in ' || p_size END AS text, p_size, p_partkey % 2 = 1 AS cat FROM part),
n AS (SELECT s.*, (SELECT count(*) FROM b WHERE b.section_id = s.section_id) AS n, (SELECT count(*) FROM b WHERE b.section_id = s.section_id AND must) AS m FROM s),
p AS (SELECT v.*, b.section_id, b.eight, s.stack FROM v JOIN b USING (bullet_id) JOIN s USING (section_id)),
i AS (SELECT section_id AS id FROM s UNION ALL SELECT bullet_id FROM b UNION ALL SELECT variant_id FROM v)
SELECT 'error' AS level, 'duplicate_id' AS rule, id AS item FROM i GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'error', 'bullet_range', section_id FROM n WHERE lo > hi OR lo > n
UNION ALL SELECT 'error', 'too_many_mandatory', section_id FROM n WHERE m > hi
UNION ALL SELECT 'error', 'locked_number_not_in_fact', bullet_id FROM b WHERE eight
UNION ALL SELECT 'error', 'no_variants', bullet_id FROM b WHERE bullet_id NOT IN (SELECT bullet_id FROM v)
UNION ALL SELECT 'error', 'unknown_voice', variant_id FROM v WHERE voice = 'odd'
UNION ALL SELECT 'error', 'missing_voice', variant_id FROM v WHERE voice = ''
UNION ALL SELECT 'error', 'empty_text', variant_id FROM v WHERE text = ''
UNION ALL SELECT 'error', 'text_too_long', variant_id FROM v WHERE length(text) > 16
UNION ALL SELECT 'error', 'number_not_locked', variant_id FROM p WHERE text <> '' AND p_size <> 7 AND NOT (p_size = 8 AND eight)
UNION ALL SELECT CASE WHEN cat THEN 'warning' ELSE 'error' END, CASE WHEN cat THEN 'unsupported_category' ELSE 'unsupported_keyword' END, variant_id FROM p WHERE NOT contains(text, 'widget') AND stack IS NULL
UNION ALL SELECT 'error', 'partial_voice', section_id || ':' || voice FROM p JOIN n USING (section_id) WHERE voice IN ('formal', 'plain') GROUP BY section_id, voice HAVING count(DISTINCT bullet_id) < any_value(n.n)""")
def bank_lint(spark, d):
    n, s, p = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "part")
    key = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    sections = n.select(
        key("s", F.col("n_nationkey")).alias("section_id"), F.when(F.col("n_nationkey") == 3, 9).otherwise(1).alias("min_bullets"), F.lit(5).alias("max_bullets"),
        F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 4 == 0, "Widgets").alias("stack"),
    )
    locked = F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("7"), F.lit("8"), F.lit("T4"))).otherwise(F.array(F.lit("7"), F.lit("YOLOv8")))
    bullets = s.select(
        F.when(F.col("s_suppkey") == 9, "s9").otherwise(key("b", F.col("s_suppkey"))).alias("bullet_id"), key("s", F.col("s_nationkey")).alias("section_id"),
        F.lit("made 7").alias("fact"), locked.alias("facts_locked"), (F.col("s_suppkey") % 2 == 0).alias("must"),
    )
    voice = F.when(F.col("p_size") == 50, "odd").when(F.col("p_size") == 49, "").when(F.col("p_size") % 2 == 0, "formal").otherwise("plain")
    text = F.when(F.col("p_size") == 48, "").otherwise(F.concat_ws(" in ", "p_name", "p_size"))
    variants = p.select(key("v", F.col("p_partkey")).alias("variant_id"), key("b", F.col("p_partkey") % 120).alias("bullet_id"), voice.alias("voice"), text.alias("text"))
    kw = p.select(key("v", F.col("p_partkey")).alias("variant_id"), F.lit("widget").alias("keyword"), (F.col("p_partkey") % 2 == 1).alias("is_category"), F.array(F.lit("widget"), F.lit("widgets")).alias("spellings"))
    return keywords.lint_bank(sections, bullets, variants, kw, ("formal", "plain"), 16)


# --- the pipelines of tideline.plans over whole tables ---------------------------


def _feed(spark, d):
    """Customers as postings of a feed, with arrival order, keys that some share, groups and days."""
    k = F.col("id")
    return (
        _postings(spark, d).withColumn("ord", k).withColumn("ats_key", F.when(k % 4 > 0, F.concat(F.lit("k"), k % 300)))
        .withColumn("seed_group", F.concat(F.lit("g"), k % 5)).withColumn("date_posted", F.when(k % 7 > 0, F.date_sub(F.lit(NOW.date()), (k % 60).cast("int"))))
        .withColumn("url", F.lit("")).withColumn("source_repo", F.lit("feeds/customers"))
    )


def _feed_sql(unknown: str) -> str:
    """m: the customers that match, with their tier; ``unknown`` is what unknown sponsorship says."""
    said = f"CASE WHEN ro THEN 'skip' WHEN f = 0 THEN 'sponsored' WHEN f = 1 THEN 'refused' WHEN listed THEN 'listed' ELSE '{unknown}' END"
    return rf"""p(i, v) AS (VALUES (0, 'us'), (1, 'eu'), (2, 'x'), (3, 'eu'), (4, 'eu'), (5, 'us'), (6, 'x'), (7, 'eu')),
c AS (SELECT c_custkey AS id, a.v AS a, b.v AS b, c_custkey % 5 = 0 AS ro, c_custkey % 3 AS f, c_mktsegment LIKE 'AUTO%' AS listed,
             CASE WHEN c_custkey % 4 > 0 THEN 'k' || (c_custkey % 300) END AS key, 'g' || (c_custkey % 5) AS grp,
             CASE WHEN c_custkey % 7 > 0 THEN DATE '2024-01-31' - (c_custkey % 60)::INT END AS day
      FROM customer JOIN p a ON a.i = c_custkey % 8 JOIN p b ON b.i = (c_custkey // 8) % 8),
v AS (SELECT *, CASE a WHEN 'us' THEN {said} WHEN 'eu' THEN 'region' ELSE 'skip' END AS va, CASE b WHEN 'us' THEN {said} WHEN 'eu' THEN 'region' ELSE 'skip' END AS vb FROM c),
o AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'inactive' WHEN id % 11 = 0 THEN 'title' WHEN va <> 'skip' THEN va WHEN vb <> 'skip' THEN vb ELSE 'rejected' END AS outcome FROM v),
m AS (SELECT *, CASE WHEN f = 0 THEN 'confirmed' WHEN outcome = 'region' THEN 'region' WHEN outcome = 'listed' THEN 'listed' ELSE 'unverified' END AS tier
      FROM o WHERE outcome IN ('region', 'sponsored', 'listed', 'unverified'))"""


FEED_SETTINGS = {"exclude_title_patterns": ("intern",), "allow_unknown": False, "max_notifications_per_run": 40}


def _names(spark):
    return spark.createDataFrame([("Auto",)], "name string")


@query(rf"""WITH {_feed_sql('unverified')}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM m)
SELECT id, tier, id % 9 = 0 AS is_new FROM k WHERE (key IS NULL OR n = 1) AND (day IS NULL OR day >= DATE '2024-01-01')""")
def board_pipeline(spark, d):
    rows = _feed(spark, d)
    seen = rows.select("id", F.when(F.col("id") % 9 == 0, F.lit(NOW)).otherwise(F.lit(CUT)).alias("first_seen"))
    return pipelines.board(rows, seen, REGION, FEED_SETTINGS, NOW, _names(spark), 30, 24).select("id", "tier", "is_new")


@query(rf"""WITH {_feed_sql('unverified')}
SELECT id, CASE tier WHEN 'confirmed' THEN 0 WHEN 'region' THEN 1 WHEN 'listed' THEN 2 ELSE 3 END AS rank,
       (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT id FROM m))::BIGINT AS missing
FROM m WHERE id % 2 = 0 AND day >= DATE '2024-01-10'""")
def backlog_pipeline(spark, d):
    rows = _feed(spark, d)
    found, missing = pipelines.backlog(rows, rows.where("id % 2 = 0").select("id"), REGION, FEED_SETTINGS, dt.date(2024, 1, 10), _names(spark))
    return found.select("id", "rank").join(F.broadcast(missing), F.lit(True))  # one row


@query(rf"""WITH {_feed_sql('skip')}, s AS (SELECT id, key FROM c WHERE id % 10 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS nth FROM m WHERE id NOT IN (SELECT id FROM s) AND (key IS NULL OR key NOT IN (SELECT key FROM s WHERE key IS NOT NULL))),
k AS (SELECT *, grp = 'g4' AS silent FROM n WHERE key IS NULL OR nth = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY silent ORDER BY day DESC NULLS LAST, id) AS place FROM k)
SELECT id, CASE WHEN silent THEN 'silent' WHEN place <= 40 THEN 'sent' ELSE 'deferred' END AS what FROM r""")
def incremental_pipeline(spark, d):
    rows = _feed(spark, d)
    seen = rows.where("id % 10 = 0").select("id", F.lit(CUT).alias("first_seen"), "company", "title", "ats_key", F.lit(False).alias("seeded"))
    groups = rows.select("seed_group").distinct().where("seed_group <> 'g4'")
    run = pipelines.incremental_run(rows, seen, groups, REGION, FEED_SETTINGS, NOW, _names(spark))
    parts = [df.select("id", F.lit(name).alias("what")) for df, name in ((run.notify, "sent"), (run.deferred, "deferred"), (run.silent, "silent"))]
    return parts[0].union(parts[1]).union(parts[2])


@query(ORACLE_SQL["run_health"].replace("SELECT runs,", f"SELECT s.tracked, s.new_week, runs,").replace("FROM z", f"""FROM z, (
  SELECT count(*)::BIGINT AS tracked, count(*) FILTER (WHERE first_seen >= '2024-01-24' AND NOT seeded)::BIGINT AS new_week
  FROM (SELECT event_id, min(ts) AS first_seen, event_id % 5 = 0 AS seeded FROM events GROUP BY event_id)) s"""))
def health_pipeline(spark, d):
    at = F.col("ts").cast("timestamp")
    seen = table(spark, d, "events").select(F.col("event_id").alias("id"), at.alias("first_seen"), (F.col("event_id") % 5 == 0).alias("seeded"))
    return pipelines.health(seen, _runs(spark, d), NOW)


@query(ORACLE_SQL["coverage_report"])
def coverage_pipeline(spark, d):
    return pipelines.coverage_report(*_coverage_inputs(spark, d), dt.datetime(2001, 1, 8, 5))


@query(r"""
SELECT x.doc_id FROM (SELECT d.doc_id, d.lang, l.quality, lower(strip_accents(text)) AS t FROM documents d LEFT JOIN labels l USING (doc_id)) x
WHERE lang IN ('en', 'de', 'fr') AND quality IS DISTINCT FROM 0 AND regexp_matches(t, '(^|[^a-z0-9])(the|and|der|les)([^a-z0-9]|$)')
  AND NOT (quality IS NULL AND regexp_matches(t, '(^|[^a-z0-9])(senior|sr|staff|principal|lead|head|director|vp|chief|architect|manager)([^a-z0-9]|$)'))""")
def snapshot_pipeline(spark, d):
    """Documents as a tagged snapshot; no senior terms are given, so the default ones hold."""
    options = {"roles": ("en", "de", "fr"), "exclude_seniority": ("0",), "require": ("the", "and", "der", "les")}
    return pipelines.title_screened_snapshot(*_tagged(spark, d), options)[0].select("doc_id")


@query()
def match_pipeline(spark, d):
    """Match percent of each document with the benchmark's variants, by whole keywords."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    variants = _variant_words(spark, d)
    return pipelines.document_match(docs, variants, variants.select("term"), {}, TREE)


@query(ORACLE_SQL["incremental_split"].replace("SELECT e.ord, e.id, e.seed_group = 'signup' AS silent", "SELECT e.id, e.seed_group = 'signup' AS silent"))
def stream_incremental(spark, d):
    """The incremental split as a stream: the day's events arrive as one micro-batch of a file source."""
    e = _events(spark, d)
    seen = e.where(F.col("at") < F.lit(CUT)).where("seed_group <> 'signup'")
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    return incremental.run_once(stream, lambda batch: _shape(batch).where(F.col("at") >= F.lit(CUT)), seen, seen.select("seed_group").distinct())


def _landed_days(spark, d, since: dt.datetime, late: int = 0):
    """The events from a day on as files that arrive in turn, one a day; one event in ``late`` arrives with the next day's."""
    folder, day = incremental.shared_folder(spark), F.dayofyear("ts")
    source = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") >= F.lit(since))
    arrival = F.when(F.col("event_id") % late == 0, day + 1).otherwise(day) if late else day
    landed = source.withColumn("arrival", arrival)
    for n in [r["arrival"] for r in landed.select("arrival").distinct().orderBy("arrival").collect()]:  # days
        landed.where(F.col("arrival") == n).drop("arrival").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


@query(rf"WITH {_EVENTS_SQL.replace('FROM events)', 'FROM events WHERE day(ts) > 20)')} SELECT DISTINCT id, seed_group FROM e")
def stream_watermark(spark, d):
    """First events of each id over ten days of files, one a micro-batch, some a day late."""
    stream, folder = _landed_days(spark, d, dt.datetime(2024, 1, 21), 50)
    first = incremental.first_seen_stream(_shape(stream), "id", "at", "3 days")
    query = first.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("id", "seed_group")


@query(
    ORACLE_SQL["incremental_split"].replace("'2024-01-29'", "'2024-01-27'")
    .replace("(SELECT * FROM e WHERE ts < '2024-01-27' AND seed_group <> 'signup')", "(SELECT id, arg_min_null(ats_key, ord) AS ats_key FROM e WHERE ts < '2024-01-27' AND seed_group <> 'signup' GROUP BY id)")
)
def stream_ledger(spark, d):
    """The incremental split over four days of files, one a micro-batch, against a ledger with the first record of each earlier id."""
    since = dt.datetime(2024, 1, 27)
    e = _events(spark, d)
    seen = e.where(F.col("at") < F.lit(since)).where("seed_group <> 'signup'")
    stream, folder = _landed_days(spark, d, since)
    ledger = Ledger(spark, f"{folder}/state", "id string, ats_key string", buckets=16)
    ledger.append(seen.groupBy("id").agg(F.min_by("ats_key", "ord").alias("ats_key")))
    found = incremental.run_on_ledger(stream, _shape, ledger, seen.select("seed_group").distinct(), f"{folder}/out", f"{folder}/checkpoint")
    found.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("ord", "id", "silent")


@query(r"""
SELECT c_name AS company, c_mktsegment AS title, CASE WHEN c_custkey <= 80 THEN 'City ' || c_nationkey ELSE 'Unspecified' END AS location,
       'https://x.example/' || c_custkey AS url FROM customer""")
def pipe_table_rows(spark, d):
    """Customers as pipe tables, a file a nation, in which the header changes."""
    c = table(spark, d, "customer")
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    link = F.concat(F.lit("[go](https://x.example/"), "c_custkey", F.lit(")"))
    early, late = line("c_name", "c_mktsegment", F.concat(F.lit("City "), "c_nationkey"), link), line("c_mktsegment", "c_name", link)
    rows = c.select("c_nationkey", F.col("c_custkey").alias("at"), F.when(F.col("c_custkey") <= 80, early).otherwise(late).alias("value"))
    nations = c.select("c_nationkey").distinct()
    heads = nations.select("c_nationkey", F.lit(-1), F.lit("| Company | Role | Location | Application |")).union(nations.select("c_nationkey", F.lit(80.5), F.lit("| Position | Company | Link |")))
    folder = incremental.shared_folder(spark)
    ordered = rows.withColumn("at", F.col("at").cast("double")).union(heads).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "at")
    ordered.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(f"{folder}/tables")
    return feeds.pipe_table(spark, f"{folder}/tables/*/*.txt", "tables", NOW).select("company", "title", "location", "url")


def _shape(events: DataFrame) -> DataFrame:
    """Events as postings: an id a user, kind and day; a key for most; arrival order is the event id."""
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("ord"), F.concat_ws(":", "user_id", "event_type", F.dayofmonth(at)).alias("id"),
        F.when(F.col("event_id") % 3 > 0, F.concat_ws(":", "event_type", F.floor("value"), F.col("user_id") % 7)).alias("ats_key"),
        F.col("event_type").alias("seed_group"), F.col("user_id").cast("string").alias("company"), F.col("props").alias("title"),
        at.alias("at"), at.cast("date").alias("date_posted"),
    )
