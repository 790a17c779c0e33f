"""Queries of the price-growth analysis (cleaning, profiling, price levels,
distributions, trends) with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.normal import sql_norm_ppf
from ..operators import clean as C
from ..operators import distribution as D
from ..operators import growth as G
from ..operators import prices as P
from ..operators import profile as PR
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import listing_view, revision_view
from ..sources.readers import parse_text, read_listings, scan_csv, write_partitions
from ..sources.schema import LISTING_SCHEMA, REVISION_SCHEMA
from .oracle import CLEANED, DAILY, LISTING, REVISION, register, with_ctes
from .queries import cleaned_listings, query, rounded

KEYS = ["location", "property_type"]
K = "location, property_type"


def daily_table(spark, sf_dir):
    return P.daily_price(cleaned_listings(spark, sf_dir), agg="median")


# ------------------------------------------------------------------ A5, D1, D2, B5

@query("a5_profile_columns")
def q_profile(spark, sf_dir):
    return PR.profile_columns(listing_view(spark, sf_dir))


_PROFILE_TYPES = [("listing_id", "bigint"), ("listing_dt", "date"), ("listing_type", "string"),
                  ("property_type", "string"), ("tenure", "string"), ("location", "string"),
                  ("bedroom_count", "int"), ("bathroom_count", "double"), ("asking_price", "double")]
register("a5_profile_columns", with_ctes(LISTING, body="\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, "
    f"count(*) - count({c}) AS nulls, count(*) AS row_count FROM listing"
    for i, (c, t) in enumerate(_PROFILE_TYPES))))

@query("a1_a3_parse_text")
def q_parse_text(spark, sf_dir):
    """The listing view as CSV lines (columns in another order, an unknown one
    among them) and read back by the reader's own cell rules."""
    view = listing_view(spark, sf_dir)
    names = [*reversed(view.columns), "remark"]
    text = view.withColumn("remark", F.lit("a, b")).select(*[F.col(c).cast("string") for c in names])
    lines = text.select(F.to_csv(F.struct(*names)).alias("line"))
    cells = lines.select(F.from_csv("line", F.lit(", ".join(f"{c} string" for c in names))).alias("c")).select("c.*")
    out = parse_text(cells, LISTING_SCHEMA)
    return out.withColumn("listing_dt", F.to_date("listing_dt"))


register("a1_a3_parse_text", with_ctes(LISTING, body="SELECT * FROM listing"))


def _scratch(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("a1_scan_csv_files")
def q_scan_csv(spark, sf_dir):
    """The listing view written as CSV files with two different headers, some lines broken,
    and scanned by the reader: whole rows only."""
    view, path = listing_view(spark, sf_dir), _scratch(spark)
    names = view.columns
    halves = [(F.col("listing_id") % 2 == 0, names), (F.col("listing_id") % 2 == 1, [*reversed(names), "remark"])]
    for i, (rows, columns) in enumerate(halves):
        part = view.filter(rows).withColumn("remark", F.lit("a, b"))
        part.select(*columns).write.option("header", True).csv(f"{path}/part={i}")
    # A file whose lines have too few or too many cells.
    broken = view.filter("listing_id % 10 = 3").select(F.format_string("%d,2020-01-01,buy,house", "listing_id").alias("v"))
    head = spark.createDataFrame([(",".join(names),)], "v string")
    head.unionByName(broken).coalesce(1).write.text(f"{path}/part=2")
    out = read_listings(spark, [f"{path}/part={i}" for i in range(3)])
    return out.withColumn("listing_dt", F.to_date("listing_dt"))


register("a1_scan_csv_files", with_ctes(LISTING, body="SELECT * FROM listing"))


@query("a2_scan_csv_rejects")
def q_scan_rejects(spark, sf_dir):
    """Revisions as CSV, every 50th line cut short: what the scan keeps aside, by reason, and
    what it keeps."""
    path = _scratch(spark)
    view = revision_view(spark, sf_dir).select("listing_id", "price_revision_dt", "revised_purchase_price")
    line = F.when(F.col("listing_id") % 50 == 0, F.col("listing_id").cast("string")).otherwise(F.concat_ws(
        ",", F.col("listing_id"), F.col("price_revision_dt"), F.coalesce(F.col("revised_purchase_price").cast("string"), F.lit(""))))
    spark.createDataFrame([(",".join(view.columns),)], "v string").coalesce(1).write.text(f"{path}/all")
    # Files of lines with their header in front: one column of text each.
    view.select(line.alias(",".join(view.columns))).write.option("header", True).option("quote", "").option(
        "escapeQuotes", False).option("sep", "|").csv(f"{path}/lines")
    rows, left = scan_csv(spark, [f"{path}/all", f"{path}/lines"], REVISION_SCHEMA)
    kept = rows.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("lines"))
    return kept.unionByName(left.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")))


register("a2_scan_csv_rejects", with_ctes(REVISION, body="""
SELECT CASE WHEN listing_id % 50 = 0 THEN 'cells' ELSE 'kept' END AS reason, count(*) AS lines FROM revision GROUP BY 1"""))


@query("a4_partitioned_sink")
def q_sink(spark, sf_dir):
    """Cleaned listings stored by town, two towns written again, read once."""
    path = _scratch(spark)
    rows = cleaned_listings(spark, sf_dir).filter("location IS NOT NULL").checkpoint(eager=True)
    write_partitions(rows, path, ["location"])
    return write_partitions(rows.filter("location IN ('NATION_2', 'NATION_3')"), path, ["location"])


register("a4_partitioned_sink", with_ctes(LISTING, CLEANED, body="SELECT * FROM cleaned WHERE location IS NOT NULL"))

_VC_COLS = ["property_type", "tenure", "location", "bedroom_count", "bathroom_count"]


@query("d1_value_counts")
def q_value_counts(spark, sf_dir):
    return PR.value_counts_of(listing_view(spark, sf_dir), list(_VC_COLS))


register("d1_value_counts", with_ctes(LISTING, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count "
    f"FROM listing WHERE {c} IS NOT NULL GROUP BY {c}" for c in _VC_COLS[:4]) + """
UNION ALL
SELECT 'bathroom_count' AS column_name, CAST(CAST(bathroom_count AS INT) AS VARCHAR) || '.0' AS value,
       count(*) AS count FROM listing WHERE bathroom_count IS NOT NULL GROUP BY bathroom_count"""))


@query("d1_dear_studio_prices")
def q_dear_studio(spark, sf_dir):
    rep = C.outlier_report(listing_view(spark, sf_dir)).filter(F.col("rule") == "no_beds_dear")
    return PR.value_counts(rep, "asking_price", by="value")


register("d1_dear_studio_prices", with_ctes(LISTING, body="""
SELECT asking_price, count(*) AS count FROM listing
WHERE bedroom_count = 0 AND asking_price >= 300000 GROUP BY asking_price"""))


@query("d2_key_check")
def q_key_check(spark, sf_dir):
    return PR.key_check(listing_view(spark, sf_dir), "listing_id")


register("d2_key_check", with_ctes(LISTING, body="""
SELECT count(*) AS rows, count(DISTINCT listing_id) AS distinct_keys, count(listing_id) AS non_null_keys,
       count(*) = count(DISTINCT listing_id) AND count(*) = count(listing_id) AS is_unique
FROM listing"""))


@query("b5_outlier_report")
def q_outliers(spark, sf_dir):
    return C.sort_report(C.outlier_report(listing_view(spark, sf_dir)))


_LCOLS = ("listing_id, listing_dt, listing_type, property_type, tenure, location, bedroom_count, "
          "bathroom_count, asking_price")
register("b5_outlier_report", with_ctes(LISTING, body="\nUNION ALL\n".join(
    f"SELECT '{name}' AS rule, {_LCOLS} FROM listing WHERE {cond}" for name, cond in [
        ("beds_over_10", "bedroom_count > 10"),
        ("beds_over_10_flat", "bedroom_count > 10 AND property_type = 'flat'"),
        ("beds_over_10_cheap", "bedroom_count > 10 AND asking_price <= 500000"),
        ("no_beds", "bedroom_count = 0"),
        ("no_beds_dear", "bedroom_count = 0 AND asking_price >= 300000"),
        ("baths_15_plus", "bathroom_count >= 15")])))


# ------------------------------------------------------------------ B1-B4, D3

@query("b3_b4_clean_listings")
def q_clean(spark, sf_dir):
    return cleaned_listings(spark, sf_dir)


register("b3_b4_clean_listings", with_ctes(LISTING, CLEANED, body="SELECT * FROM cleaned"))


@query("d3_describe_price")
def q_describe(spark, sf_dir):
    return rounded(PR.describe_column(cleaned_listings(spark, sf_dir), "asking_price"), 4)


register("d3_describe_price", with_ctes(LISTING, CLEANED, body="""
SELECT count(asking_price) AS count, round(avg(asking_price), 4) AS mean,
       round(stddev_samp(asking_price), 4) AS std, min(asking_price) AS min,
       round(quantile_cont(asking_price, 0.25), 4) AS p25, round(quantile_cont(asking_price, 0.5), 4) AS p50,
       round(quantile_cont(asking_price, 0.75), 4) AS p75, max(asking_price) AS max
FROM cleaned"""))


@query("d3_describe_price_by_type")
def q_describe_by(spark, sf_dir):
    return rounded(PR.describe_column(cleaned_listings(spark, sf_dir), "asking_price",
                                      by=["property_type"]), 4)


register("d3_describe_price_by_type", with_ctes(LISTING, CLEANED, body="""
SELECT property_type, count(asking_price) AS count, round(avg(asking_price), 4) AS mean,
       round(stddev_samp(asking_price), 4) AS std, min(asking_price) AS min,
       round(quantile_cont(asking_price, 0.25), 4) AS p25, round(quantile_cont(asking_price, 0.5), 4) AS p50,
       round(quantile_cont(asking_price, 0.75), 4) AS p75, max(asking_price) AS max
FROM cleaned GROUP BY property_type"""))


# ------------------------------------------------------------------ D12-D14

def _hist_sql(src: str, col: str, bins: int, by: list[str]) -> str:
    byc = ", ".join(by)
    bysel = f"{byc}, " if by else ""
    using = f"USING ({byc})" if by else "ON TRUE"
    grp = f"GROUP BY {byc}" if by else ""
    return f"""
hx AS (SELECT {bysel}{col} AS x FROM {src} WHERE {col} IS NOT NULL),
hs AS (SELECT {bysel}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hx {grp}),
hc AS (SELECT {bysel}CAST(least(floor((x - lo) * ({float(bins)!r} / (hi - lo))), {bins - 1}) AS INT) AS bin,
              count(*) AS cnt FROM hx JOIN hs {using} GROUP BY ALL),
hg AS (SELECT {bysel}CAST(b AS INT) AS bin, lo + b * ((hi - lo) / {bins}) AS bin_lo,
              CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * ((hi - lo) / {bins}) END AS bin_hi
       FROM hs, range(0, {bins}) t(b))"""


@query("d12_log_price_histogram")
def q_hist(spark, sf_dir):
    df = cleaned_listings(spark, sf_dir).select(F.log10("asking_price").alias("log10_asking_price"))
    return rounded(D.histogram(df, "log10_asking_price", bins=10), 9)


register("d12_log_price_histogram", with_ctes(LISTING, CLEANED, """
lp AS (SELECT log10(asking_price) AS log10_asking_price FROM cleaned)""" + "," + _hist_sql(
    "lp", "log10_asking_price", 10, []), body="""
SELECT hg.bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM hg LEFT JOIN hc USING (bin)"""))


@query("d14_daily_price_density_histogram")
def q_hist_density(spark, sf_dir):
    return rounded(D.histogram(daily_table(spark, sf_dir), "asking_price", bins=10,
                               by=["property_type"], density=True), 6, density=15)


register("d14_daily_price_density_histogram", with_ctes(LISTING, CLEANED, DAILY + "," + _hist_sql(
    "daily", "asking_price", 10, ["property_type"]), body="""
SELECT property_type, hg.bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count,
       round(coalesce(cnt, 0) / (sum(coalesce(cnt, 0)) OVER (PARTITION BY property_type) * (bin_hi - bin_lo)), 15)
         AS density
FROM hg LEFT JOIN hc USING (property_type, bin)"""))

# Bin edges of the zero-bedroom price histogram: 20 edges over the fixture's prices
# (its studios cost less than a million; the operator takes any edges).
STUDIO_EDGES = [1e5 + i * (9e5 / 19) for i in range(19)] + [1e6]


@query("d13_studio_price_histogram")
def q_hist_edges(spark, sf_dir):
    df = listing_view(spark, sf_dir).filter(F.col("bedroom_count") == 0)
    return rounded(D.histogram(df, "asking_price", edges=STUDIO_EDGES), 4)


def _edges_sql():
    cases = " ".join(f"WHEN asking_price < {e!r} THEN {i}" for i, e in enumerate(STUDIO_EDGES[1:-1]))
    vals = ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(zip(STUDIO_EDGES, STUDIO_EDGES[1:])))
    return with_ctes(LISTING, f"""
b AS (SELECT CASE WHEN asking_price < {STUDIO_EDGES[0]!r} OR asking_price > {STUDIO_EDGES[-1]!r} THEN NULL
                  {cases} ELSE {len(STUDIO_EDGES) - 2} END AS bin
      FROM listing WHERE bedroom_count = 0),
e AS (SELECT bin, CAST(bin_lo AS DOUBLE) AS bin_lo, CAST(bin_hi AS DOUBLE) AS bin_hi
      FROM (VALUES {vals}) t(bin, bin_lo, bin_hi))""", body="""
SELECT e.bin, round(bin_lo, 4) AS bin_lo, round(bin_hi, 4) AS bin_hi,
       (SELECT count(*) FROM b WHERE b.bin = e.bin) AS count FROM e""")


register("d13_studio_price_histogram", _edges_sql())


# ------------------------------------------------------------------ D4-D6, E1, D15, D16

@query("d4_daily_median_price")
def q_daily_median(spark, sf_dir):
    return rounded(daily_table(spark, sf_dir), 4)


register("d4_daily_median_price", with_ctes(LISTING, CLEANED, DAILY, body=f"""
SELECT {K}, listing_dt, round(asking_price, 4) AS asking_price FROM daily"""))


@query("d4_daily_mean_price")
def q_daily_mean(spark, sf_dir):
    return rounded(P.daily_price(cleaned_listings(spark, sf_dir), agg="mean"), 4)


register("d4_daily_mean_price", with_ctes(LISTING, CLEANED, body=f"""
SELECT {K}, listing_dt, round(avg(asking_price), 4) AS asking_price
FROM cleaned WHERE location IS NOT NULL GROUP BY {K}, listing_dt"""))


@query("d4_daily_log10_mean_price")
def q_daily_log_mean(spark, sf_dir):
    return rounded(P.daily_price(cleaned_listings(spark, sf_dir), agg="log10_mean"), 9)


register("d4_daily_log10_mean_price", with_ctes(LISTING, CLEANED, body=f"""
SELECT {K}, listing_dt, round(log10(avg(asking_price)), 9) AS asking_price
FROM cleaned WHERE location IS NOT NULL GROUP BY {K}, listing_dt"""))


@query("d5_daily_medians")
def q_daily_medians(spark, sf_dir):
    return rounded(P.daily_medians(cleaned_listings(spark, sf_dir),
                                   ["asking_price", "bedroom_count", "bathroom_count"]), 4)


register("d5_daily_medians", with_ctes(LISTING, CLEANED, body=f"""
SELECT {K}, listing_dt, round(quantile_cont(asking_price, 0.5), 4) AS asking_price,
       round(quantile_cont(CAST(bedroom_count AS DOUBLE), 0.5), 4) AS bedroom_count,
       round(quantile_cont(bathroom_count, 0.5), 4) AS bathroom_count
FROM cleaned WHERE location IS NOT NULL GROUP BY {K}, listing_dt"""))


@query("d6_group_mean_price")
def q_group_mean(spark, sf_dir):
    return rounded(P.group_mean(cleaned_listings(spark, sf_dir), KEYS, "asking_price"), 4)


register("d6_group_mean_price", with_ctes(LISTING, CLEANED, body=f"""
SELECT {K}, round(avg(asking_price), 4) AS asking_price FROM cleaned
WHERE location IS NOT NULL GROUP BY {K}"""))


@query("e1_group_median_price")
def q_group_median(spark, sf_dir):
    return rounded(P.with_group_median(cleaned_listings(spark, sf_dir)), 9, median_price=4)


register("e1_group_median_price", with_ctes(LISTING, CLEANED, body="""
SELECT property_type, location, asking_price, round(log10(asking_price), 9) AS log10_asking_price,
       CASE WHEN location IS NOT NULL THEN
         round(quantile_cont(asking_price, 0.5) OVER (PARTITION BY property_type, location), 4) END AS median_price
FROM cleaned"""))


@query("d15_box_stats")
def q_box(spark, sf_dir):
    df = cleaned_listings(spark, sf_dir).withColumn("log10_asking_price", F.log10("asking_price"))
    return rounded(P.box_stats(df), 9)


register("d15_box_stats", with_ctes(LISTING, CLEANED, f"""
v AS (SELECT {K}, log10(asking_price) AS x FROM cleaned WHERE location IS NOT NULL),
q AS (SELECT {K}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM v GROUP BY {K}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)""", body=f"""
SELECT {K}, count(x) AS n, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median,
       round(any_value(q3), 9) AS q3,
       round(min(CASE WHEN x >= lf AND x <= uf THEN x END), 9) AS whisker_low,
       round(max(CASE WHEN x >= lf AND x <= uf THEN x END), 9) AS whisker_high,
       count(CASE WHEN NOT (x >= lf AND x <= uf) THEN x END) AS outliers
FROM v JOIN f USING ({K}) GROUP BY {K}"""))


@query("d16_daily_price_kde")
def q_kde(spark, sf_dir):
    return rounded(D.kde(daily_table(spark, sf_dir), "asking_price", by=KEYS), 2, density=18)


register("d16_daily_price_kde", with_ctes(LISTING, CLEANED, DAILY, f"""
st AS (SELECT {K}, count(asking_price) AS n, stddev_samp(asking_price) * pow(count(asking_price), -0.2) AS bw,
              min(asking_price) AS mn, max(asking_price) AS mx FROM daily GROUP BY {K}),
g AS (SELECT {K}, n, bw, mn - 3.0 * bw AS glo, (mx + 3.0 * bw - (mn - 3.0 * bw)) / 99 AS step
      FROM st WHERE bw > 0)""", body=f"""
SELECT {K}, CAST(p AS INT) AS point, round(glo + p * step, 2) AS x,
       round(sum(exp(-0.5 * ((glo + p * step - asking_price) / bw) * ((glo + p * step - asking_price) / bw)))
             / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 18) AS density
FROM daily JOIN g USING ({K}), range(0, 100) t(p)
GROUP BY {K}, p, glo, step
UNION ALL SELECT {K}, NULL, NULL, NULL FROM st WHERE NOT coalesce(bw > 0, false)"""))


# ------------------------------------------------------------------ E3, I4, I5, I7, I8

@query("e3_days_since_start")
def q_days(spark, sf_dir):
    return rounded(G.days_since_start(daily_table(spark, sf_dir), KEYS, "listing_dt", "days"), 4)


register("e3_days_since_start", with_ctes(LISTING, CLEANED, DAILY, body=f"""
SELECT {K}, listing_dt, round(asking_price, 4) AS asking_price,
       CAST(date_diff('day', min(listing_dt) OVER (PARTITION BY {K}), listing_dt) AS INTEGER) AS days
FROM daily"""))


def _log_daily(spark, sf_dir):
    d = G.days_since_start(daily_table(spark, sf_dir), KEYS, "listing_dt", "days")
    return d.withColumn("log10_price", F.log10("asking_price"))


_LOG_DAILY_SQL = f"""
ld AS (SELECT {K}, listing_dt, log10(asking_price) AS log10_price,
              CAST(date_diff('day', min(listing_dt) OVER (PARTITION BY {K}), listing_dt) AS INTEGER) AS days
       FROM daily),
fits AS (SELECT {K}, regr_slope(log10_price, days) AS coef, regr_intercept(log10_price, days) AS intercept,
                regr_r2(log10_price, days) AS r2, CAST(regr_count(log10_price, days) AS BIGINT) AS n FROM ld GROUP BY {K})"""


@query("i4_trend_fit")
def q_trend(spark, sf_dir):
    fits = G.trend_fit(_log_daily(spark, sf_dir), KEYS, "days", "log10_price")
    return rounded(fits, 9, coef=14)


register("i4_trend_fit", with_ctes(LISTING, CLEANED, DAILY, _LOG_DAILY_SQL, body=f"""
SELECT {K}, round(coef, 14) AS coef, round(intercept, 9) AS intercept, round(r2, 9) AS r2, n FROM fits"""))


@query("i5_trend_predict")
def q_predict(spark, sf_dir):
    rows = _log_daily(spark, sf_dir)
    fits = G.trend_fit(rows, KEYS, "days", "log10_price")
    return rounded(G.trend_predict(rows, fits, KEYS, "days").select(*KEYS, "listing_dt", "days", "y_pred"), 9)


register("i5_trend_predict", with_ctes(LISTING, CLEANED, DAILY, _LOG_DAILY_SQL, body=f"""
SELECT {K}, listing_dt, days, round(intercept + coef * days, 9) AS y_pred FROM ld JOIN fits USING ({K})"""))


@query("i7_growth_log_linear")
def q_growth_log_linear(spark, sf_dir):
    fits = G.growth_log_linear(cleaned_listings(spark, sf_dir), KEYS)
    return rounded(G.growth_ranking(fits, "property_type", "growth_2_yr"), 9, coef=14)


register("i7_growth_log_linear", with_ctes(LISTING, CLEANED, f"""
rows_ AS (SELECT {K}, listing_dt, log10(asking_price) AS y FROM cleaned WHERE asking_price > 0 AND location IS NOT NULL),
xy AS (SELECT {K}, y, date_diff('day', min(listing_dt) OVER (PARTITION BY {K}), listing_dt) AS x FROM rows_),
fits AS (SELECT {K}, regr_slope(y, x) AS coef, regr_intercept(y, x) AS intercept,
                regr_r2(y, x) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n FROM xy GROUP BY {K})""", body=f"""
SELECT {K}, round(coef, 14) AS coef, round(intercept, 9) AS intercept, round(r2, 9) AS r2, n,
       round(pow(10.0, coef * 730), 9) AS growth_2_yr,
       CAST(row_number() OVER (PARTITION BY property_type ORDER BY pow(10.0, coef * 730) DESC NULLS LAST, location,
                          coef, intercept, r2, n) AS INTEGER) AS rank,
       pow(10.0, coef * 730) > 1 AS grew
FROM fits"""))


@query("h10_fit_messages")
def q_messages(spark, sf_dir):
    fits = G.growth_log_linear(cleaned_listings(spark, sf_dir), KEYS)
    return G.fit_messages(fits).select(*KEYS, "label", "message")


register("h10_fit_messages", with_ctes(LISTING, CLEANED, f"""
rows_ AS (SELECT {K}, listing_dt, log10(asking_price) AS y FROM cleaned WHERE asking_price > 0 AND location IS NOT NULL),
xy AS (SELECT {K}, y, date_diff('day', min(listing_dt) OVER (PARTITION BY {K}), listing_dt) AS x FROM rows_),
fits AS (SELECT {K}, regr_slope(y, x) AS coef, regr_intercept(y, x) AS intercept FROM xy GROUP BY {K})""", body=f"""
SELECT {K}, upper(property_type[1]) || lower(property_type[2:]) AS label,
       printf('%s - Slope: %.10f, Intercept: %.2f', property_type, coef, intercept) AS message
FROM fits"""))


# ------------------------------------------------------------------ I1-I3, I6, I8, I9, D11, I26

# Search of the SQL twin: a grid, then rounds of finer steps around each group's best.
REFINE_STEPS = (1e-2, 1e-3, 1e-4, 1e-5)
REFINE_HALF = 10


def boxcox_sql(lo: float = -5.0, hi: float = 5.0, step: float = 0.1) -> str:
    """CTEs bc_params (keys, normalize_lambda, log_gmean), bc_rows (daily rows
    with target) and bc_groups (keys, lambda, mean, std) over ``daily``."""
    z = "CASE WHEN abs(lam) < 1e-12 THEN u ELSE (exp(lam * u) - 1) / lam END"
    m = int(round((hi - lo) / step))
    h = REFINE_HALF
    parts = [f"""
bc_pos AS (SELECT {K}, asking_price AS x FROM daily WHERE asking_price > 0),
bc_gst AS (SELECT {K}, avg(ln(x)) AS lgm, count(x) AS n, min(x) AS mn, max(x) AS mx FROM bc_pos GROUP BY {K}),
bc_u AS (SELECT {K}, ln(x) - lgm AS u FROM bc_pos JOIN bc_gst USING ({K}) WHERE n >= 2 AND mx > mn),
bc_b0 AS (SELECT {K}, arg_min(lam, {{'v': v, 'l': lam}}) AS lam FROM (
  SELECT {K}, lam, var_pop({z}) AS v
  FROM (SELECT {K}, u, CAST({lo!r} AS DOUBLE) + i * CAST({step!r} AS DOUBLE) AS lam
        FROM bc_u, range(0, {m + 1}) t(i)) GROUP BY {K}, lam)
  GROUP BY {K})"""]
    refinements = len(REFINE_STEPS)
    for r, fine in enumerate(REFINE_STEPS, start=1):
        parts.append(f"""
bc_b{r} AS (SELECT {K}, arg_min(lam, {{'v': v, 'l': lam}}) AS lam FROM (
  SELECT {K}, lam, var_pop({z}) AS v
  FROM (SELECT {K}, u, b.lam + j * CAST({fine!r} AS DOUBLE) AS lam
        FROM bc_u JOIN bc_b{r - 1} b USING ({K}), range({-h}, {h + 1}) t(j))
  GROUP BY {K}, lam) GROUP BY {K})""")
    zr = "CASE WHEN abs(normalize_lambda) < 1e-12 THEN ln(asking_price) - log_gmean " \
         "ELSE (exp(normalize_lambda * (ln(asking_price) - log_gmean)) - 1) / normalize_lambda END"
    parts.append(f"""
bc_params AS (SELECT {K}, b.lam AS normalize_lambda, lgm AS log_gmean
              FROM bc_gst LEFT JOIN bc_b{refinements} b USING ({K})),
bc_z AS (SELECT d.*, normalize_lambda, log_gmean, {zr} AS z
         FROM daily d JOIN bc_params USING ({K}) WHERE asking_price > 0),
bc_zs AS (SELECT {K}, avg(z) AS zm, stddev_pop(z) AS zs FROM bc_z GROUP BY {K}),
bc_groups AS (SELECT {K}, normalize_lambda,
   exp(normalize_lambda * log_gmean) * zm + CASE WHEN abs(normalize_lambda) < 1e-12 THEN log_gmean
        ELSE (exp(normalize_lambda * log_gmean) - 1) / normalize_lambda END AS normalized_mean,
   exp(normalize_lambda * log_gmean) * zs AS normalized_std
   FROM bc_params JOIN bc_zs USING ({K})),
bc_rows AS (SELECT bc_z.{K.replace(', ', ', bc_z.')}, listing_dt, asking_price,
   CASE WHEN zs > 0 THEN (z - zm) / zs END AS target FROM bc_z JOIN bc_zs USING ({K})),
bc_fit_rows AS (SELECT *, date_diff('day', min(listing_dt) OVER (PARTITION BY {K}), listing_dt) AS days
                FROM bc_rows WHERE target IS NOT NULL),
bc_fits AS (SELECT {K}, regr_slope(target, days) AS coef, regr_intercept(target, days) AS intercept,
                   regr_r2(target, days) AS r2, CAST(regr_count(target, days) AS BIGINT) AS n FROM bc_fit_rows GROUP BY {K}),
bc_coefs AS (SELECT {K}, f.coef, f.intercept, f.r2, coalesce(f.n, 0) AS n, g.normalize_lambda, g.normalized_mean, g.normalized_std,
   CASE WHEN abs(g.normalize_lambda) < 1e-12 THEN exp(g.normalized_std * f.coef * {G.GROWTH_DAYS}.0)
        ELSE pow(1 + g.normalize_lambda * g.normalized_std * f.coef * {G.GROWTH_DAYS}.0
                 / (g.normalize_lambda * g.normalized_std * f.intercept + 1
                    + g.normalized_mean * g.normalize_lambda), 1 / g.normalize_lambda) END AS growth_975_days
   FROM bc_groups g LEFT JOIN bc_fits f USING ({K}))""")
    return ",".join(parts)


def boxcox_params_table(spark, sf_dir):
    return G.boxcox_fit(daily_table(spark, sf_dir), KEYS)


@query("i1_boxcox_fit")
def q_boxcox_fit(spark, sf_dir):
    return rounded(boxcox_params_table(spark, sf_dir), 5, log_gmean=9)


register("i1_boxcox_fit", with_ctes(LISTING, CLEANED, DAILY, boxcox_sql(), body=f"""
SELECT {K}, round(normalize_lambda, 5) AS normalize_lambda, round(log_gmean, 9) AS log_gmean FROM bc_params"""))


@query("i2_boxcox_transform")
def q_boxcox_transform(spark, sf_dir):
    daily = daily_table(spark, sf_dir).checkpoint(eager=True)
    rows, groups = G.boxcox_transform(daily, G.boxcox_fit(daily, KEYS), KEYS)
    return rounded(rows.select(*KEYS, "listing_dt", "asking_price", "target"), 4, target=6)


register("i2_boxcox_transform", with_ctes(LISTING, CLEANED, DAILY, boxcox_sql(), body=f"""
SELECT {K}, listing_dt, round(asking_price, 4) AS asking_price, round(target, 6) AS target FROM bc_rows"""))


@query("k2_daily_price_transformed")
def q_transform(spark, sf_dir):
    """Daily medians with a per-group transform plugged in: standardised Box-Cox values."""
    def standardised(daily):
        daily = daily.checkpoint(eager=True)
        return G.boxcox_transform(daily, G.boxcox_fit(daily, KEYS), KEYS)[0]
    out = P.daily_price(cleaned_listings(spark, sf_dir), "median", by=("location",), transform=standardised)
    return rounded(out.select(*KEYS, "listing_dt", "target"), 6)


register("k2_daily_price_transformed", with_ctes(LISTING, CLEANED, DAILY, boxcox_sql(), body=f"""
SELECT {K}, listing_dt, round(target, 6) AS target FROM bc_rows"""))


def coefs_table(spark, sf_dir):
    return G.boxcox_growth(daily_table(spark, sf_dir), KEYS)


_COEF_ROUND = dict(coef=12, intercept=6, r2=6, normalize_lambda=5, normalized_mean=3,
                   normalized_std=3, growth_975_days=6)


@query("i6_boxcox_growth_ranking")
def q_boxcox_growth(spark, sf_dir):
    ranked = G.growth_ranking(coefs_table(spark, sf_dir), "property_type", "growth_975_days")
    return rounded(ranked, 9, **_COEF_ROUND)


def _r(cols: dict) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in cols.items())


register("i6_boxcox_growth_ranking", with_ctes(LISTING, CLEANED, DAILY, boxcox_sql(), body=f"""
SELECT {K}, n, {_r(_COEF_ROUND)},
       CAST(row_number() OVER (PARTITION BY property_type ORDER BY growth_975_days DESC NULLS LAST, location, coef, intercept,
                          r2, n, normalize_lambda, normalized_mean, normalized_std) AS INTEGER) AS rank,
       growth_975_days > 1 AS grew
FROM bc_coefs"""))


@query("i9_qq_points")
def q_qq(spark, sf_dir):
    daily = daily_table(spark, sf_dir).checkpoint(eager=True)
    rows, _ = G.boxcox_transform(daily, G.boxcox_fit(daily, KEYS), KEYS)
    # One row per (town, type, day): groups bounded by the calendar.
    return rounded(D.qq_points(rows, KEYS, "target", method="window"), 6)


register("i9_qq_points", with_ctes(LISTING, CLEANED, DAILY, boxcox_sql(), f"""
qr AS (SELECT {K}, target AS sample, row_number() OVER (PARTITION BY {K} ORDER BY target) - 1 AS rank,
              count(*) OVER (PARTITION BY {K}) AS n FROM bc_rows WHERE target IS NOT NULL),
qm AS (SELECT *, CASE WHEN rank = 0 THEN 1 - pow(0.5, 1.0 / n) WHEN rank = n - 1 THEN pow(0.5, 1.0 / n)
                      ELSE (rank + 1 - 0.3175) / (n + 0.365) END AS m FROM qr),
qp AS (SELECT {K}, rank, n, {sql_norm_ppf('m')} AS theoretical, sample FROM qm)""", body=f"""
SELECT {K}, rank, n, round(theoretical, 6) AS theoretical, round(sample, 6) AS sample,
  round(min(theoretical) OVER w, 6) AS line_x0, round(max(theoretical) OVER w, 6) AS line_x1,
  round(min(sample) OVER w, 6) AS line_y0, round(max(sample) OVER w, 6) AS line_y1
FROM qp WINDOW w AS (PARTITION BY {K})"""))

_OBS_SQL = f"""
ob AS (SELECT {K}, asking_price, row_number() OVER (PARTITION BY {K} ORDER BY listing_dt) AS r,
              count(*) OVER (PARTITION BY {K}) AS n FROM daily),
obs AS (SELECT {K}, quantile_cont(CASE WHEN r <= 5 THEN asking_price END, 0.5) AS lower_act,
               quantile_cont(CASE WHEN r > n - 5 THEN asking_price END, 0.5) AS upper_act FROM ob GROUP BY {K})"""


@query("d11_observed_growth")
def q_observed(spark, sf_dir):
    return rounded(G.observed_growth(daily_table(spark, sf_dir), KEYS), 4, growth_act=9)


register("d11_observed_growth", with_ctes(LISTING, CLEANED, DAILY, _OBS_SQL, body=f"""
SELECT {K}, round(lower_act, 4) AS lower_act, round(upper_act, 4) AS upper_act,
       round(upper_act / lower_act, 9) AS growth_act FROM obs"""))


@query("i26_growth_check")
def q_growth_check(spark, sf_dir):
    daily = daily_table(spark, sf_dir).checkpoint(eager=True)
    coefs = G.boxcox_growth(daily, KEYS, materialise=False)
    return rounded(G.growth_check(coefs, daily, KEYS), 6, lower_pred=2, upper_pred=2,
                   lower_act=4, upper_act=4)


register("i26_growth_check", with_ctes(LISTING, CLEANED, DAILY, boxcox_sql(), _OBS_SQL, f"""
pr AS (SELECT {K}, growth_975_days AS growth_pred,
  CASE WHEN abs(normalize_lambda) < 1e-12 THEN exp(intercept * normalized_std + normalized_mean)
       ELSE pow((intercept * normalized_std + normalized_mean) * normalize_lambda + 1, 1 / normalize_lambda)
  END AS lower_pred,
  CASE WHEN abs(normalize_lambda) < 1e-12 THEN exp((coef * 975 + intercept) * normalized_std + normalized_mean)
       ELSE pow(((coef * 975 + intercept) * normalized_std + normalized_mean) * normalize_lambda + 1,
                1 / normalize_lambda) END AS upper_pred
  FROM bc_coefs)""", body=f"""
SELECT {K}, round(lower_pred, 2) AS lower_pred, round(upper_pred, 2) AS upper_pred,
       round(growth_pred, 6) AS growth_pred, round(lower_act, 4) AS lower_act, round(upper_act, 4) AS upper_act,
       round(upper_act / lower_act, 6) AS growth_act
FROM pr JOIN obs USING ({K})"""))
