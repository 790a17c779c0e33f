"""Queries of the revision analysis and the revision model, with SQL twins.

Thresholds: the reference's (150 and 10 revisions) never fire on the fixture
tables, so the queries that exist to exercise C3/C4/C5 use the fixture
thresholds documented in FIXTURES.md (3 and 2); the modelling chain keeps 150.
Evaluation operators are checked over a stored score (a fixed formula of the
features) so that they are compared exactly and apart from the optimiser; the
fitted models have twins that take Newton steps in SQL (``model_sql``).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions.quantiles import without_null_keys
from ..operators import clean as C
from ..operators import comoments as CM
from ..operators import distribution as D
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import ml as ML
from ..operators import model as M
from ..operators import revisions as R
from ..operators import rows as RW
from ..operators import sparse_model as SM
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import REVISION_ORDER
from . import model_sql as MS
from .oracle import CLEANED, LISTING, REVISION, register, with_ctes
from .queries import cleaned_listings, query, revisions, rounded

FIX_MAX = 3
FIX_MIN = 2
SEED = 42
SAMPLE_ROWS = 500        # below the number of cleaned listings at every scale
LCOLS = ["listing_id", "listing_dt", "property_type", "tenure", "location", "bedroom_count",
         "bathroom_count", "asking_price"]
LC = ", ".join(LCOLS)
ORDER_STRUCT = "{'d': price_revision_dt, 'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}"


# ------------------------------------------------------------------ D9, E2, C3-C5, D7

@query("d9_revisions_by_date")
def q_by_date(spark, sf_dir):
    return R.revisions_by_date(revisions(spark, sf_dir))


register("d9_revisions_by_date", with_ctes(REVISION, body="""
SELECT price_revision_dt, count(revised_purchase_price) AS revision_count FROM revision GROUP BY price_revision_dt"""))


@query("d1_revisions_per_listing")
def q_rev_per_listing(spark, sf_dir):
    from ..operators.profile import value_counts
    return value_counts(revisions(spark, sf_dir), "listing_id")


register("d1_revisions_per_listing", with_ctes(REVISION, body="""
SELECT listing_id, count(*) AS count FROM revision GROUP BY listing_id"""))


@query("e2_revision_count")
def q_rev_count(spark, sf_dir):
    return rounded(R.with_revision_count(revisions(spark, sf_dir)), 4)


register("e2_revision_count", with_ctes(REVISION, body="""
SELECT listing_id, price_revision_dt, round(revised_purchase_price, 4) AS revised_purchase_price,
       l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY listing_id) AS revision_count
FROM revision"""))


@query("c4_drop_revision_outliers")
def q_drop_outliers(spark, sf_dir):
    return rounded(R.drop_revision_outliers(revisions(spark, sf_dir), FIX_MAX), 4)


register("c4_drop_revision_outliers", with_ctes(REVISION, body=f"""
SELECT listing_id, price_revision_dt, round(revised_purchase_price, 4) AS revised_purchase_price,
       l_linenumber, l_partkey, l_suppkey
FROM revision r WHERE NOT EXISTS (
  SELECT 1 FROM revision h WHERE h.listing_id = r.listing_id
  GROUP BY h.listing_id HAVING count(h.revised_purchase_price) > {FIX_MAX})"""))


@query("c3_frequent_revisers")
def q_frequent(spark, sf_dir):
    return R.frequent_revisers(cleaned_listings(spark, sf_dir), revisions(spark, sf_dir), FIX_MIN)


register("c3_frequent_revisers", with_ctes(LISTING, CLEANED, REVISION, body=f"""
SELECT c.listing_id, c.revision_count, {', '.join('l.' + x for x in LCOLS[1:])}
FROM (SELECT listing_id, count(revised_purchase_price) AS revision_count FROM revision GROUP BY listing_id
      HAVING count(revised_purchase_price) > {FIX_MIN}) c
JOIN cleaned l ON l.listing_id = c.listing_id"""))


@query("c5_top_reviser_history")
def q_top_history(spark, sf_dir):
    return rounded(R.top_reviser_history(revisions(spark, sf_dir), 5, FIX_MIN), 4)


register("c5_top_reviser_history", with_ctes(REVISION, f"""
top AS (SELECT listing_id FROM revision GROUP BY listing_id HAVING count(revised_purchase_price) > {FIX_MIN}
        ORDER BY count(revised_purchase_price) DESC, listing_id LIMIT 5)""", body="""
SELECT listing_id, price_revision_dt, round(revised_purchase_price, 4) AS revised_purchase_price,
       l_linenumber, l_partkey, l_suppkey
FROM revision WHERE listing_id IN (SELECT listing_id FROM top)"""))


@query("d7_last_revision")
def q_last(spark, sf_dir):
    last = R.last_per_key(revisions(spark, sf_dir), "listing_id", REVISION_ORDER,
                          ["price_revision_dt", "revised_purchase_price"])
    return rounded(last, 4)


register("d7_last_revision", with_ctes(REVISION, body=f"""
SELECT listing_id, arg_max(price_revision_dt, {ORDER_STRUCT}) FILTER (WHERE price_revision_dt IS NOT NULL)
         AS price_revision_dt,
       round(arg_max(revised_purchase_price, {ORDER_STRUCT}) FILTER (WHERE revised_purchase_price IS NOT NULL), 4)
         AS revised_purchase_price
FROM revision GROUP BY listing_id"""))

# ------------------------------------------------------------------ C1, C2, I15, D6, I27

LAST_REV = f"""
rev_kept AS (SELECT * FROM revision r WHERE NOT EXISTS (
  SELECT 1 FROM revision h WHERE h.listing_id = r.listing_id
  GROUP BY h.listing_id HAVING count(h.revised_purchase_price) > 150)),
last_rev AS (SELECT listing_id,
  arg_max(price_revision_dt, {ORDER_STRUCT}) FILTER (WHERE price_revision_dt IS NOT NULL) AS price_revision_dt,
  arg_max(revised_purchase_price, {ORDER_STRUCT}) FILTER (WHERE revised_purchase_price IS NOT NULL)
    AS revised_purchase_price
  FROM rev_kept GROUP BY listing_id),
c1 AS (SELECT c.*, l.price_revision_dt, l.revised_purchase_price FROM cleaned c LEFT JOIN last_rev l USING (listing_id)),
feat AS (SELECT *, CAST(coalesce(sign(revised_purchase_price - asking_price), 0) AS DOUBLE) AS revision,
   CAST(date_diff('day', listing_dt, (SELECT max(listing_dt) FROM c1)) AS INT) AS time_listed,
   CAST(isodow(listing_dt) - 1 AS INT) AS day_listed, CAST(weekofyear(listing_dt) AS INT) AS week_listed
   FROM c1)"""


def last_revision_table(spark, sf_dir):
    return R.with_last_revision(cleaned_listings(spark, sf_dir), revisions(spark, sf_dir), REVISION_ORDER)


def last_revision_features(spark, sf_dir):
    listings = cleaned_listings(spark, sf_dir)
    joined = R.with_last_revision(listings, revisions(spark, sf_dir), REVISION_ORDER)
    return R.add_revision_features(joined, newest_from=listings)


@query("c1_listing_last_revision")
def q_c1(spark, sf_dir):
    return rounded(last_revision_table(spark, sf_dir), 4)


register("c1_listing_last_revision", with_ctes(LISTING, CLEANED, REVISION, LAST_REV, body="""
SELECT * REPLACE (round(revised_purchase_price, 4) AS revised_purchase_price) FROM c1"""))


@query("i15_revision_features")
def q_i15(spark, sf_dir):
    return rounded(last_revision_features(spark, sf_dir), 4)


register("i15_revision_features", with_ctes(LISTING, CLEANED, REVISION, LAST_REV, body="""
SELECT * REPLACE (round(revised_purchase_price, 4) AS revised_purchase_price) FROM feat"""))


def exploration_table(spark, sf_dir):
    """Exploration table: all revisions joined (C2), features, rises dropped, label."""
    listings = cleaned_listings(spark, sf_dir)
    merged = R.with_all_revisions(listings, revisions(spark, sf_dir))
    out = C.label_revision(C.drop_price_rises(R.add_revision_features(merged, newest_from=listings)))
    return out.withColumn("log10_asking_price", F.log10("asking_price"))


EXPLORE = """
rc AS (SELECT r.*, count(*) OVER (PARTITION BY listing_id) AS revision_count FROM revision r),
rck AS (SELECT * FROM rc r WHERE NOT EXISTS (
  SELECT 1 FROM revision h WHERE h.listing_id = r.listing_id
  GROUP BY h.listing_id HAVING count(h.revised_purchase_price) > 150)),
c2 AS (SELECT c.*, r.price_revision_dt, r.revised_purchase_price, r.l_linenumber, r.l_partkey, r.l_suppkey,
              coalesce(r.revision_count, 0) AS revision_count
       FROM cleaned c LEFT JOIN rck r USING (listing_id)),
ex AS (SELECT * REPLACE (CAST(CASE WHEN revision = -1 THEN 1 WHEN revision = 0 THEN 0 END AS INT) AS revision),
              log10(asking_price) AS log10_asking_price
       FROM (SELECT *, CAST(coalesce(sign(revised_purchase_price - asking_price), 0) AS DOUBLE) AS revision,
               CAST(date_diff('day', listing_dt, (SELECT max(listing_dt) FROM c2)) AS INT) AS time_listed,
               CAST(isodow(listing_dt) - 1 AS INT) AS day_listed,
               CAST(weekofyear(listing_dt) AS INT) AS week_listed FROM c2)
       WHERE revision < 1)"""


@query("c2_listing_all_revisions")
def q_c2(spark, sf_dir):
    return rounded(exploration_table(spark, sf_dir), 4, log10_asking_price=9)


register("c2_listing_all_revisions", with_ctes(LISTING, CLEANED, REVISION, EXPLORE, body="""
SELECT * REPLACE (round(revised_purchase_price, 4) AS revised_purchase_price,
                  round(log10_asking_price, 9) AS log10_asking_price) FROM ex"""))


@query("d6_revision_rate_by_type_location")
def q_rate(spark, sf_dir):
    ex = exploration_table(spark, sf_dir)
    return rounded(without_null_keys(ex, ["property_type", "location"]).groupBy("property_type", "location").agg(
        F.avg("revision").alias("revision"), F.avg("revision_count").alias("revision_count"),
        F.avg("asking_price").alias("asking_price")), 9, asking_price=4)


register("d6_revision_rate_by_type_location", with_ctes(LISTING, CLEANED, REVISION, EXPLORE, body="""
SELECT property_type, location, round(avg(revision), 9) AS revision, round(avg(revision_count), 9) AS revision_count,
       round(avg(asking_price), 4) AS asking_price FROM ex
WHERE location IS NOT NULL GROUP BY property_type, location"""))


@query("i27_revision_scatter")
def q_scatter(spark, sf_dir):
    return rounded(R.revision_scatter(exploration_table(spark, sf_dir), 0.4, SEED), 9)


_FRAC = RW._fraction_threshold(0.4)
register("i27_revision_scatter", with_ctes(LISTING, CLEANED, REVISION, EXPLORE, body=f"""
SELECT listing_id, round(log10_asking_price, 9) AS log10_asking_price, bedroom_count, revision_count FROM ex
WHERE substr(md5(concat_ws('|', listing_id, price_revision_dt, l_linenumber, l_partkey, l_suppkey) || '-{SEED}'), 1, 8)
      < '{_FRAC}'"""))


# ------------------------------------------------------------------ F4-F7, B10, D18, D19

def model_dataset(spark, sf_dir):
    """Modelling table: last revision, features, rises dropped, label, nulls dropped,
    with the seeded shuffle key."""
    feat = last_revision_features(spark, sf_dir).withColumn("log10_asking_price", F.log10("asking_price"))
    ds = C.label_revision(C.drop_price_rises(feat)).select("listing_id", *FT.FEATURES, "revision")
    return ds.na.drop(subset=FT.FEATURES).withColumn("shuffle_key", RW.hash_key("listing_id", SEED))


DATASET = LAST_REV + f""",
ds AS (SELECT listing_id, {', '.join(FT.FEATURES)},
              CAST(CASE WHEN revision = -1 THEN 1 WHEN revision = 0 THEN 0 END AS INT) AS revision,
              md5(CAST(listing_id AS VARCHAR) || '-{SEED}') AS shuffle_key
       FROM (SELECT *, log10(asking_price) AS log10_asking_price FROM feat) WHERE revision < 1
         AND {' AND '.join(f'{c} IS NOT NULL' for c in FT.FEATURES)}),
split AS (SELECT *, row_number() OVER (ORDER BY shuffle_key, listing_id) - 1 AS row_idx,
                 count(*) OVER () AS n_rows FROM ds),
train AS (SELECT * EXCLUDE (n_rows) FROM split WHERE row_idx < n_rows - ceil(n_rows * 0.2e0))"""


@query("f4_model_dataset")
def q_dataset(spark, sf_dir):
    return rounded(model_dataset(spark, sf_dir), 9)


register("f4_model_dataset", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="""
SELECT * REPLACE (round(log10_asking_price, 9) AS log10_asking_price) FROM ds"""))


def split_table(spark, sf_dir):
    """The split for the modelling chain, which reads it several times: over the stored table."""
    return RW.train_test_split(model_dataset(spark, sf_dir).checkpoint(eager=True), "listing_id", 0.2, SEED)


@query("f7_train_test_split")
def q_split(spark, sf_dir):
    return rounded(RW.train_test_split(model_dataset(spark, sf_dir), "listing_id", 0.2, SEED, index_col="row_idx"), 9)


register("f7_train_test_split", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="""
SELECT * EXCLUDE (n_rows) REPLACE (round(log10_asking_price, 9) AS log10_asking_price),
       CASE WHEN row_idx < n_rows - ceil(n_rows * 0.2e0) THEN 'train' ELSE 'test' END AS split
FROM split"""))


@query("f4_seeded_shuffle")
def q_shuffle(spark, sf_dir):
    """The modelling table in its seeded order, with positions."""
    ds = model_dataset(spark, sf_dir).drop("shuffle_key")
    return rounded(RW.seeded_shuffle(ds, "listing_id", SEED, index_col="row_idx"), 9)


register("f4_seeded_shuffle", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="""
SELECT * EXCLUDE (n_rows) REPLACE (round(log10_asking_price, 9) AS log10_asking_price) FROM split"""))


@query("f6_sample_n")
def q_sample_n(spark, sf_dir):
    s = RW.sample_n(cleaned_listings(spark, sf_dir), SAMPLE_ROWS, "listing_id", SEED)
    return s.select("listing_dt", "asking_price", "location").orderBy("location", "listing_dt")


register("f6_sample_n", with_ctes(LISTING, CLEANED, body=f"""
SELECT listing_dt, asking_price, location FROM cleaned
ORDER BY md5(CAST(listing_id AS VARCHAR) || '-{SEED}'), listing_id LIMIT {SAMPLE_ROWS}"""))


@query("d18_class_balance")
def q_balance(spark, sf_dir):
    return EV.class_balance(split_table(spark, sf_dir))


register("d18_class_balance", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="""
SELECT CASE WHEN row_idx < n_rows - ceil(n_rows * 0.2e0) THEN 'train' ELSE 'test' END AS split, revision,
       count(*) AS count FROM split GROUP BY ALL"""))


def train_table(spark, sf_dir):
    return split_table(spark, sf_dir).filter(F.col("split") == "train").drop("split")


@query("d19_balanced_weights")
def q_weights(spark, sf_dir):
    w = FT.balanced_weights(train_table(spark, sf_dir), "revision")
    return rounded(w.groupBy("revision", "weight").agg(F.count(F.lit(1)).alias("rows")), 12)


register("d19_balanced_weights", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="""
SELECT revision, round((SELECT count(*) FROM train) / (2.0 * count(*)), 12) AS weight, count(*) AS rows
FROM train GROUP BY revision"""))


# ------------------------------------------------------------------ I10-I14, I24

@query("i11_mean_encoder")
def q_encoder(spark, sf_dir):
    enc = FT.MeanEncoder(FT.CATEGORICAL).fit(train_table(spark, sf_dir), "revision")
    return rounded(enc.mapping, 12)


register("i11_mean_encoder", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {c} AS value, round(avg(revision), 12) AS mean FROM train "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in FT.CATEGORICAL)))


@query("i24_location_encoding")
def q_loc_enc(spark, sf_dir):
    enc = FT.MeanEncoder(FT.CATEGORICAL).fit(train_table(spark, sf_dir), "revision")
    return rounded(enc.table("location"), 12)


register("i24_location_encoding", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="""
SELECT location, round(avg(revision), 12) AS mean FROM train GROUP BY location"""))


def transformed_train(spark, sf_dir):
    train = train_table(spark, sf_dir)
    fm = FT.fit_features(train, "revision")
    return fm.transform(train).select("listing_id", *FT.EXTENDED, "revision")


def _features_sql() -> str:
    enc = ",\n".join(f"enc_{c} AS (SELECT {c} AS v, avg(revision) AS m FROM train GROUP BY {c})"
                     for c in FT.CATEGORICAL)
    mm = ", ".join(f"min(CAST({c} AS DOUBLE)) AS {c}_min, max(CAST({c} AS DOUBLE)) AS {c}_max" for c in FT.SCALED)
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - {c}_min) / (CASE WHEN {c}_max - {c}_min = 0 THEN 1.0 "
        f"ELSE {c}_max - {c}_min END) AS {c}" for c in FT.SCALED)
    joins = " ".join(f"LEFT JOIN enc_{c} ON t.{c} = enc_{c}.v" for c in FT.CATEGORICAL)
    encs = ", ".join(f"enc_{c}.m AS {c}" for c in FT.CATEGORICAL)
    two_pi = repr(2 * math.pi)
    return f""",
{enc},
mm AS (SELECT {mm} FROM train),
tf AS (SELECT t.listing_id, {encs},
   sin(day_listed / {float(FT.DAY_PERIOD)!r} * {two_pi}) AS sin_day, cos(day_listed / {float(FT.DAY_PERIOD)!r} * {two_pi}) AS cos_day,
   sin(week_listed / {float(FT.WEEK_PERIOD)!r} * {two_pi}) AS sin_week,
   cos(week_listed / {float(FT.WEEK_PERIOD)!r} * {two_pi}) AS cos_week,
   {scaled}, t.revision
   FROM train t {joins}, mm)"""


FEATURES_SQL = _features_sql()


@query("i12_i13_feature_transform")
def q_features(spark, sf_dir):
    return rounded(transformed_train(spark, sf_dir), 12)


register("i12_i13_feature_transform", with_ctes(LISTING, CLEANED, REVISION, DATASET + FEATURES_SQL, body=f"""
SELECT listing_id, {', '.join(f'round({c}, 12) AS {c}' for c in FT.EXTENDED)}, revision FROM tf"""))


@query("k4_saved_pipeline")
def q_pipeline(spark, sf_dir):
    """The feature stages fitted as a pipeline, saved, loaded, and applied by the loaded one."""
    from pyspark.ml import Pipeline, PipelineModel
    train = train_table(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    Pipeline(stages=ML.reference_stages()).fit(train).write().save(path)
    return rounded(PipelineModel.load(path).transform(train).select("listing_id", *FT.EXTENDED, "revision"), 12)


register("k4_saved_pipeline", with_ctes(LISTING, CLEANED, REVISION, DATASET + FEATURES_SQL, body=f"""
SELECT listing_id, {', '.join(f'round({c}, 12) AS {c}' for c in FT.EXTENDED)}, revision FROM tf"""))


@query("i14_interactions")
def q_inter(spark, sf_dir):
    tf = FT.interactions(transformed_train(spark, sf_dir), "location", "time_listed")
    return rounded(tf.select("listing_id", "location", "time_listed", "location_x_time_listed"), 12)


register("i14_interactions", with_ctes(LISTING, CLEANED, REVISION, DATASET + FEATURES_SQL, body="""
SELECT listing_id, round(location, 12) AS location, round(time_listed, 12) AS time_listed,
       round(location * time_listed, 12) AS location_x_time_listed FROM tf"""))


@query("i10_one_hot")
def q_one_hot(spark, sf_dir):
    ds = model_dataset(spark, sf_dir).select("listing_id", *FT.CATEGORICAL)
    oh = FT.one_hot(ds, FT.CATEGORICAL)
    cols = [c for c in oh.columns if c != "listing_id"]
    return (oh.select("listing_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols])).alias("_f"))
        .select("listing_id", "_f.feature", "_f.value").filter(F.col("value") == 1.0))


register("i10_one_hot", with_ctes(LISTING, CLEANED, REVISION, DATASET, body="\nUNION ALL\n".join(
    f"SELECT listing_id, '{c}_' || {c} AS feature, 1.0::DOUBLE AS value FROM ds "
    f"WHERE (SELECT count(DISTINCT {c}) FROM ds) <> 2 OR {c} <> (SELECT min({c}) FROM ds)"
    for c in FT.CATEGORICAL)))


# ------------------------------------------------------------------ I16-I19, I23

def fitted(spark, sf_dir):
    # A fit materialises its own input.
    train = train_table(spark, sf_dir)
    tf = FT.fit_features(train, "revision").transform(train)
    res = M.fit_logistic_cv(tf, FT.EXTENDED, "revision", "shuffle_key")
    return tf, res.model, res


DRAFT_NUMERIC = ["bedroom_count", "time_listed"]
DRAFT_C = 0.1


@query("i16_logistic_fit")
def q_fit(spark, sf_dir):
    """The draft's model: one-hot categories, two numbers as they are, C = 0.1, balanced."""
    columns, model = SM.fit_one_hot_logistic(train_table(spark, sf_dir), FT.CATEGORICAL, DRAFT_NUMERIC, "revision", DRAFT_C)
    return rounded(SM.sparse_coefficients(columns, model), 5)


STEPS = 12                       # Newton steps of a twin; they double the digits
_CAT = ", ".join(f"({i}, '{c}', {c})" for i, c in enumerate(FT.CATEGORICAL))
_PICK = "CASE l.p " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(FT.CATEGORICAL)) + " END"
DRAFT_SQL = f""",
lv AS (SELECT DISTINCT t.p, t.c, t.v FROM train, LATERAL (VALUES {_CAT}) t(p, c, v)),
lv2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY p) AS n, min(v) OVER (PARTITION BY p) AS least FROM lv)
        WHERE n <> 2 OR v <> least),
lvs AS MATERIALIZED (SELECT list({{'p': p, 'c': c, 'v': v}} ORDER BY p, v) AS ls FROM lv2),
dx AS MATERIALIZED (SELECT list_concat(list_transform(ls, lambda l: CASE WHEN {_PICK} = l.v THEN 1e0 ELSE 0e0 END),
     [{', '.join(f'{c}::DOUBLE' for c in DRAFT_NUMERIC)}, 1e0]) AS x, revision::DOUBLE AS y,
     (count(*) OVER ()) / (2e0 * count(*) OVER (PARTITION BY revision)) AS w FROM train, lvs),
""" + MS.newton_over_lists("nb", "dx", repr(DRAFT_C), STEPS)
_DRAFT_NAMES = "['" + "', '".join([*DRAFT_NUMERIC, "intercept"]) + "']"
register("i16_logistic_fit", with_ctes(LISTING, CLEANED, REVISION, DATASET + DRAFT_SQL, body=f"""
SELECT unnest(list_concat(list_transform(ls, lambda l: l.c || '_' || l.v), {_DRAFT_NAMES})) AS name,
       round(unnest(beta), 5) AS coef FROM nb{STEPS}, lvs""").replace("WITH ", "WITH RECURSIVE ", 1))


@query("i17_logistic_cv")
def q_cv(spark, sf_dir):
    _, model, res = fitted(spark, sf_dir)
    rows = [(float(C), int(f), float(s), float(C) == res.C) for C, f, s in res.scores]
    return rounded(spark.createDataFrame(rows, "C double, fold int, f1 double, chosen boolean"), 12, C=99)


def search_sql(prefix: str, cols: list[str]) -> str:
    """CTEs of the search over ``cols`` of ``mrows``: ``{prefix}_f1(c, fold, f1)``, ``{prefix}_best(c)`` and
    the refitted model ``{prefix}_scored(revision, y_pred)``."""
    grid = ", ".join(f"({C!r}::DOUBLE)" for C in M.CS)
    x = [f"r.{c}" for c in cols] + ["1e0"]
    z = " + ".join(f"{v} * b.beta[{i}]" for i, v in enumerate(x, 1))
    return f"""
{prefix}_models AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c, fold) AS mid, c, fold::BIGINT AS fold
  FROM (VALUES {grid}) g(c), range({M.FOLDS}) t(fold)),
""" + MS.newton_over_columns(f"{prefix}n", "mrows", f"{prefix}_models", cols, STEPS) + f""",
{prefix}_f1 AS MATERIALIZED (
  SELECT c, m.fold, CASE WHEN sum((y = 1 OR pred)::INT) = 0 THEN 0 ELSE 2e0 * sum((y = 1 AND pred)::INT)
         / (2 * sum((y = 1 AND pred)::INT) + sum((y = 1 AND NOT pred)::INT) + sum((y = 0 AND pred)::INT)) END AS f1
  FROM (SELECT b.mid, r.y, ({z}) > 0 AS pred FROM {prefix}n{STEPS} b JOIN {prefix}_models m USING (mid) JOIN mrows r ON r.fold = m.fold)
  JOIN {prefix}_models m USING (mid) GROUP BY c, m.fold),
{prefix}_best AS MATERIALIZED (SELECT 0 AS mid, arg_min(c, {{'a': -round(mean, 15), 'c': c}}) AS c, NULL::BIGINT AS fold
  FROM (SELECT c, sum(f1) / {M.FOLDS} AS mean FROM {prefix}_f1 GROUP BY c)),
""" + MS.newton_over_columns(f"{prefix}r", "mrows", f"{prefix}_best", cols, STEPS) + f""",
{prefix}_scored AS MATERIALIZED (SELECT *, (proba > 0.5)::INT AS y_pred
  FROM (SELECT r.*, 1 / (1 + exp(-({z}))) AS proba FROM {prefix}r{STEPS} b, mrows r))"""


MODEL_ROWS = f""",
wrows AS MATERIALIZED (SELECT listing_id, {', '.join(f'tf.{c}' for c in FT.EXTENDED)}, tf.location * tf.time_listed AS location_x_time_listed,
    row_idx, tf.revision, tf.revision::DOUBLE AS y, (count(*) OVER ()) / (2e0 * count(*) OVER (PARTITION BY tf.revision)) AS w
  FROM tf JOIN train USING (listing_id)),""" + MS.stratified_folds("wrows", "revision", "row_idx", M.FOLDS) + """,
mrows AS MATERIALIZED (SELECT * FROM folded)"""
INTERACTED = FT.EXTENDED + ["location_x_time_listed"]


def _search(body: str, *searches: str) -> str:
    return with_ctes(LISTING, CLEANED, REVISION, DATASET + FEATURES_SQL + MODEL_ROWS, *searches,
                     body=body).replace("WITH ", "WITH RECURSIVE ", 1)


register("i17_logistic_cv", _search("""
SELECT a.c AS C, a.fold::INT AS fold, round(f1, 12) AS f1, a.c = a_best.c AS chosen FROM a_f1 a, a_best""",
                                    search_sql("a", FT.EXTENDED)))


@query("i19_score_and_confusion")
def q_score(spark, sf_dir):
    tf, model, _ = fitted(spark, sf_dir)
    return EV.confusion(M.score(model, tf, FT.EXTENDED))


# ------------------------------------------------------------------ I18, I20-I22, I25, D17, D20, D21

def stored_scores(spark, sf_dir, split: str = "train"):
    """Rows of one split scored by a fixed formula (for checking the evaluators)."""
    tr = split_table(spark, sf_dir).filter(F.col("split") == split).drop("split")
    z = (F.lit(-2.0) + F.lit(0.004) * F.col("time_listed") + F.lit(1.5) * (F.lit(6.0) - F.col("log10_asking_price"))
         + F.lit(0.1) * F.col("bedroom_count"))
    p = 1 / (1 + F.exp(-z))
    return tr.withColumn("proba", p).withColumn("y_pred", (p >= 0.5).cast("int"))


STORED = """,
sc AS (SELECT *, 1 / (1 + exp(-(-2.0e0 + 0.004e0 * time_listed + 1.5e0 * (6.0e0 - log10_asking_price)
                               + 0.1e0 * bedroom_count))) AS proba FROM train),
scored AS (SELECT *, CAST(proba >= 0.5 AS INT) AS y_pred FROM sc)"""

CELLS_SQL = """cells AS (SELECT * FROM (VALUES (0, 0, 'true_negative'), (0, 1, 'false_positive'),
  (1, 0, 'false_negative'), (1, 1, 'true_positive')) t(label, prediction, cell))"""


@query("i20_confusion")
def q_confusion(spark, sf_dir):
    return EV.confusion(stored_scores(spark, sf_dir))


register("i20_confusion", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, CELLS_SQL, body="""
SELECT c.label, c.prediction, c.cell, count(s.listing_id) AS count
FROM cells c LEFT JOIN scored s ON s.revision = c.label AND s.y_pred = c.prediction
GROUP BY c.label, c.prediction, c.cell"""))


@query("i20_confusion_test_split")
def q_confusion_test(spark, sf_dir):
    """The reference evaluates on training rows only; the held-out split is
    reported here as well."""
    return EV.confusion(stored_scores(spark, sf_dir, "test"))


register("i20_confusion_test_split", with_ctes(LISTING, CLEANED, REVISION, DATASET, CELLS_SQL, """
test_rows AS (SELECT * FROM split WHERE row_idx >= n_rows - ceil(n_rows * 0.2e0)),
scored_test AS (SELECT revision, CAST(1 / (1 + exp(-(-2.0e0 + 0.004e0 * time_listed
                  + 1.5e0 * (6.0e0 - log10_asking_price) + 0.1e0 * bedroom_count))) >= 0.5 AS INT) AS y_pred
                FROM test_rows)""", body="""
SELECT c.label, c.prediction, c.cell, count(s.revision) AS count
FROM cells c LEFT JOIN scored_test s ON s.revision = c.label AND s.y_pred = c.prediction
GROUP BY c.label, c.prediction, c.cell"""))


@query("i18_baseline_confusion")
def q_baseline(spark, sf_dir):
    tr = train_table(spark, sf_dir)
    return EV.confusion(M.fit_baseline(tr, "revision", "listing_id", SEED).predict(tr))


register("i18_baseline_confusion", with_ctes(LISTING, CLEANED, REVISION, DATASET, CELLS_SQL, f"""
bp AS (SELECT revision, CAST(CAST(('0x' || substr(md5(CAST(listing_id AS VARCHAR) || '-{SEED}'), 1, 8)) AS BIGINT)
                  AS DOUBLE) / {float(16 ** 8)!r} < (SELECT avg(CAST(revision AS DOUBLE)) FROM train) AS p FROM train)""",
    body="""
SELECT c.label, c.prediction, c.cell, count(bp.revision) AS count
FROM cells c LEFT JOIN bp ON bp.revision = c.label AND CAST(bp.p AS INT) = c.prediction
GROUP BY c.label, c.prediction, c.cell"""))


@query("i21_confusion_proba_histograms")
def q_cm_hist(spark, sf_dir):
    return rounded(EV.confusion_proba_histograms(stored_scores(spark, sf_dir)), 9)


register("i21_confusion_proba_histograms", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, CELLS_SQL, """
tagged AS (SELECT c.cell, s.proba AS x FROM scored s JOIN cells c ON s.revision = c.label AND s.y_pred = c.prediction),
hs AS (SELECT cell, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM tagged GROUP BY cell),
hc AS (SELECT cell, CAST(least(floor((x - lo) * (10.0 / (hi - lo))), 9) AS INT) AS bin, count(*) AS cnt
       FROM tagged JOIN hs USING (cell) GROUP BY ALL),
hg AS (SELECT cell, CAST(b AS INT) AS bin, lo + b * ((hi - lo) / 10) AS bin_lo,
              CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS bin_hi
       FROM hs, range(0, 10) t(b))""", body="""
SELECT cell, bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM hg LEFT JOIN hc USING (cell, bin)"""))


@query("i22_roc_curve")
def q_roc(spark, sf_dir):
    return rounded(EV.roc_points(stored_scores(spark, sf_dir)), 12)


register("i22_roc_curve", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, """
ps AS (SELECT proba AS threshold, sum(CAST(revision = 1 AS BIGINT)) AS pos, sum(CAST(revision = 0 AS BIGINT)) AS neg
       FROM scored GROUP BY proba),
cum AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS pos_cum, sum(neg) OVER (ORDER BY threshold DESC) AS neg_cum,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM ps)""", body="""
SELECT round(threshold, 12) AS threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, round(pos_cum / P, 12) AS tpr, round(neg_cum / N, 12) AS fpr,
       round(sum(neg * (pos_cum - pos + pos / 2.0) / (P * N)) OVER (), 12) AS auc
FROM cum
UNION ALL
SELECT NULL, 0, 0, 0.0, 0.0, round(sum(neg * (pos_cum - pos + pos / 2.0) / (P * N)), 12) FROM cum"""))

CORR_COLS = ["bedroom_count", "time_listed", "log10_asking_price", "revision", "proba"]


@query("d17_correlation_matrix")
def q_corr(spark, sf_dir):
    return rounded(EV.correlation_matrix(stored_scores(spark, sf_dir), CORR_COLS), 9)


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), "
                         f"CAST({b} AS DOUBLE)), 9) AS corr FROM scored")
    return "\nUNION ALL\n".join(parts)


register("d17_correlation_matrix", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, body=_corr_sql()))

SEGMENT_KEYS = ["property_type", "tenure", "location"]


def _segment(spark, sf_dir):
    """A fixed segment: one town, type and tenure."""
    return {"location": "NATION_10", "property_type": "house", "tenure": "freehold"}


@query("d20_segment_contrast")
def q_segment(spark, sf_dir):
    cols = ["bedroom_count", "time_listed", "day_listed", "week_listed"]
    return rounded(EV.segment_contrast(stored_scores(spark, sf_dir), _segment(spark, sf_dir),
                                       SEGMENT_KEYS, cols), 9)


register("d20_segment_contrast", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, body="""
SELECT property_type, tenure, location, y_pred, round(avg(CAST(bedroom_count AS DOUBLE)), 9) AS bedroom_count,
       round(avg(CAST(time_listed AS DOUBLE)), 9) AS time_listed, round(avg(CAST(day_listed AS DOUBLE)), 9) AS day_listed,
       round(avg(CAST(week_listed AS DOUBLE)), 9) AS week_listed
FROM scored WHERE revision = 0 AND location = 'NATION_10' AND property_type = 'house' AND tenure = 'freehold'
GROUP BY ALL"""))


@query("d21_false_positive_breakdown")
def q_fp(spark, sf_dir):
    return EV.false_positive_breakdown(stored_scores(spark, sf_dir), SEGMENT_KEYS, 10)


register("d21_false_positive_breakdown", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, body="""
SELECT property_type, tenure, location, count(*) AS false_positive_count FROM scored
WHERE revision = 0 AND y_pred = 1 GROUP BY ALL
ORDER BY false_positive_count DESC, property_type DESC, tenure DESC, location DESC LIMIT 10"""))


@query("i25_compare_models")
def q_compare(spark, sf_dir):
    a = stored_scores(spark, sf_dir)
    tr = train_table(spark, sf_dir)
    b = M.fit_baseline(tr, "revision", "listing_id", SEED).predict(tr)
    return EV.compare_models(a, b)


register("i25_compare_models", with_ctes(LISTING, CLEANED, REVISION, DATASET + STORED, CELLS_SQL, f"""
bp AS (SELECT revision, CAST(CAST(CAST(('0x' || substr(md5(CAST(listing_id AS VARCHAR) || '-{SEED}'), 1, 8)) AS BIGINT)
                  AS DOUBLE) / {float(16 ** 8)!r} < (SELECT avg(CAST(revision AS DOUBLE)) FROM train) AS INT) AS y_pred
       FROM train),
ca AS (SELECT c.label, c.prediction, c.cell, count(s.revision) AS count_a FROM cells c
       LEFT JOIN scored s ON s.revision = c.label AND s.y_pred = c.prediction GROUP BY ALL),
cb AS (SELECT c.label, c.prediction, count(s.revision) AS count_b FROM cells c
       LEFT JOIN bp s ON s.revision = c.label AND s.y_pred = c.prediction GROUP BY ALL)""", body="""
SELECT label, prediction, cell, count_a, count_b, count_b - count_a AS change FROM ca JOIN cb USING (label, prediction)"""))


def fitted_both(spark, sf_dir):
    """Training rows scored by the model without and with the (location x time_listed) interaction: the
    features as the models see them, the segment's own columns as ``raw_...``. The rows are made once
    and stored (split, folds and scores read them again), and both searches share their passes."""
    train = train_table(spark, sf_dir)
    tf = FT.fit_features(train, "revision").transform(train.withColumns({f"raw_{c}": F.col(c) for c in SEGMENT_KEYS}))
    tf = FT.interactions(tf, "location", "time_listed").checkpoint(eager=True)
    found = M.fit_logistic_cvs(tf, [FT.EXTENDED, INTERACTED], "revision", "shuffle_key")
    return [M.score(res.model, tf, cols) for res, cols in zip(found, (FT.EXTENDED, INTERACTED))]


@query("i25_interaction_model_comparison")
def q_interactions(spark, sf_dir):
    """Refit with the (location x time_listed) interaction and
    compare confusion cells of both models on the training rows."""
    return EV.compare_models(*fitted_both(spark, sf_dir))


register("i19_score_and_confusion", _search("""
SELECT c.label, c.prediction, c.cell, count(s.revision) AS count
FROM cells c LEFT JOIN a_scored s ON s.revision = c.label AND s.y_pred = c.prediction
GROUP BY c.label, c.prediction, c.cell""", search_sql("a", FT.EXTENDED), CELLS_SQL))

register("i25_interaction_model_comparison", _search("""
SELECT label, prediction, cell, count_a, count_b, count_b - count_a AS change FROM ca JOIN cb USING (label, prediction)""",
    search_sql("a", FT.EXTENDED), search_sql("b", INTERACTED), CELLS_SQL, """
ca AS (SELECT c.label, c.prediction, c.cell, count(s.revision) AS count_a FROM cells c
       LEFT JOIN a_scored s ON s.revision = c.label AND s.y_pred = c.prediction GROUP BY ALL),
cb AS (SELECT c.label, c.prediction, count(s.revision) AS count_b FROM cells c
       LEFT JOIN b_scored s ON s.revision = c.label AND s.y_pred = c.prediction GROUP BY ALL)"""))


def fitted_scores(spark, sf_dir):
    """Training rows (raw columns) with the fitted model's probability and prediction."""
    tf, model, _ = fitted(spark, sf_dir)
    scored = M.score(model, tf, FT.EXTENDED).select("listing_id", "proba", "y_pred")
    return train_table(spark, sf_dir).join(scored, "listing_id")


@query("d17_model_correlations")
def q_model_corr(spark, sf_dir):
    """D17 as the analysis runs it: the ten features as the model sees them, the target
    and the fitted probability."""
    tf, model, _ = fitted(spark, sf_dir)
    scored = M.score(model, tf, FT.EXTENDED).withColumnRenamed("revision", "target")
    return rounded(CM.comoments(scored, MODEL_CORR).select("col_a", "col_b", "corr"), 8)


MODEL_CORR = [*FT.EXTENDED, "target", "proba"]
register("d17_model_correlations", _search("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS corr FROM sc"
    for a in MODEL_CORR for b in MODEL_CORR), search_sql("a", FT.EXTENDED),
    "sc AS MATERIALIZED (SELECT *, y AS target FROM a_scored)"))

RAW_SCORED = """
raw_{0} AS MATERIALIZED (SELECT t.*, s.proba, s.y_pred FROM train t JOIN {0}_scored s USING (listing_id))"""


@query("d14_segment_density_by_prediction")
def q_segment_density(spark, sf_dir):
    """Density of time_listed among unrevised listings of one segment, apart by the fitted
    model's prediction."""
    rows = fitted_scores(spark, sf_dir).filter("revision = 0")
    for c, v in _segment(spark, sf_dir).items():
        rows = rows.filter(F.col(c) == v)
    return rounded(D.histogram(rows, "time_listed", bins=10, by=["y_pred"], density=True), 9)


register("d14_segment_density_by_prediction", _search("""
SELECT y_pred, bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, coalesce(cnt, 0) AS count,
       round(coalesce(cnt, 0) / (sum(coalesce(cnt, 0)) OVER (PARTITION BY y_pred) * (bin_hi - bin_lo)), 9) AS density
FROM sg LEFT JOIN sc USING (y_pred, bin)""", search_sql("a", FT.EXTENDED), RAW_SCORED.format("a"), """
seg AS (SELECT y_pred, time_listed::DOUBLE AS x FROM raw_a WHERE revision = 0 AND location = 'NATION_10'
        AND property_type = 'house' AND tenure = 'freehold'),
ss AS (SELECT y_pred, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM seg GROUP BY y_pred),
sc AS (SELECT y_pred, CAST(least(floor((x - lo) * (10.0 / (hi - lo))), 9) AS INT) AS bin, count(*) AS cnt
       FROM seg JOIN ss USING (y_pred) GROUP BY ALL),
sg AS (SELECT y_pred, CAST(b AS INT) AS bin, lo + b * ((hi - lo) / 10) AS bin_lo,
              CASE WHEN b = 9 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 10) END AS bin_hi FROM ss, range(0, 10) t(b))"""))


@query("i14_interaction_set")
def q_interaction_set(spark, sf_dir):
    """The refit's whole feature set: bias, both terms, their product, the rest untouched."""
    return rounded(FT.interaction_set(transformed_train(spark, sf_dir), "location", "time_listed", FT.EXTENDED,
                                      ["listing_id"]), 12)


_REST = [c for c in FT.EXTENDED if c not in ("location", "time_listed")]
register("i14_interaction_set", with_ctes(LISTING, CLEANED, REVISION, DATASET + FEATURES_SQL, body=f"""
SELECT listing_id, 1.0::DOUBLE AS bias, round(location, 12) AS location, round(time_listed, 12) AS time_listed,
       round(location * time_listed, 12) AS location_x_time_listed, {', '.join(f'round({c}, 12) AS {c}' for c in _REST)} FROM tf"""))


@query("i25_false_positives_of_both_models")
def q_fp_both(spark, sf_dir):
    """D21 of the model with and without the interaction, side by side."""
    scored = [s.select("revision", "y_pred", *[F.col(f"raw_{c}").alias(c) for c in SEGMENT_KEYS])
              for s in fitted_both(spark, sf_dir)]
    return EV.compare_false_positives(*scored, SEGMENT_KEYS, 10)


_FP_KEYS = ", ".join(SEGMENT_KEYS)
register("i25_false_positives_of_both_models", _search(f"""
SELECT {_FP_KEYS}, coalesce(fa.n, 0) AS count_a, coalesce(fb.n, 0) AS count_b, coalesce(fb.n, 0) - coalesce(fa.n, 0) AS change
FROM (SELECT {_FP_KEYS} FROM ta UNION SELECT {_FP_KEYS} FROM tb) LEFT JOIN fa USING ({_FP_KEYS}) LEFT JOIN fb USING ({_FP_KEYS})""",
    search_sql("a", FT.EXTENDED), search_sql("b", INTERACTED), RAW_SCORED.format("a"), RAW_SCORED.format("b"), *[f"""
f{m} AS (SELECT {_FP_KEYS}, count(*) AS n FROM raw_{m} WHERE revision = 0 AND y_pred = 1 GROUP BY ALL),
t{m} AS (SELECT * FROM f{m} ORDER BY n DESC, {', '.join(f'{k} DESC' for k in SEGMENT_KEYS)} LIMIT 10)""" for m in "ab"]))
