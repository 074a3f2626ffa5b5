"""Model queries (K12-K15, M1-M7): rows-only checks (no SQL oracle exists for
iterative fits, but for the first boosted tree). Each fits on the training split and scores the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import boosting as BOOST
from churnlytics.operators import cox as COX
from churnlytics.operators import evaluate as E
from churnlytics.operators import features as X
from churnlytics.operators import models as M
from churnlytics.operators.enrich import drop_leakage
from churnlytics.plans.catalog import register
from churnlytics.session import cut_lineage
from churnlytics.plans.common import AS_OF, EV, contracts, rounded
from churnlytics.plans.oracle import oracle


def model_split(spark, sf_dir, variant="classifier"):
    """Model features, stratified split; the split is checkpointed to the
    shared checkpoint folder so the many fit jobs do not recompute it."""
    # Deletion-derived columns are dropped before any fit (event is kept)
    df = drop_leakage(M.build_features(contracts(spark, sf_dir, due_dates=False, region=True), AS_OF, variant))
    sp = cut_lineage(X.stratified_split(df))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


COX_NUMERIC = ["amount", "term_days"]


def cox_design(train, test):
    """Standardised numeric columns (fitted on train) + product and campaign indicators."""
    stats = X.fit_standardizer(train, COX_NUMERIC)
    vocab = X.fit_vocabulary(train, "campaign")
    feats = [f"{c}_z" for c in COX_NUMERIC] + ["is_3783"] + [f"campaign_{v}" for v in vocab[1:]]

    def prep(df):
        df = X.standardize(df, stats, "_z").withColumn("is_3783", (F.col("product_code") == "3783").cast("double"))
        df = X.one_hot(df, "campaign", vocab, drop_first=True)
        return df.withColumn("duration", F.col("days_from_start").cast("int"))
    return prep(train), prep(test), feats


@register("cox_fit")
def q_cox_fit(spark, sf_dir):
    train, test = model_split(spark, sf_dir, "survival")
    tr, _, feats = cox_design(train, test)
    model = COX.fit_cox_with_retry(tr, feats, ties="efron")
    return model.summary(spark)


@register("cox_predict")
def q_cox_predict(spark, sf_dir):
    train, test = model_split(spark, sf_dir, "survival")
    tr, te, feats = cox_design(train, test)
    model = COX.fit_cox_with_retry(tr, feats, ties="efron")
    return rounded(COX.predict_cox(model, te, horizon=180.0).select("id", "event", "churn_probability", "predicted"))


def _model_query(kind):
    def q(spark, sf_dir):
        train, test = model_split(spark, sf_dir)
        m = M.fit_model(train, kind)
        scored = M.predict(m, test)
        return rounded(E.evaluate(scored, "event", "predicted", "score").select(F.lit(kind).alias("model"), "*"))
    q.__doc__ = f"{kind}: fit on the training split, evaluate on the test split."
    return q


for _kind in M.KINDS:
    register(_kind)(_model_query(_kind))


def _network_query(kind, params):
    def q(spark, sf_dir):
        train, test = model_split(spark, sf_dir)
        scored = M.predict_network(M.fit_network(train, params), test)
        return rounded(E.evaluate(scored, "event", "predicted", "score").select(F.lit(kind).alias("model"), "*"))
    q.__doc__ = f"{kind}: dropout and early stop, fit on the training split, evaluate on the test split."
    return q


for _kind, _params in M.NETWORKS.items():
    register(_kind)(_network_query(_kind, _params))


@register("models_compared")
def q_models_compared(spark, sf_dir):
    """Every kind fitted on vectors prepared once, evaluated and compared."""
    train, test = model_split(spark, sf_dir)
    _, table = M.train_all(train, test)
    return rounded(table)


@register("random_forest_importance")
def q_rf_importance(spark, sf_dir):
    """M2/O3: the 10 largest random-forest feature importances (fit on the training split)."""
    train, _ = model_split(spark, sf_dir)
    m = M.fit_model(train, "random_forest")
    top = M.feature_importances(m, train, 10)
    return spark.createDataFrame([(n, float(v)) for n, v in top], "feature string, importance double")


BOOST_NUMERIC = ["amount", "term_days", "days_from_start"]
BOOST_CATEGORICAL = ["region_code", "product_code", "campaign"]


def _boost_query(kind, params):
    def q(spark, sf_dir):
        train, test = model_split(spark, sf_dir)
        model = BOOST.fit_boosted(train, BOOST_NUMERIC, BOOST_CATEGORICAL, params)
        scored = model.transform(test)
        return rounded(E.evaluate(scored, "event", "predicted", "score").select(F.lit(kind).alias("model"), "*"))
    q.__doc__ = f"{kind}: fit on the training split, evaluate on the test split."
    return q


register("boost_second_order")(_boost_query("boost_second_order", BOOST.SECOND_ORDER))
register("boost_leaf_wise")(_boost_query("boost_leaf_wise", BOOST.LEAF_WISE))


@register("boost_first_tree")
def q_boost_first_tree(spark, sf_dir):
    """M4: the first tree (two levels) of second-order boosting on amount and
    term of all contracts: splits, gains, contracts and leaf values."""
    df = M.build_features(contracts(spark, sf_dir, due_dates=False), AS_OF)
    model = BOOST.fit_boosted(df, BOOST_NUMERIC[1:], (), BOOST.Params(trees=1, depth=2), max_bins=16)
    return rounded(model.table(spark).select(
        "node", "feature", "threshold", F.col("gain"), "n", F.col("value")))


_TREE_SPLIT = """
{name}_c AS (
  SELECT e.feature, e.threshold, e.pos, count(*) FILTER (WHERE x.v <= e.threshold) AS nl, count(*) AS n,
         sum(q.p - x.event) FILTER (WHERE x.v <= e.threshold) AS gl, sum(q.p - x.event) AS g, any_value(q.p * (1 - q.p)) AS h
  FROM edges e JOIN (SELECT 'term_days' AS feature, term_days AS v, event FROM {rows}
                     UNION ALL SELECT 'days_from_start', days_from_start, event FROM {rows}) x ON x.feature = e.feature, q
  GROUP BY ALL
), {name} AS (
  SELECT feature, threshold, n, g, nl, gl, h,
         0.5 * (gl * gl / (nl * h + 1) + (g - gl) * (g - gl) / ((n - nl) * h + 1) - g * g / (n * h + 1)) AS gain
  FROM {name}_c WHERE nl * h >= 1 AND (n - nl) * h >= 1 ORDER BY round(gain, 9) DESC, pos, threshold LIMIT 1
)"""
oracle("boost_first_tree", """
SELECT * FROM (
  SELECT 0 AS node, feature, threshold, round(gain, 6) AS gain, n, 0.0 AS value FROM root
  UNION ALL SELECT 1, a.feature, a.threshold, round(a.gain, 6), a.n, round(-0.1 * a.g / (a.n * a.h + 1), 6) FROM a
  UNION ALL SELECT 2, b.feature, b.threshold, round(b.gain, 6), b.n, round(-0.1 * b.g / (b.n * b.h + 1), 6) FROM b
  UNION ALL SELECT CASE WHEN a.gain >= b.gain THEN 3 ELSE 5 END + s, NULL, NULL, 0.0, CASE s WHEN 0 THEN a.nl ELSE a.n - a.nl END,
         round(-0.1 * CASE s WHEN 0 THEN a.gl ELSE a.g - a.gl END / (CASE s WHEN 0 THEN a.nl ELSE a.n - a.nl END * a.h + 1), 6)
         FROM a, b, (SELECT unnest([0, 1]) AS s)
  UNION ALL SELECT CASE WHEN a.gain >= b.gain THEN 5 ELSE 3 END + s, NULL, NULL, 0.0, CASE s WHEN 0 THEN b.nl ELSE b.n - b.nl END,
         round(-0.1 * CASE s WHEN 0 THEN b.gl ELSE b.g - b.gl END / (CASE s WHEN 0 THEN b.nl ELSE b.n - b.nl END * b.h + 1), 6)
         FROM a, b, (SELECT unnest([0, 1]) AS s)
)
""", extra_ctes=f"""
ft AS (SELECT {EV} AS event, greatest(coalesce(end_insurance - start_insurance, -1), 0)::DOUBLE AS term_days,
              greatest(coalesce(DATE '{AS_OF}' - start_insurance, -1), 0)::DOUBLE AS days_from_start FROM contracts),
q AS (SELECT avg(event) AS p FROM ft),
edges AS (
  SELECT DISTINCT 'term_days' AS feature, 0 AS pos, unnest((SELECT quantile_cont(term_days, [k / 16 FOR k IN range(1, 16)]) FROM ft)) AS threshold
  UNION SELECT DISTINCT 'days_from_start', 1, unnest((SELECT quantile_cont(days_from_start, [k / 16 FOR k IN range(1, 16)]) FROM ft))
),""" + _TREE_SPLIT.format(name="root", rows="ft") + """,
l1 AS (SELECT ft.* FROM ft, root WHERE CASE root.feature WHEN 'term_days' THEN term_days ELSE days_from_start END <= root.threshold),
l2 AS (SELECT ft.* FROM ft, root WHERE CASE root.feature WHEN 'term_days' THEN term_days ELSE days_from_start END > root.threshold),
""" + _TREE_SPLIT.format(name="a", rows="l1") + "," + _TREE_SPLIT.format(name="b", rows="l2"))
