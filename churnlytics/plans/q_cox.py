"""Cox likelihood and fixed Newton steps (K12) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlytics.operators import cox as COX
from churnlytics.operators.survival import survival_frame
from churnlytics.plans.catalog import register
from churnlytics.plans.common import AS_OF, contracts, rounded
from churnlytics.plans.oracle import oracle

FEATURES = ["x0", "x1"]
BETA = [0.25, -0.4]
STEPS = 3


def cox_rows(spark, sf_dir):
    """Two covariates of every contract: the amount in tens, the second product."""
    s = survival_frame(contracts(spark, sf_dir, due_dates=False), AS_OF)
    return s.select("id", "event", "duration", (F.col("amount") / 10).alias("x0"),
                    (F.col("product_code") == 3783).cast("double").alias("x1"))


ROWS_SQL = f"""r AS (SELECT (deletion_type <> 0)::INTEGER AS e,
       greatest(coalesce((DATE '{AS_OF}' - start_insurance), -1), 0)::DOUBLE AS t,
       amount / 10 AS x0, (product_code = 3783)::INTEGER::DOUBLE AS x1 FROM contracts)"""


@register("cox_loglik")
def q_cox_loglik(spark, sf_dir):
    """Log-likelihood and gradient per row at a fixed beta, both kinds of ties."""
    rows = cox_rows(spark, sf_dir)
    out = []
    for ties in COX.TIES:
        ll, g, n = COX.log_likelihood(rows, FEATURES, BETA, ties=ties)
        out.append((ties, ll / n, float(g[0]) / n, float(g[1]) / n))
    return rounded(spark.createDataFrame(out, "ties string, loglik double, g0 double, g1 double"))


def _times_sql(b0: str, b1: str, src: str = "r") -> str:
    """Per distinct time: d, R0, R1_j, R2_jk, D0, D1_j, and the events' sums."""
    w = f"exp(x0 * ({b0}) + x1 * ({b1}))"
    cum = ", ".join(f"sum(sum({w}{m})) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS {n}" for m, n in (
        ("", "r0"), (" * x0", "r1_0"), (" * x1", "r1_1"), (" * x0 * x0", "r2_00"), (" * x0 * x1", "r2_01"),
        (" * x1 * x1", "r2_11")))
    own = ", ".join(f"sum(e * {w}{m}) AS {n}" for m, n in (("", "d0"), (" * x0", "d1_0"), (" * x1", "d1_1")))
    return (f"SELECT t, sum(e)::BIGINT AS d, {cum}, {own}, sum(e * x0) AS e0, sum(e * x1) AS e1, "
            f"sum(e * (x0 * ({b0}) + x1 * ({b1}))) AS exb FROM {src} GROUP BY t")


oracle("cox_loglik", """
SELECT ties, round((sum(exb) - sum(sl)) / max(n), 6) AS loglik, round((sum(e0) - sum(s0)) / max(n), 6) AS g0,
       round((sum(e1) - sum(s1)) / max(n), 6) AS g1
FROM (SELECT 'breslow' AS ties, exb, e0, e1, d * ln(r0) AS sl, d * r1_0 / r0 AS s0, d * r1_1 / r0 AS s1 FROM pt
      UNION ALL
      SELECT 'efron', max(exb), max(e0), max(e1), sum(CASE WHEN d > 0 THEN ln(r0 - f * d0) ELSE 0 END),
             sum(CASE WHEN d > 0 THEN (r1_0 - f * d1_0) / (r0 - f * d0) ELSE 0 END),
             sum(CASE WHEN d > 0 THEN (r1_1 - f * d1_1) / (r0 - f * d0) ELSE 0 END)
      FROM (SELECT *, l / greatest(d, 1) AS f FROM (SELECT *, unnest(generate_series(0, greatest(d, 1) - 1)) AS l FROM pt))
      GROUP BY t), (SELECT count(*) AS n FROM r)
GROUP BY ties
""", extra_ctes=f"{ROWS_SQL},\npt AS ({_times_sql(str(BETA[0]), str(BETA[1]))})")


@register("cox_fit_small")
def q_cox_fit_small(spark, sf_dir):
    """Three unpenalised Newton steps from 0 with Breslow ties, two covariates."""
    m = COX.fit_cox(cox_rows(spark, sf_dir), FEATURES, penalizer=0.0, ties="breslow", max_iter=STEPS, tol=0.0)
    return rounded(spark.createDataFrame([(f, float(b)) for f, b in zip(m.features, m.coef)],
                                         "feature string, coef double"))


def _newton_ctes(steps: int = STEPS) -> str:
    parts, b = [ROWS_SQL, "b0 AS (SELECT 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1)"], "b0"
    for k in range(1, steps + 1):
        parts.append(f"t{k} AS ({_times_sql('v0', 'v1', f'(SELECT * FROM r, {b})')})")
        parts.append(f"""g{k} AS (SELECT sum(e0 - d * r1_0 / r0) AS g0, sum(e1 - d * r1_1 / r0) AS g1,
  sum(d * (r2_00 / r0 - r1_0 * r1_0 / r0 / r0)) AS a, sum(d * (r2_01 / r0 - r1_0 * r1_1 / r0 / r0)) AS c,
  sum(d * (r2_11 / r0 - r1_1 * r1_1 / r0 / r0)) AS b FROM t{k})""")
        parts.append(f"b{k} AS (SELECT v0 + (b * g0 - c * g1) / (a * b - c * c) AS v0, "
                     f"v1 + (a * g1 - c * g0) / (a * b - c * c) AS v1 FROM {b}, g{k})")
        b = f"b{k}"
    return ",\n".join(parts)


oracle("cox_fit_small", f"SELECT 'x0' AS feature, round(v0, 6) AS coef FROM b{STEPS} "
       f"UNION ALL SELECT 'x1', round(v1, 6) FROM b{STEPS}", extra_ctes=_newton_ctes())


@register("cox_summary")
def q_cox_summary(spark, sf_dir):
    """Coefficients of ``cox_fit_small`` with their standard errors."""
    m = COX.fit_cox(cox_rows(spark, sf_dir), FEATURES, penalizer=0.0, ties="breslow", max_iter=STEPS, tol=0.0)
    return rounded(m.summary(spark).select("feature", "coef", "exp_coef", "se", "z"), 5)


oracle("cox_summary", f"""
SELECT feature, round(v, 5) AS coef, round(exp(v), 5) AS exp_coef, round(sqrt(var), 5) AS se, round(v / sqrt(var), 5) AS z
FROM (SELECT 'x0' AS feature, v0 AS v, b / (a * b - c * c) AS var FROM b{STEPS}, g{STEPS + 1}
      UNION ALL SELECT 'x1', v1, a / (a * b - c * c) FROM b{STEPS}, g{STEPS + 1})
""", extra_ctes=_newton_ctes(STEPS + 1))
