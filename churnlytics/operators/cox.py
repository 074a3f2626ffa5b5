"""Cox proportional-hazards model.

A pass evaluates the likelihood at one β on Spark and brings only p + p²
numbers to the driver, where the p x p step is solved:

1. per distinct time the sums of ``w = exp(x·β)`` and ``w·x`` over all rows and
   over the events (partial aggregation, 2 + 2p columns);
2. risk sets are suffix sums over the distinct times, by range buckets
   (``operators.buckets.running_sums``), so no task holds all times;
3. a small per-time table of tie terms gives the likelihood, the gradient and
   the outer products; the rest of the Hessian is ``Σ w x xᵀ`` with a weight
   per time, one more aggregation of the rows.

β reaches the executors as the value of a scalar subquery, so that the
generated code is the same on every pass.

Objective (our definition, stated because libraries differ in scaling):

    ℓ(β)/n − λ·[(1 − α)/2·‖β‖² + α·‖β‖₁]

with the partial log-likelihood ℓ under Efron (default) or Breslow ties. The
l1 part is exact (proximal Newton step by coordinate descent). Standard errors
come from the inverse observed information of the penalised objective (x n),
or, with ``robust``, from the sandwich of the rows' score residuals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlytics.operators.buckets import bucket_count, cut_points, running_sums, with_range_bucket
from churnlytics.session import cut_lineage

TIES = ("breslow", "efron")
EXPLICIT_TIES = 64  # tie groups up to this size are summed term by term: the closed form loses digits there


class CoxFitError(RuntimeError):
    """The fit did not converge."""


@dataclass
class CoxModel:
    features: list[str]
    coef: np.ndarray
    se: np.ndarray
    log_likelihood: float
    n: int
    n_events: int
    iterations: int
    converged: bool
    penalizer: float
    l1_ratio: float
    ties: str
    baseline: DataFrame  # (t, hazard): Breslow increments at the event times

    def summary(self, spark: SparkSession) -> DataFrame:
        """Coef, exp(coef), se, z, p per feature, sorted by p."""
        rows = []
        for f, b, s in zip(self.features, self.coef, self.se):
            z = float(b / s) if s > 0 else float("nan")
            p = math.erfc(abs(z) / math.sqrt(2.0)) if not math.isnan(z) else float("nan")
            rows.append((f, float(b), float(math.exp(b)), float(s), z, p))
        return spark.createDataFrame(rows, "feature string, coef double, exp_coef double, se double, z double, p double") \
            .orderBy("p", "feature")

    def cumulative_hazard_at(self, h: float) -> float:
        """Breslow H0 at the last event time <= h (0 before the first)."""
        return float(self.baseline.where(F.col("t") <= h).agg(F.sum("hazard")).first()[0] or 0.0)


def _linear(features: Sequence[str], beta: np.ndarray):
    expr = F.lit(0.0)
    for f, b in zip(features, beta):
        expr = expr + F.col(f).cast("double") * F.lit(float(b))
    return expr


def _digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x >= 1: recurrence up to 6, then the asymptotic series."""
    acc, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        low = x < 6.0
        acc[low] -= 1.0 / x[low]
        x[low] += 1.0
    f = 1.0 / (x * x)
    return acc + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _trigamma(x: np.ndarray) -> np.ndarray:
    """psi'(x) for x >= 1: recurrence up to 6, then the asymptotic series."""
    acc, x = np.zeros_like(x), x.copy()
    for _ in range(6):
        low = x < 6.0
        acc[low] += 1.0 / (x[low] * x[low])
        x[low] += 1.0
    f = 1.0 / (x * x)
    return acc + 1.0 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def tie_sums(d: np.ndarray, R0: np.ndarray, D0: np.ndarray, ties: str, explicit: int = EXPLICIT_TIES) -> dict:
    """Sums over the d tied events of each time, phi_l = R0 - (l/d) D0 (Efron)
    or R0 (Breslow): a = 1/phi, b = (l/d)/phi, c0 = 1/phi², c1 = (l/d)/phi²,
    c2 = (l/d)²/phi², slog = log phi; 0 where d is 0.

    Groups of up to ``explicit`` are summed term by term, larger ones in closed
    form (digamma, trigamma, log-gamma), exactly either way."""
    out = {k: np.zeros(len(d)) for k in ("a", "b", "c0", "c1", "c2", "slog")}
    some = d > 0
    if ties == "breslow":
        n, r = d[some], R0[some]
        out["a"][some], out["c0"][some], out["slog"][some] = n / r, n / (r * r), n * np.log(r)
        return out
    few = np.flatnonzero(some & (d <= explicit))
    for step in range(int(d[few].max(initial=0))):
        at = few[d[few] > step]
        fr = step / d[at]
        phi = R0[at] - fr * D0[at]
        for k, v in (("a", 1 / phi), ("b", fr / phi), ("c0", 1 / phi ** 2), ("c1", fr / phi ** 2),
                     ("c2", fr ** 2 / phi ** 2), ("slog", np.log(phi))):
            out[k][at] += v
    at = np.flatnonzero(some & (d > explicit))
    n, r, q = d[at], R0[at], D0[at]
    c = n * r / q  # phi_l = (D0 / d) (c - l), c >= d because R0 >= D0
    s1 = n / q * (_digamma(c + 1.0) - _digamma(c - n + 1.0))
    s2 = (n / q) ** 2 * (_trigamma(c - n + 1.0) - _trigamma(c + 1.0))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    out["a"][at], out["c0"][at] = s1, s2
    out["b"][at] = r / q * s1 - n / q
    out["c1"][at] = r / q * s2 - s1 / q
    out["c2"][at] = (r / q) ** 2 * s2 - 2 * r / q ** 2 * s1 + n / q ** 2
    out["slog"][at] = n * np.log(q / n) + lgamma(c + 1.0) - lgamma(c - n + 1.0)
    return out


class CoxPasses:
    """The rows of a fit (checkpointed once) and the passes over them."""

    def __init__(self, df: DataFrame, features: Sequence[str], time_col: str, event_col: str, ties: str):
        if ties not in TIES:
            raise ValueError(f"ties is one of {TIES}")
        self.p, self.ties = len(features), ties
        rows = cut_lineage(df.select(*[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)],
                                     F.col(time_col).cast("double").alias("t"),
                                     F.col(event_col).cast("double").alias("e")).na.drop())
        times = cut_lineage(rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")))
        self.rows = with_range_bucket(rows, "t", cut_points(times, "t", bucket_count(times.count())), "bucket")
        self.x = [F.col(f"x{j}") for j in range(self.p)]
        first = rows.agg(F.count(F.lit(1)), F.sum("e"), *[F.sum(F.col("e") * x) for x in self.x]).first()
        self.n, self.events = int(first[0] or 0), float(first[1] or 0.0)
        self.xe = np.array([float(v or 0.0) for v in first[2:]])

    def _risk(self, beta: np.ndarray):
        """exp(x·β), with β as a scalar subquery: the same code on every pass."""
        b = self.rows.sparkSession.range(1).select(F.array(*[F.lit(float(v)) for v in beta])).scalar()
        xb = F.lit(0.0)
        for j, x in enumerate(self.x):
            xb = xb + x * F.element_at(b, j + 1)
        return F.exp(xb)

    def per_time(self, beta: np.ndarray) -> DataFrame:
        """One row per distinct time: d, the risk-set sums R0, R1_j, the events'
        sums D0, D1_j and the tie terms (checkpointed)."""
        rows = self.rows.withColumn("w", self._risk(beta)).withColumn("ew", F.col("e") * F.col("w"))
        sums = [F.sum("e").alias("d"), F.sum("w").alias("R0"), F.sum("ew").alias("D0")]
        sums += [F.sum(F.col("w") * x).alias(f"R1_{j}") for j, x in enumerate(self.x)]
        sums += [F.sum(F.col("ew") * x).alias(f"D1_{j}") for j, x in enumerate(self.x)]
        per = cut_lineage(rows.groupBy("t", "bucket").agg(*sums))
        risk = ["R0", *[f"R1_{j}" for j in range(self.p)]]
        per = running_sums(per, "t", risk, descending=True)
        ties = self.ties

        def terms(frames):
            for pdf in frames:
                got = tie_sums(*(pdf[c].to_numpy(float) for c in ("d", "R0", "D0")), ties)
                yield pdf.assign(**got)

        schema = ", ".join(f"{c} {k}" for c, k in per.dtypes) + "".join(f", {c} double" for c in
                                                                      ("a", "b", "c0", "c1", "c2", "slog"))
        return cut_lineage(per.mapInPandas(terms, schema))

    def likelihood(self, beta: np.ndarray, per: DataFrame) -> tuple[float, np.ndarray]:
        """Log-likelihood and gradient."""
        row = per.agg(F.sum("slog"), *[F.sum(F.col("a") * F.col(f"R1_{j}") - F.col("b") * F.col(f"D1_{j}"))
                                       for j in range(self.p)]).first()
        return float(beta @ self.xe) - float(row[0] or 0.0), self.xe - np.array([float(v or 0.0) for v in row[1:]])

    def hessian(self, beta: np.ndarray, per: DataFrame) -> np.ndarray:
        pairs = [(j, k) for j in range(self.p) for k in range(j, self.p)]

        def c(name):
            return F.col(name)
        outer = per.agg(*[F.sum(c("c0") * c(f"R1_{j}") * c(f"R1_{k}")
                                - c("c1") * (c(f"R1_{j}") * c(f"D1_{k}") + c(f"D1_{j}") * c(f"R1_{k}"))
                                + c("c2") * c(f"D1_{j}") * c(f"D1_{k}")) for j, k in pairs]).first()
        # Σ_t a(t) Σ_{i at risk} w x xᵀ = Σ_i w x xᵀ Σ_{t <= t_i} a(t)
        until = running_sums(per.select("t", "bucket", F.col("a").alias("A"), "b"), "t", ["A"], descending=False)
        rows = self.rows.drop("bucket").join(until.select("t", "A", "b"), "t")
        rows = rows.withColumn("w", self._risk(beta) * (F.col("A") - F.col("e") * F.col("b")))
        inner = rows.agg(*[F.sum(F.col("w") * self.x[j] * self.x[k]) for j, k in pairs]).first()
        h = np.zeros((self.p, self.p))
        for (j, k), a, b in zip(pairs, inner, outer):
            h[j, k] = h[k, j] = -(float(a or 0.0) - float(b or 0.0))
        return h

    def score_products(self, beta: np.ndarray, per: DataFrame) -> np.ndarray:
        """Σ r rᵀ of the rows' score residuals (Lin-Wei, in Breslow's form):
        r = e (x - M(t)) - w Σ_{t' <= t} (x - M(t')) d/R0, M = R1/R0."""
        ev = per.select("t", "bucket", *[(F.col(f"R1_{j}") / F.col("R0")).alias(f"M_{j}") for j in range(self.p)],
                        (F.col("d") / F.col("R0")).alias("A"),
                        *[(F.col("d") * F.col(f"R1_{j}") / (F.col("R0") * F.col("R0"))).alias(f"C_{j}")
                          for j in range(self.p)])
        ev = running_sums(ev, "t", ["A", *[f"C_{j}" for j in range(self.p)]], descending=False).drop("bucket")
        rows = self.rows.drop("bucket").join(ev, "t").withColumn("w", self._risk(beta))
        rows = rows.select(*[(F.col("e") * (x - F.col(f"M_{j}")) - F.col("w") * (x * F.col("A") - F.col(f"C_{j}")))
                             .alias(f"r{j}") for j, x in enumerate(self.x)])
        pairs = [(j, k) for j in range(self.p) for k in range(j, self.p)]
        got = rows.agg(*[F.sum(F.col(f"r{j}") * F.col(f"r{k}")) for j, k in pairs]).first()
        out = np.zeros((self.p, self.p))
        for (j, k), v in zip(pairs, got):
            out[j, k] = out[k, j] = float(v or 0.0)
        return out


def log_likelihood(df: DataFrame, features: Sequence[str], beta: Sequence[float], time_col: str = "duration",
                   event_col: str = "event", ties: str = "efron") -> tuple[float, np.ndarray, int]:
    """Partial log-likelihood and gradient at a fixed β, and the number of rows."""
    passes = CoxPasses(df, features, time_col, event_col, ties)
    b = np.asarray(beta, float)
    return (*passes.likelihood(b, passes.per_time(b)), passes.n)


def _proximal_step(beta: np.ndarray, g: np.ndarray, q: np.ndarray, l1: float) -> np.ndarray:
    """argmin over s of -g·s + s'Qs/2 + l1·‖β + s‖₁ (coordinate descent; a plain
    solve without l1)."""
    if l1 == 0.0:
        try:
            return np.linalg.solve(q, g)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(q, g, rcond=None)[0]
    s = np.zeros_like(beta)
    for _ in range(1000):
        before = s.copy()
        for j in range(len(s)):
            if q[j, j] <= 0:
                continue
            z = beta[j] + s[j] + (g[j] - q[j] @ s) / q[j, j]
            s[j] = math.copysign(max(abs(z) - l1 / q[j, j], 0.0), z) - beta[j]
        if np.abs(s - before).max(initial=0.0) < 1e-12:
            break
    return s


def fit_cox(df: DataFrame, features: Sequence[str], time_col: str = "duration", event_col: str = "event",
            penalizer: float = 0.1, l1_ratio: float = 0.0, ties: str = "efron", max_iter: int = 50,
            tol: float = 1e-7, step_size: float = 1.0, robust: bool = False) -> CoxModel:
    """Penalised (proximal) Newton-Raphson with step halving. A step that
    does not improve the objective after all halvings is rejected and ends the
    fit. Rows with a NULL among the features, the time or the event are left out."""
    features = list(features)
    passes = CoxPasses(df, features, time_col, event_col, ties)
    n, p = max(passes.n, 1), len(features)
    ridge, l1 = penalizer * (1 - l1_ratio), penalizer * l1_ratio

    def objective(b):
        per = passes.per_time(b)
        ll, g = passes.likelihood(b, per)
        return ll / n - ridge * 0.5 * float(b @ b) - l1 * float(np.abs(b).sum()), ll, g / n - ridge * b, per

    beta = np.zeros(p)
    obj, ll, g, per = objective(beta)
    converged, it = False, 0
    for it in range(1, max_iter + 1):
        q = -passes.hessian(beta, per) / n + ridge * np.eye(p)
        step, delta = step_size, _proximal_step(beta, g, q, l1)
        if np.abs(delta).max(initial=0.0) < tol:
            converged = True
            break
        while True:
            cand = beta + step * delta
            new = objective(cand)
            if new[0] >= obj - 1e-12 or step < 1e-4:
                break
            step *= 0.5
        if new[0] < obj - 1e-12:
            break
        moved = float(np.max(np.abs(cand - beta), initial=0.0))
        beta, (obj, ll, g, per) = cand, new
        if moved < tol:
            converged = True
            break
    info = -passes.hessian(beta, per) + n * ridge * np.eye(p)
    try:
        cov = np.linalg.inv(info)
        if robust:
            cov = cov @ passes.score_products(beta, per) @ cov
        se = np.sqrt(np.clip(np.diag(cov), 0, None))
    except np.linalg.LinAlgError:
        se = np.full(p, float("nan"))
    baseline = per.where("d > 0").select("t", (F.col("d") / F.col("R0")).alias("hazard"))
    return CoxModel(features, beta, se, ll, passes.n, int(passes.events), it, converged, penalizer, l1_ratio, ties,
                    baseline)


def fit_cox_with_retry(df: DataFrame, features: Sequence[str], penalizers: Sequence[float] = (0.1, 0.5), **kw) -> CoxModel:
    """Ridge 0.1, retried with 0.5 when the fit does not converge
    (CoxFitError if none does; other errors come through)."""
    for pen in penalizers:
        m = fit_cox(df, features, penalizer=pen, **kw)
        if m.converged and np.all(np.isfinite(m.coef)):
            return m
    raise CoxFitError(f"Cox fit did not converge with penalizers {tuple(penalizers)}")


def predict_cox(model: CoxModel, df: DataFrame, horizon: float = 180.0, threshold: float = 0.5) -> DataFrame:
    """``S(h | x) = exp(-H0(h) · exp(x·β))``; churn = 1 - S. β and H0(h)
    are literals, so this is a map-only projection."""
    H0 = model.cumulative_hazard_at(horizon)
    risk = F.exp(_linear(model.features, model.coef))
    surv = F.exp(-F.lit(H0) * risk)
    return df.withColumn("partial_hazard", risk).withColumn("churn_probability", F.lit(1.0) - surv) \
             .withColumn("predicted", (F.col("churn_probability") > threshold).cast("int"))


def predict_with_fallback(train: DataFrame, test: DataFrame, features: Sequence[str], km_fallback=None,
                          horizon: float = 180.0, **kw) -> tuple[str, DataFrame]:
    """Cox -> Kaplan-Meier -> constant 0.5. Only a fit that does not
    converge leads on; any other error, also of the fallback, is raised."""
    try:
        return "cox", predict_cox(fit_cox_with_retry(train, features, **kw), test, horizon)
    except CoxFitError:
        if km_fallback is not None:
            return "kaplan_meier", km_fallback()
        return "constant", test.withColumn("churn_probability", F.lit(0.5)).withColumn("predicted", F.lit(1))
