"""Kaplan-Meier survival operators.

Curves are computed on *distinct times*, not on contracts: contracts are
aggregated to ``(stratum, t) -> (events, rows)`` with map-side partial
aggregation; the at-risk count is a suffix sum and S(t) a running product
over the distinct times of each stratum (``partitionBy(stratum)``). The window
input is bounded by the number of distinct durations (days), whatever the
number of contracts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators.quantiles import quantiles
from churnlytics.session import cut_lineage
from churnlytics.schema import KM_CHECK_TIMES, KM_DURATION_CAP, KM_HORIZONS

Z95 = 1.959963984540054  # standard normal quantile 0.975


# --- K6 / K7 / K8: survival sets ---------------------------------------------------
def survival_frame(df: DataFrame, as_of: str | None = None, rule: str = "as_of", cap: int = KM_DURATION_CAP,
                   censor_to_cap: bool = False) -> DataFrame:
    """Add ``event`` and ``duration`` (days).

    * ``rule='as_of'`` (K6): event = deletion type != 0; duration = as_of - start,
      NULL -> -1 -> clipped to 0; ``time_until_event`` = report date - start for events.
    * ``rule='k7'``: event = deletion type > 0; duration = deletion date - start for
      events, end - start otherwise; NULL -> 0, clip >= 0, capped at ``cap``.
    * ``censor_to_cap`` (K8): censored rows are moved to ``cap``.
    """
    if rule == "as_of":
        if as_of is None:
            raise ValueError("as_of is required (never the wall clock)")
        out = df.withColumn("deletion_type", C.deletion_type("deletion_type"))  # P9: bad or NULL -> 0
        out = out.withColumn("event", C.event_flag("deletion_type"))
        out = out.withColumn("duration", C.day_diff_clipped(F.to_date(F.lit(as_of)), "start_insurance"))
        if "report_date" in df.columns:
            out = out.withColumn("time_until_event", F.when(
                (F.col("event") == 1) & F.col("start_insurance").isNotNull() & F.col("report_date").isNotNull(),
                F.datediff("report_date", "start_insurance")))
        out = out.withColumn("had_start", F.col("start_insurance").isNotNull())
    elif rule == "k7":
        out = df.withColumn("deletion_type", C.deletion_type("deletion_type"))
        out = out.withColumn("event", C.event_flag("deletion_type", strict_positive=True))
        raw = F.when(F.col("event") == 1, F.datediff("deletion_allowed_at", "start_insurance")) \
               .otherwise(F.datediff("end_insurance", "start_insurance"))
        out = out.withColumn("duration", F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(cap)))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    if censor_to_cap:
        out = out.withColumn("duration", F.when(F.col("event") == 0, F.lit(cap)).otherwise(F.col("duration")))
    return out


# --- K1 / K2 --------------------------------------------------------------------
def km_curve(df: DataFrame, time_col: str = "duration", event_col: str = "event",
             strata: Sequence[str] = (), min_size: int = 0, confidence: bool = False) -> DataFrame:
    """K1 (and K2 with ``confidence``): one row per stratum and distinct time.

    Columns: ``*strata, t, at_risk, events, survival`` (+ ``ci_lower, ci_upper``).
    A ``t = 0`` row is always present (S = 1 unless events happen at 0).
    ``min_size`` keeps strata with more rows than it (K5's ``n > 30``). Times
    are whole days: a fraction fails the query, as does a NULL event.
    """
    t = F.col(time_col)
    whole = F.when(t == F.floor(t), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{time_col} holds fractions of a day")).cast("boolean"))
    known = F.when(F.col(event_col).isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit(f"{event_col} is NULL for a contract with a {time_col}")).cast("boolean"))
    g = (df.where(t.isNotNull()).where(whole).where(known)
         .groupBy(*strata, F.col(time_col).cast("int").alias("t"))
         .agg(F.sum(F.col(event_col).cast("long")).alias("events"), F.count(F.lit(1)).alias("_rows")))
    part = Window.partitionBy(*strata)
    # t = 0 row per stratum, added in the same pass over the aggregated table
    # (the first row of each stratum also emits a zero row; re-aggregated by t)
    g = g.withColumn("_first", F.row_number().over(part.orderBy("t")) == 1)
    own = F.struct(F.col("t"), F.col("events"), F.col("_rows"))
    zero = F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("_rows"))
    g = (g.select(*strata, F.explode(F.when(F.col("_first"), F.array(own, zero)).otherwise(F.array(own))).alias("_r"))
         .select(*strata, "_r.*")
         .groupBy(*strata, "t").agg(F.sum("events").alias("events"), F.sum("_rows").alias("_rows")))
    suffix = part.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    prefix = part.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("at_risk", F.sum("_rows").over(suffix))
    if min_size:
        g = g.withColumn("_size", F.max("at_risk").over(part)).where(F.col("_size") > min_size).drop("_size")
    g = g.withColumn("survival", F.product(F.lit(1.0) - F.col("events") / F.col("at_risk")).over(prefix))
    if confidence:
        term = F.try_divide(F.col("events").cast("double"), F.col("at_risk") * (F.col("at_risk") - F.col("events")))
        g = g.withColumn("_v", F.sum(term).over(prefix))
        ls = F.log(F.col("survival"))
        lower = F.exp(-F.exp(F.log(-ls) + F.lit(Z95) * F.sqrt("_v") / ls))
        upper = F.exp(-F.exp(F.log(-ls) - F.lit(Z95) * F.sqrt("_v") / ls))
        s = F.col("survival")
        g = g.withColumn("ci_lower", F.when(s >= 1.0, 1.0).when(s <= 0.0, 0.0).otherwise(lower)) \
             .withColumn("ci_upper", F.when(s >= 1.0, 1.0).when(s <= 0.0, 0.0).otherwise(upper)).drop("_v")
    return g.drop("_rows")


# --- K5 strata ----------------------------------------------------------------------
def top_values(df: DataFrame, col: str, n: int) -> list:
    """The n most frequent values (ties by value; NULL is none) - at most n scalars."""
    rows = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(n).collect())
    return [r[0] for r in rows]


def quartile_edges(df: DataFrame, col: str) -> list[float]:
    """Distinct quartile edges (min, q25, q50, q75, max) with duplicates dropped."""
    rows = quantiles(df, col, [0.0, 0.25, 0.5, 0.75, 1.0]).orderBy("q").collect()
    edges = []
    for r in rows:
        if r["value"] is not None and (not edges or r["value"] > edges[-1]):
            edges.append(float(r["value"]))
    return edges


def fit_strata_all(df: DataFrame, columns: Sequence[str], top: int = 5, max_categorical: int = 10) -> dict:
    """K5 rules for several columns from ONE aggregation: value counts per
    (column, value) via an explode of a fixed-size array, then per column the
    top values and the distinct count (both bounded: at most ``top`` values
    and one number per column reach the driver). NULL is no value. Numeric columns with more
    than ``max_categorical`` distinct values get quartile edges instead."""
    dtypes = dict(df.dtypes)
    def num(c):
        is_num = dtypes[c] in ("int", "bigint", "double", "float", "smallint") or dtypes[c].startswith("decimal")
        return F.col(c).cast("double") if is_num else F.lit(None).cast("double")
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"),
                               num(c).alias("num")) for c in columns])
    counts = (df.select(F.explode(pairs).alias("p")).groupBy("p.variable", "p.value", "p.num")
              .agg(F.count(F.lit(1)).alias("n")))
    counts = cut_lineage(counts.where(F.col("value").isNotNull()))
    distinct = {r[0]: r[1] for r in counts.groupBy("variable").agg(F.count(F.lit(1))).collect()}
    rules = {}
    for c in columns:
        # the first of a sort with a limit: each task keeps ``top`` rows
        mine = (counts.where(F.col("variable") == c)
                .orderBy(F.col("n").desc(), F.col("num").asc_nulls_first(), F.col("value")).limit(top).collect())
        k = distinct.get(c, 0)
        numeric = dtypes[c] in ("int", "bigint", "double", "float", "smallint") or dtypes[c].startswith("decimal")
        if numeric and k > max_categorical:
            rules[c] = {"kind": "quartile", "edges": quartile_edges(df, c)}
        else:
            conv = (lambda v: None if v is None else (float(v) if dtypes[c] in ("double", "float") else
                                                      int(v) if dtypes[c] in ("int", "bigint", "smallint") else v))
            # order among equal counts follows the column's own order, as in ``top_values``
            vals = [conv(r["value"]) for r in mine]
            rules[c] = {"kind": "top", "values": vals}
    return rules


def stratum_expr(col: str, rule: dict, other: str = "Other") -> Column:
    """Apply a fitted stratum rule; quartile labels are bin numbers 0..k-1
    (right-closed bins, the first includes the minimum)."""
    c = F.col(col)
    if rule["kind"] == "quartile":
        e = rule["edges"]
        label = F.lit(None).cast("string")
        for i in range(len(e) - 2, -1, -1):
            cond = (c <= e[i + 1]) & ((c > e[i]) | F.lit(i == 0) & (c >= e[i]))
            label = F.when(cond, F.lit(str(i))).otherwise(label)
        return label
    vals = rule["values"]
    if not vals:
        return F.lit(other)
    return F.when(c.isin(vals), c.cast("string")).otherwise(F.lit(other))


def km_stratified(df: DataFrame, columns: Sequence[str], rules: dict | None = None,
                  time_col: str = "duration", event_col: str = "event", min_size: int = 30) -> DataFrame:
    """K5: curves for every stratification column in one job.

    Each contract contributes one ``(variable, stratum)`` row per column
    (explode of a fixed-size array), then one aggregation and one windowed
    pass over distinct times partitioned by (variable, stratum)."""
    rules = rules or fit_strata_all(df, columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), stratum_expr(c, rules[c]).alias("stratum"))
                      for c in columns])
    long = df.select(F.col(time_col), F.col(event_col), F.explode(pairs).alias("_p")) \
             .select("_p.variable", "_p.stratum", time_col, event_col).where(F.col("stratum").isNotNull())
    return km_curve(long, time_col, event_col, ["variable", "stratum"], min_size=min_size)


# --- K3 / K4 / K9 -------------------------------------------------------------------
def survival_at(curve: DataFrame, horizons: Sequence[int] = KM_HORIZONS, strata: Sequence[str] = (),
                nearest: bool = False) -> DataFrame:
    """K3 step lookup ``S(max t <= h)`` or K4 nearest timeline point
    (ties -> the earlier time). Works on the (small) curve table."""
    hz = curve.select("*", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon"))
    if nearest:
        key = F.struct(F.abs(F.col("t") - F.col("horizon")).alias("d"), F.col("t").alias("t"))
        return hz.groupBy(*strata, "horizon").agg(F.min_by("t", key).alias("t"),
                                                   F.min_by("survival", key).alias("survival"))
    return hz.where(F.col("t") <= F.col("horizon")).groupBy(*strata, "horizon").agg(
        F.max_by("survival", "t").alias("survival"))


def conditional_survival(rows: DataFrame, curve: DataFrame, horizon: float, at: str = "duration",
                         strata: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """K3/K4 at each contract's own time: ``rows`` with ``survival_now`` = S(t),
    ``survival_then`` = S(t + horizon) and ``conditional_survival``, their ratio
    (NULL where S(t) is 0 or the stratum has no curve). S is the last value
    before the time, or that of the nearest point."""
    from churnlytics.operators.asof import as_of_join
    way = "nearest" if nearest else "backward"
    now = as_of_join(rows, curve.withColumn("survival_now", F.col("survival")), at, "t", strata, ["survival_now"], way)
    then = as_of_join(now.withColumn("_then", F.col(at) + F.lit(horizon)),
                      curve.withColumn("survival_then", F.col("survival")), "_then", "t", strata, ["survival_then"], way)
    return then.drop("_then").withColumn("conditional_survival", F.try_divide("survival_then", "survival_now"))


def check_times(df: DataFrame, times: Sequence[int] = KM_CHECK_TIMES, time_col: str = "duration",
                event_col: str = "event") -> DataFrame:
    """K9: at each check time h: events with t <= h and rows at risk (t >= h), one scan."""
    aggs = []
    for h in times:
        aggs += [F.count_if((F.col(event_col) == 1) & (F.col(time_col) <= h)).alias(f"e_{h}"),
                 F.count_if(F.col(time_col) >= h).alias(f"r_{h}")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(int(h)).alias("time"), F.col(f"e_{h}").alias("events"),
                                                   F.col(f"r_{h}").alias("at_risk")) for h in times])).alias("s")) \
              .select("s.*")


# --- K10 / K11 predictions -----------------------------------------------------------
def fit_km_lookup(train: DataFrame, columns: Sequence[str], horizon: int = 1000, time_col: str = "duration",
                  event_col: str = "event", min_size: int = 30) -> dict:
    """K10 fit: stratum rules plus, per column, ``stratum -> S(t*)``.

    ``t*`` is the overall training curve's timeline point nearest to ``h``.
    The overall curve is one more pseudo-column (``_all``) of the same
    stratified aggregation, so every curve comes from one pass over the
    training rows; ``t*`` is found by a window over the (small) curve table.
    Strata other than the overall one need more than ``min_size`` rows; a
    stratum curve without the time ``t*`` gives no value. The collected
    result has at most (#columns x strata per column) rows."""
    rules = fit_strata_all(train, columns)
    rules["_all"] = {"kind": "top", "values": ["all"]}
    curves = km_stratified(train.withColumn("_all", F.lit("all")), ["_all", *columns], rules,
                           time_col, event_col, min_size=0)
    is_all = F.col("variable") == "_all"
    key = F.when(is_all, F.struct(F.abs(F.col("t") - F.lit(int(horizon))).alias("d"), F.col("t").alias("t")))
    curves = (curves.withColumn("_size", F.max("at_risk").over(Window.partitionBy("variable", "stratum")))
              .withColumn("_tstar", F.min_by("t", key).over(Window.partitionBy())))
    rows = curves.where((F.col("t") == F.col("_tstar")) & (is_all | (F.col("_size") > min_size))) \
                 .select("variable", "stratum", "survival").collect()
    lookup: dict = {c: {} for c in ["_all", *columns]}
    for r in rows:
        lookup[r["variable"]][r["stratum"]] = float(r["survival"])
    return {"rules": rules, "lookup": lookup, "columns": list(columns)}


def km_predict(train: DataFrame, test: DataFrame, columns: Sequence[str], horizon: int = 1000,
               threshold: float = 0.15, time_col: str = "duration", event_col: str = "event",
               min_size: int = 30, model: dict | None = None) -> DataFrame:
    """Churn probability ``1 - S(t*)`` per test contract: the overall
    value, overridden by each column's stratum curve that has ``t*`` (the last
    column wins). Scoring is a projection with literal map lookups (the fitted
    lookup is bounded), so test rows are neither joined nor shuffled.
    Adds ``churn_probability`` and ``predicted`` (probability > threshold)."""
    m = model or fit_km_lookup(train, columns, horizon, time_col, event_col, min_size)
    rules, lookup = m["rules"], m["lookup"]
    overall = lookup["_all"].get("all")
    surv = F.lit(overall).cast("double")
    for c in m["columns"]:
        table = lookup[c]
        if not table:
            continue
        pairs = []
        for k, v in sorted(table.items()):
            pairs += [F.lit(k), F.lit(v)]
        surv = F.coalesce(F.try_element_at(F.create_map(*pairs), stratum_expr(c, rules[c])), surv)
    out = test.withColumn("churn_probability", F.lit(1.0) - surv)
    return out.withColumn("predicted", (F.col("churn_probability") > threshold).cast("int"))


# Fixed values of K11: thresholds tried, by balanced accuracy, and the horizon.
ADJUSTED_THRESHOLDS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6)


def km_predict_adjusted(train: DataFrame, test: DataFrame, horizon: int = 180,
                        thresholds: Sequence[float] = ADJUSTED_THRESHOLDS, term_col: str = "term_days",
                        amount_col: str = "amount", time_col: str = "duration", event_col: str = "event",
                        tune_on: DataFrame | None = None) -> DataFrame:
    """``1 - S(horizon)`` of the overall training curve, adjusted by the
    contract's term and amount (against the median amount of ``tune_on``); the
    label is 1 above the threshold of the best balanced accuracy on ``tune_on``
    (the first of equals), which is ``train`` by default, so that no test row
    has a say in its own label. Adds ``adjusted_probability``, ``threshold`` and
    ``adjusted_predicted``."""
    from churnlytics.operators.evaluate import threshold_sweep
    at = survival_at(km_curve(train, time_col, event_col), [horizon]).first()
    base = 1.0 - (at["survival"] if at else 1.0)
    tune_on = train if tune_on is None else tune_on
    mid = quantiles(tune_on, amount_col, [0.5]).first()
    p = adjust_prediction(F.lit(base), F.col(term_col), F.col(amount_col), mid["value"] if mid else None)
    out = test.withColumn("adjusted_probability", p)
    best = threshold_sweep(tune_on.withColumn("adjusted_probability", p), thresholds, "adjusted_probability", event_col).where("best_balanced").first()
    return out.withColumn("threshold", F.lit(float(best["threshold"]))) \
              .withColumn("adjusted_predicted", (F.col("adjusted_probability") > F.col("threshold")).cast("int"))


def adjust_prediction(prob: Column, duration: Column, amount: Column, amount_median: float,
                      short: int = 180, long: int = 365) -> Column:
    """x1.2 if duration < 180, x0.8 if > 365, x0.9 if amount > median;
    clipped to [0.01, 0.99]."""
    p = prob * F.when(duration < short, 1.2).when(duration > long, 0.8).otherwise(1.0)
    p = p * F.when(amount > F.lit(amount_median), 0.9).otherwise(1.0)
    return F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))

