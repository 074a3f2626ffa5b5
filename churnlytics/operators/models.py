"""Churn classifiers on Spark ML.

Training is distributed by Spark ML; only fitted models (bounded state) live
on the driver. The second-order and the leaf-wise trees are in ``boosting``;
``gbt_depth4`` and ``gbt_depth5`` are first-order trees of their depths. The
``mlp`` presets have no dropout or early stopping; ``fit_network`` has both.
"""

from __future__ import annotations

import math
import random
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (Bucketizer, ElementwiseProduct, Imputer, ImputerModel, OneHotEncoder, OneHotEncoderModel,
                                StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlytics.functions import columns as C
from churnlytics.operators import boosting, network, perceptron
from churnlytics.operators.evaluate import evaluate, model_comparison
from churnlytics.operators.features import class_weights, stratified_folds, with_class_weight
from churnlytics.operators.quantiles import quantiles_of_columns
from churnlytics.session import cut_lineage

# X11: the three feature sets (numeric columns, categories). The tuned set's
# age and birth month exist where the contracts have a birthday.
FEATURE_SETS = {
    "classifier": (["amount", "term_days", "days_from_start"], ["region_code", "product_code", "campaign"]),
    "survival": (["amount", "term_days", "days_from_start"], ["region_code", "product_code", "campaign"]),
    "tuned": (["amount", "term_days", "days_from_start", "age"],
              ["region_code", "product_code", "campaign", "birth_month"]),
}
NUMERIC_FEATURES, CATEGORICAL_FEATURES = FEATURE_SETS["classifier"]


def build_features(df: DataFrame, as_of: str, variant: str = "classifier") -> DataFrame:
    """X11: model features from a contract frame (no deletion-derived column).

    ``classifier`` and ``tuned`` count a missing date as 0 days; ``survival``
    takes 365 days for a missing term (at least 1) and 180 days since a missing
    start. The product code is a category. ``tuned`` adds age and birth month
    where ``df`` has a birthday."""
    if variant not in FEATURE_SETS:
        raise ValueError(f"variant is one of {sorted(FEATURE_SETS)}")
    today = F.to_date(F.lit(as_of))
    if variant == "survival":
        term, since = C.day_diff_clipped("end_insurance", "start_insurance", 365, 1), \
            C.day_diff_clipped(today, "start_insurance", 180, 0)
    else:
        term, since = C.day_diff_clipped("end_insurance", "start_insurance"), C.day_diff_clipped(today, "start_insurance")
    df = df.withColumn("deletion_type", C.deletion_type("deletion_type"))  # P9: bad or NULL -> 0
    out = df.withColumns({
        "event": C.event_flag("deletion_type"),
        "term_days": term.cast("double"),
        "days_from_start": since.cast("double"),
        "amount": F.col("amount").cast("double"),
        "product_code": F.col("product_code").cast("string"),
    })
    if variant == "tuned" and "birthday" in df.columns:
        out = out.withColumns({"age": F.greatest(C.age_years("birthday", today), F.lit(0.0)),
                               "birth_month": C.birth_month("birthday").cast("string")})
    return out


def columns_of(df: DataFrame, variant: str = "classifier") -> tuple[list[str], list[str]]:
    """Numeric and categorical columns of a feature set that ``df`` has."""
    numeric, categorical = FEATURE_SETS[variant]
    return [c for c in numeric if c in df.columns], [c for c in categorical if c in df.columns]


def preprocessor(numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES,
                 scale: bool = True, rows: int | None = None) -> list:
    """Median imputation + scaling for numeric columns, constant imputation
    + one-hot (unknown -> all zero, vocabulary sorted by name) for categories.
    With the number of training ``rows`` the scaling is by the population
    deviation, as X3 has it; Spark's scaler alone takes the sample deviation."""
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}_imp" for c in numeric])]
    stages.append(VectorAssembler(inputCols=[f"{c}_imp" for c in numeric], outputCol="num_vec", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="num_vec", outputCol="num_sample", withMean=True, withStd=True))
        up = math.sqrt(rows / (rows - 1)) if rows and rows > 1 else 1.0
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense([up] * len(numeric)), inputCol="num_sample",
                                         outputCol="num_scaled"))
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                                    outputCols=[f"{c}_oh" for c in categorical], dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=["num_scaled" if scale else "num_vec"] + [f"{c}_oh" for c in categorical],
                                  outputCol="features"))
    return stages


def fill_categories(df: DataFrame, categorical: Sequence[str] | None = None, value: str = "missing") -> DataFrame:
    """Constant imputation of categorical columns."""
    every = {c for _, cats in FEATURE_SETS.values() for c in cats}
    return df.na.fill({c: value for c in (categorical or df.columns) if c in df.columns and c in every})


# M1-M6 presets.
GBT_DEPTHS = {"gbt": 3, "gbt_depth4": 4, "gbt_depth5": 5}
MLP_LAYERS = {"mlp": [64, 32], "mlp_128": [128, 64, 32]}
KINDS = (*GBT_DEPTHS, "random_forest", "logistic_regression", *MLP_LAYERS)


def gbt(seed: int, **params) -> GBTClassifier:
    """Boosted trees: every level is one pass over the binned rows. A row finds
    its node by the few splits above it; a cached table of node ids, written
    again at every level, costs more than that and gives the same trees."""
    return GBTClassifier(labelCol="event", seed=seed, cacheNodeIds=False, checkpointInterval=10, maxMemoryInMB=512,
                         **params)


def make_estimator(kind: str, n_features: int | None = None, seed: int = 42, weight_col: str | None = None,
                   C_reg: float = 1.0, total_weight: float | None = None):
    """M1-M6 presets."""
    if kind in GBT_DEPTHS:
        return gbt(seed, maxIter=100, stepSize=0.1, maxDepth=GBT_DEPTHS[kind])
    if kind == "random_forest":
        return RandomForestClassifier(labelCol="event", numTrees=100, maxDepth=5, seed=seed)
    if kind == "logistic_regression":
        reg = 1.0 / (C_reg * total_weight) if total_weight else 0.0
        lr = LogisticRegression(labelCol="event", maxIter=1000, regParam=reg, standardization=False)
        if weight_col:
            lr.setWeightCol(weight_col)
        return lr
    if kind in MLP_LAYERS:
        if n_features is None:
            raise ValueError("mlp needs n_features")
        return MultilayerPerceptronClassifier(labelCol="event", layers=[n_features, *MLP_LAYERS[kind], 2], seed=seed,
                                              maxIter=100)
    raise ValueError(f"unknown model {kind!r}")


PART_ROWS, MOST_PART_ROWS = 16_384, 1_048_576
COUNTED_ROWS = 1_048_576  # more training rows are counted before trees and perceptrons are fitted


def partitions_of(rows: int, cores: int) -> int:
    """How many even partitions the fits pass over: one for 16,384 rows until
    there is one a core, then as many a core as keep them below 1,048,576 rows."""
    return max(1, min(-(-rows // PART_ROWS), cores * max(1, -(-rows // (cores * MOST_PART_ROWS)))))


def prepare(train: DataFrame, variant: str = "classifier", keep: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame]:
    """Fit the preprocessing once; the fitted pipeline and the training vectors
    ``(event, weight, features, *values_of(pipeline), *keep)``, checkpointed for the
    fits. ``weight`` balances the classes (X12). The vectors are dealt evenly: every
    pass of a fit lasts as long as its largest partition, and those of the input's
    files are few or uneven. Rows for one partition stay where they are."""
    train = fill_categories(train)
    weights = class_weights(train)
    rows = weights.agg(F.sum("n_class")).first()[0]
    prep = Pipeline(stages=preprocessor(*columns_of(train, variant), rows=rows)).fit(train)
    weighted = with_class_weight(train, weights)
    vectors = prep.transform(weighted).select("event", "weight", "features", *values_of(prep), *keep)
    parts = partitions_of(rows or 0, train.sparkSession.sparkContext.defaultParallelism)
    return prep, cut_lineage(vectors.repartition(parts) if parts > 1 else vectors)


def values_of(prep: PipelineModel) -> list[str]:
    """The columns behind the vectors: imputed numbers, then indices of categories."""
    return [c for kind, take in ((ImputerModel, "getOutputCols"), (OneHotEncoderModel, "getInputCols"))
            for s in prep.stages if isinstance(s, kind) for c in getattr(s, take)()]


def counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal training rows as one with their number ``n``, checkpointed: a sum over
    rows is the sum over these, each times ``n``."""
    return cut_lineage(df.groupBy("event", *keys).agg(F.count(F.lit(1)).alias("n")))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in even partitions, see ``partitions_of``."""
    return cut_lineage(df.repartition(partitions_of(df.count(), df.sparkSession.sparkContext.defaultParallelism)))


def tree_cuts(vectors: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Thresholds of every column: between all neighbours of up to ``bins`` values,
    at the exact quantiles k / ``bins`` of more. Spark ML takes its own by the same
    rule from a sample of some 10,000 rows."""
    long = vectors.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
                          .alias("e")).select("e.*").distinct()
    long = cut_lineage(long.where(F.col("value").isNotNull() & ~F.isnan("value")))
    sizes = {r["column"]: r["n"] for r in long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    few, many = ([c for c in columns if (sizes.get(c, 0) <= bins) == small] for small in (True, False))
    values, cuts = {c: set() for c in columns}, {}
    for r in long.where(F.col("column").isin(few)).collect():
        values[r["column"]].add(r["value"])
    for c in few:
        own = sorted(values[c]) or [0.0]
        cuts[c] = [(a + b) / 2 for a, b in zip(own, own[1:])] or own
    if many:
        quantiles = quantiles_of_columns(vectors.where(~F.greatest(*[F.isnan(c) for c in many], F.lit(False))), many,
                                         [k / bins for k in range(1, bins)])
        for r in quantiles.collect():
            values[r["column"]].add(r["value"])
        cuts |= {c: [math.nextafter(v, math.inf) for v in sorted(values[c])] for c in many}  # a bucket begins at its cut
    return [cuts[c] for c in columns]


def fit_binned_trees(prep: PipelineModel, vectors: DataFrame, est: GBTClassifier) -> PipelineModel:
    """Boosted trees on binned numbers: trees see no more of a number than its
    place among the thresholds, so rows of equal bins and categories are one with
    their number as weight. Their number is bounded by bins and categories however
    many rows there are, and the trees are those of all rows."""
    encoder = next((s for s in prep.stages if isinstance(s, OneHotEncoderModel)), None)
    indices = list(encoder.getInputCols()) if encoder else []
    numbers = [c for c in values_of(prep) if c not in indices]
    binner = Bucketizer(splitsArray=[[-math.inf, *cuts, math.inf] for cuts in tree_cuts(vectors, numbers, est.getMaxBins())],
                        inputCols=numbers, outputCols=[f"{c}_bin" for c in numbers], handleInvalid="keep")
    binned = VectorAssembler(inputCols=[f"{c}_bin" for c in numbers] + (list(encoder.getOutputCols()) if encoder else []),
                             outputCol="binned")
    rows = counted(binner.transform(vectors), [f"{c}_bin" for c in numbers] + indices)
    # a bucket is a place in an order here, not the category that the binner calls it
    rows = rows.withColumns({f"{c}_bin": F.col(f"{c}_bin").alias(f"{c}_bin", metadata={}) for c in numbers})
    rows = binned.transform(encoder.transform(rows) if encoder else rows)
    est = est.copy().setFeaturesCol("binned").setWeightCol("n")
    return PipelineModel(stages=[*prep.stages, binner, binned, est.fit(dealt(rows.select("event", "n", "binned")))])


def fit_counted_mlp(prep: PipelineModel, vectors: DataFrame, est: MultilayerPerceptronClassifier) -> PipelineModel:
    """Spark ML's perceptron with weights found by ``perceptron``: from the weights
    that the estimator starts with, by its iterations and stop, over equal rows
    counted once. The estimator then takes the weights as its own."""
    rows = counted(vectors, values_of(prep))
    parts = partitions_of(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    later = [s for s in prep.stages if not isinstance(s, (ImputerModel, StringIndexerModel))]
    some = vectors.limit(1).select("event", "features")
    start = est.copy({est.maxIter: 0}).fit(some).weights.toArray()
    flat, _ = perceptron.fit_perceptron(PipelineModel(stages=later).transform(rows), est.getLayers(), start, est.getMaxIter(),
                                        est.getTol(), parts)
    model = est.copy({est.maxIter: 0, est.initialWeights: Vectors.dense(flat)}).fit(some)
    model.clear(model.initialWeights)
    model.set(model.maxIter, est.getMaxIter())
    return PipelineModel(stages=[*prep.stages, model])


def fit_prepared(prep: PipelineModel, vectors: DataFrame, kind: str, seed: int = 42) -> PipelineModel:
    """One estimator on prepared vectors, as a pipeline with its preprocessing.
    Boosted trees and perceptrons of more than ``COUNTED_ROWS`` rows are fitted on
    counted rows; of fewer, the estimators read the rows in less time."""
    total = float(vectors.agg(F.sum("weight")).first()[0] or 0.0) if kind == "logistic_regression" else None
    width = len(vectors.first()["features"]) if kind in MLP_LAYERS else None
    est = make_estimator(kind, width, seed, "weight" if total else None, 1.0, total)
    fit_counted = fit_binned_trees if kind in GBT_DEPTHS else fit_counted_mlp if kind in MLP_LAYERS else None
    if fit_counted and vectors.count() > COUNTED_ROWS:
        return fit_counted(prep, vectors, est)
    return PipelineModel(stages=[*prep.stages, est.fit(vectors)])


def fit_model(train: DataFrame, kind: str, seed: int = 42, variant: str = "classifier") -> PipelineModel:
    """Fit preprocessing + one estimator as a single ``PipelineModel``."""
    return fit_prepared(*prepare(train, variant), kind, seed)


# M6 with dropout and a stop.
NETWORKS = {"network": network.SMALL, "network_large": network.LARGE}


def fit_network(train: DataFrame, params: network.Params = network.SMALL,
                variant: str = "classifier") -> tuple[PipelineModel, network.NetworkModel]:
    """M6: the fitted preprocessing and a network that stops early on held-out
    training rows, see ``network``. Score with ``predict_network``."""
    prep, vectors = prepare(train, variant, keep=[c for c in ("id",) if c in train.columns])
    return prep, network.fit_network(vectors, params)


def predict_network(fitted: tuple[PipelineModel, network.NetworkModel], df: DataFrame) -> DataFrame:
    """``df`` with ``score`` = P(event = 1) and ``predicted``."""
    prep, model = fitted
    return model.transform(prep.transform(fill_categories(df)))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Scores as plain columns: ``score`` = P(event = 1), ``predicted`` label."""
    out = model.transform(fill_categories(df))
    return out.withColumn("score", vector_to_array("probability")[1]) \
              .withColumn("predicted", F.col("prediction").cast("int"))


def feature_names(model: PipelineModel, df: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES) -> list[str]:
    """Names of the assembled feature vector slots (from the ML attribute
    metadata; scaled numeric slots are named after their input column)."""
    meta = model.transform(fill_categories(df.limit(1))).schema["features"].metadata.get("ml_attr", {})
    slots = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            name = a.get("name", f"f{a['idx']}")
            for prefix in ("num_scaled_", "num_vec_"):
                if name.startswith(prefix) and name[len(prefix):].isdigit() and int(name[len(prefix):]) < len(numeric):
                    name = numeric[int(name[len(prefix):])]
            slots[a["idx"]] = name
    return [slots.get(i, f"f{i}") for i in range(meta.get("num_attrs", len(slots)))]


def feature_importances(model: PipelineModel, df: DataFrame, top: int = 10) -> list[tuple[str, float]]:
    """M2/O3: the ``top`` feature importances of a tree model, by importance then name."""
    imp = model.stages[-1].featureImportances.toArray()
    names = feature_names(model, df)
    names += [f"f{i}" for i in range(len(names), len(imp))]
    return sorted(zip(names, map(float, imp)), key=lambda x: (-x[1], x[0]))[:top]


def save_models(models: dict, path: str) -> dict[str, str]:
    """M8: persist a registry of fitted pipelines, one directory per name."""
    out = {}
    for name, m in models.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        m.write().overwrite().save(out[name])
    return out


def load_models(names, path: str) -> dict:
    return {n: PipelineModel.load(f"{path.rstrip('/')}/{n}") for n in names}


def gbt_trials(n_trials: int, seed: int = 42) -> list[dict]:
    """M7 search space (seeded random draws): trees 50-500, learning rate
    0.01-0.3 (log), depth 3-10, subsample 0.5-1, min leaf 1-10, features of a
    split (all, square root, logarithm)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        out.append({"maxIter": rng.randint(50, 500) // 10 * 10,
                    "stepSize": round(10 ** rng.uniform(-2, math.log10(0.3)), 4),
                    "maxDepth": rng.randint(3, 10),
                    "subsamplingRate": round(rng.uniform(0.5, 1.0), 3),
                    "minInstancesPerNode": rng.randint(1, 10),
                    "featureSubsetStrategy": rng.choice(["all", "sqrt", "log2"])})
    return out


def tune_gbt(train: DataFrame, n_trials: int = 50, folds: int = 5, seed: int = 42, parallelism: int = 8,
             id_col: str = "id", variant: str = "classifier", trials: Sequence[dict] | None = None) -> PipelineModel:
    """M7 on Spark ML's trees: k-fold AUC over seeded random parameters; the best
    is refit on all training rows. The preprocessing is fitted once and its
    vectors are checkpointed; folds are balanced by class. A fit stops adding
    trees once the error of a tenth of its own training rows no longer falls,
    never by the fold that scores it, and the refit has the mean number of
    trees of the winner's fits. Every (trial, fold) is an independent Spark job
    from a thread pool. ``tune_boosting`` shares the passes instead."""
    from concurrent.futures import ThreadPoolExecutor
    trials = list(trials) if trials is not None else gbt_trials(n_trials, seed)
    prep, data = prepare(train, variant, keep=[id_col])
    data = cut_lineage(stratified_folds(data, folds, "event", id_col, seed, "_fold").withColumn(
        "_held", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10)) == 0))
    evaluator = BinaryClassificationEvaluator(labelCol="event", metricName="areaUnderROC")

    def score(job):
        ti, k = job
        model = gbt(seed, validationIndicatorCol="_held", **trials[ti]).fit(data.where(F.col("_fold") != k))
        return ti, evaluator.evaluate(model.transform(data.where(F.col("_fold") == k))), model.getNumTrees

    jobs = [(ti, k) for ti in range(len(trials)) for k in range(folds)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(score, jobs))
    mean_auc = {ti: sum(a for t, a, _ in results if t == ti) / folds for ti in range(len(trials))}
    best = max(sorted(mean_auc), key=lambda ti: mean_auc[ti])
    trees = max(1, round(sum(n for t, _, n in results if t == best) / folds))
    return PipelineModel(stages=[*prep.stages, gbt(seed, **{**trials[best], "maxIter": trees}).fit(data)])


def boosting_trials(n_trials: int, seed: int = 42) -> list[boosting.Params]:
    """M7: the draws of ``gbt_trials`` for the second-order trees, and the rows
    that a node needs to be split, 2-20."""
    rng = random.Random(seed + 1)
    return [boosting.Params(trees=t["maxIter"], rate=t["stepSize"], depth=t["maxDepth"], l2=0.0, min_hessian=1e-6,
                            min_rows=t["minInstancesPerNode"], min_split=rng.randint(2, 20),
                            subsample=t["subsamplingRate"], features=t["featureSubsetStrategy"], seed=seed)
            for t in gbt_trials(n_trials, seed)]


def tune_boosting(train: DataFrame, n_trials: int = 50, folds: int = 5, seed: int = 42, id_col: str = "id",
                  variant: str = "classifier", **how) -> tuple[boosting.BoostedModel, list[dict]]:
    """M7 on the second-order trees, see ``boosting.search``."""
    return boosting.search(train, *columns_of(train, variant), boosting_trials(n_trials, seed), folds, id_col=id_col, **how)


def train_all(train: DataFrame, test: DataFrame, kinds: Sequence[str] = KINDS,
              variant: str = "classifier", parallelism: int = 3) -> tuple[dict, DataFrame]:
    """M9: fit every kind on vectors prepared once, evaluate each on ``test``
    (E13) and compare (E10): the fitted pipelines by name, and one row a model.
    ``parallelism`` kinds are fitted at a time: a fit is hundreds of short jobs
    in sequence, between which the cores wait."""
    from concurrent.futures import ThreadPoolExecutor
    prep, vectors = prepare(train, variant)

    def fitted(kind):
        model = fit_prepared(prep, vectors, kind)
        return model, evaluate(predict(model, test), "event", "predicted", "score")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = dict(zip(kinds, pool.map(fitted, kinds)))
    return {k: m for k, (m, _) in done.items()}, model_comparison({k: r for k, (_, r) in done.items()})
