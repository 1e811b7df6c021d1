"""Return, churn, value and price models on Spark ML, with their splits, weights and metrics."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from tallyback.functions import columns as C
from tallyback.operators.bagged_trees import BaggedTrees, BaggedTreesModel
from tallyback.operators.kmeans import assign_clusters, fit_kmeans_grid
from tallyback.operators.moments import LinearFit, Moments, cross_validated, lasso, least_squares, moments, ridge
from tallyback.operators.neighbours import neighbour_vote
from tallyback.operators.ranks import global_row_number, total_before
from tallyback.plans.retention import FEATURES
from tallyback.session import cut_lineage
from tallyback.sources.tables import union_all

SEED = 42

# Inputs of the return classifiers.
RETURN_NUMERIC = ["total_amount", "item_count", "units", "max_price", "avg_product_rating", "tenure_days", "order_sequence"]
RETURN_CATEGORIES = ["dominant_category", "dominant_brand", "gender"]

_GRAIN = 1 << 53  # as fine as a double can tell

SPREAD_ROWS = 50_000  # fewer rows are fitted as they lie
CELLS_PER_TASK = 1 << 25  # vector entries that one task of a fit reads


def hash_share(*keys: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends only on the row's key: stable across runs and partitions."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(_GRAIN)) / F.lit(float(_GRAIN))


# ---------------------------------------------------------------- splits, weights, resampling


def stratified_split(df: DataFrame, key: str, label: str, train_share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Mark each row ``train`` or ``test`` by a hash of its class and key.

    Needs no shuffle and no per-class window; each class gets the share up to sampling noise.
    """
    return df.withColumn("part", F.when(hash_share(label, key, seed=seed) < train_share, "train").otherwise("test"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (2 n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (2.0 * F.col("class_rows")))


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class, two numbers."""
    return {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}


def weighted(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows with their balanced class weight as a literal per class."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (2.0 * n)).otherwise(weight)
    return df.withColumn(out, weight)


def balanced_downsample(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Thin each class to about the size of the smallest by a hash of the key."""
    counts = class_counts(df, label)
    smallest = min(counts.values())
    keep = F.lit(1.0)
    for value, n in counts.items():
        keep = F.when(F.col(label) == value, smallest / n).otherwise(keep)
    return df.filter(hash_share(key, seed=seed) < keep)


def balanced_oversample(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Repeat rows until each class has about the size of the largest; a row and its label stay together."""
    counts = class_counts(df, label)
    largest = max(counts.values())
    copies = F.lit(1)
    for value, n in counts.items():
        times = largest / n
        extra = (hash_share(key, seed=seed) < times - int(times)).cast("int")
        copies = F.when(F.col(label) == value, F.lit(int(times)) + extra).otherwise(copies)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


# ---------------------------------------------------------------- metrics


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows fold to one per distinct score before anything is ordered.
    """
    hit = F.col(label) == 1
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(hit).alias("positives"), F.count_if(~hit).alias("negatives")
    )
    placed = total_before(per_score, ["score"], "negatives", "negatives_below")
    won = F.sum(F.col("positives") * (F.col("negatives_below") + F.col("negatives") / 2.0))
    pairs = F.sum("positives") * F.sum("negatives").cast("double")
    return placed.agg(F.try_divide(won, F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def classifier_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: ROC-AUC, precision, recall and F1 at the threshold (0 when undefined), rows."""
    hit, called = F.col(label) == 1, F.col(score) >= threshold
    counts = scored.agg(
        F.count_if(hit & called).alias("tp"), F.count_if(~hit & called).alias("fp"), F.count_if(hit & ~called).alias("fn"),
        F.count(F.lit(1)).alias("test_rows"),
    )
    zero = F.lit(0.0)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(C.ratio(part.cast("double"), whole), zero)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        roc_auc(scored, label, score).scalar().alias("roc_auc"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "test_rows",
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: MAE, RMSE and R2 on the given scale."""
    error = F.col(predicted) - F.col(actual)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0)))).alias("r2"),
        F.count(F.lit(1)).alias("test_rows"),
    )


# ---------------------------------------------------------------- features


def mixed_feature_pipeline(numeric: list[str], categories: list[str], out: str = "features") -> Pipeline:
    """Median-imputed, standardised numbers next to one-hot categories; unseen levels become all zero.

    The indexer gives an unseen level the last index, which is the one the encoder drops.
    """
    filled = [f"{c}_filled" for c in numeric]
    indexed, coded = [f"{c}_index" for c in categories], [f"{c}_onehot" for c in categories]
    return Pipeline(
        stages=[
            Imputer(inputCols=numeric, outputCols=filled, strategy="median", relativeError=1e-4),
            VectorAssembler(inputCols=filled, outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
            StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=coded, handleInvalid="error", dropLast=True),
            VectorAssembler(inputCols=["scaled", *coded], outputCol=out),
        ]
    )


def numeric_feature_pipeline(columns: list[str], out: str = "features") -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol=out, withMean=True, withStd=True),
        ]
    )


def return_frame(mart: DataFrame) -> DataFrame:
    """Order mart cut down to what the return classifiers use, split marked."""
    numbers = [F.col(c).cast("double").alias(c) for c in RETURN_NUMERIC]
    narrow = mart.select("order_id", F.col("returned").alias("label"), *numbers, *RETURN_CATEGORIES)
    return stratified_split(narrow, "order_id", "label")


def churn_frame(panel: DataFrame) -> DataFrame:
    """Panel cut down to features and outcome."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    return panel.select(
        "user_id",
        "snapshot_date",
        F.concat_ws("|", "user_id", F.date_format("snapshot_date", "yyyyMMdd")).alias("row_key"),
        F.col("churn").alias("label"),
        "future_spend",
        *numbers,
    )


# ---------------------------------------------------------------- classifiers


@dataclass
class Candidate:
    """A classifier, whether its rows are weighted or resampled, and which features it reads."""

    name: str
    make: Callable[[], object] | None
    balance: str = "none"  # none, weights, oversample, downsample
    neighbours: int = 0


# The tree was unbounded in the study, limited only by leaf size; Spark ML allows a depth of 30. Forests have no such limit.
DEEP = 30


@dataclass
class EarlyStoppedNetwork:
    """Spark ML's network, which can't stop early by itself, trained some iterations at a time.

    A tenth of the rows, drawn by hash of the vector so that copies of a row stay together, is held out. Each round goes on
    from the weights of the last one; training ends when ``patience`` rounds have not lowered the held-out log loss by
    ``tolerance``, and the best round's model is kept.
    """

    hidden: tuple[int, ...]
    max_iterations: int
    seed: int = SEED
    step: int = 20
    patience: int = 2
    tolerance: float = 1e-4

    def fit(self, rows: DataFrame):
        held_out = (F.pmod(F.xxhash64(vector_to_array("features"), F.lit(self.seed)), F.lit(10)) == 0).alias("held")
        marked = rows.select("label", "features", held_out).persist(StorageLevel.MEMORY_AND_DISK)  # in the parts of ``rows``, for all rounds
        train, held = marked.filter("NOT held").drop("held"), marked.filter("held").drop("held")
        if held.isEmpty() or train.isEmpty():
            train = held = marked.drop("held")
        width = train.first()["features"].size
        loss = MulticlassClassificationEvaluator(metricName="logLoss")
        best, model, idle = (float("inf"), None), None, 0
        for done in range(0, self.max_iterations, self.step):
            network = MultilayerPerceptronClassifier(layers=[width, *self.hidden, 2], maxIter=min(self.step, self.max_iterations - done), seed=self.seed)
            if model is not None:
                network = network.setInitialWeights(model.weights)
            model = network.fit(train)
            now = loss.evaluate(model.transform(held))
            idle = 0 if now < best[0] - self.tolerance else idle + 1
            if now < best[0]:
                best = (now, model)
            if idle >= self.patience:
                break
        marked.unpersist()
        return best[1] or model


def return_candidates() -> list[Candidate]:
    return [
        Candidate("Logistic regression", lambda: LogisticRegression(maxIter=1000, standardization=False), "weights"),
        Candidate("Decision tree", lambda: DecisionTreeClassifier(maxDepth=DEEP, minInstancesPerNode=10, seed=SEED), "weights"),
        Candidate("kNN", None, "downsample", neighbours=15),
        Candidate(
            "Random forest",
            lambda: BaggedTrees(trees=300, min_leaf=3, seed=SEED),
            "weights",
        ),
        Candidate("Gradient boosting", lambda: GBTClassifier(maxIter=100, stepSize=0.05, maxDepth=2, seed=SEED), "weights"),
        Candidate("Neural network", lambda: EarlyStoppedNetwork(hidden=(32, 16), max_iterations=400, seed=SEED), "oversample"),
    ]


def churn_candidates() -> list[Candidate]:
    return [
        Candidate("Logistic L2", lambda: LogisticRegression(maxIter=1500, standardization=False)),
        Candidate("Logistic L1 balanced", lambda: LogisticRegression(maxIter=1500, elasticNetParam=1.0, standardization=False), "weights"),
        Candidate("kNN", None, neighbours=25),
        Candidate("Decision tree balanced", lambda: DecisionTreeClassifier(maxDepth=5, minInstancesPerNode=25, seed=SEED), "weights"),
        Candidate(
            "Random forest balanced",
            lambda: BaggedTrees(trees=250, min_leaf=10, max_depth=8, seed=SEED),
            "weights",
        ),
        Candidate(
            "Boosted trees, sampled",
            lambda: GBTClassifier(
                maxIter=250, maxDepth=4, stepSize=0.05, subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=SEED
            ),
            "weights",
        ),
        Candidate(
            "MLP balanced",
            lambda: EarlyStoppedNetwork(hidden=(32, 16), max_iterations=400, seed=SEED),
            "oversample",
        ),
    ]


def _l2_strength(estimator: LogisticRegression, rows: float) -> LogisticRegression:
    """An inverse strength of 1 on the summed loss is 1 / n on Spark's averaged loss."""
    return estimator.setRegParam(1.0 / rows)


def balance_rows(train: DataFrame, candidate: Candidate, key: str) -> DataFrame:
    if candidate.balance == "weights":
        return weighted(train, "label")
    if candidate.balance == "oversample":
        return balanced_oversample(train, key, "label")
    if candidate.balance == "downsample":
        return balanced_downsample(train, key, "label")
    return train


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key for a fit that reads them many times: a part for every core, and parts of bounded size.

    Compressed tables come in few parts, one of which can hold gigabytes of vectors.
    """
    n = rows.count()
    if n <= SPREAD_ROWS:
        return rows
    cells = n * rows.first()["features"].size
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS_PER_TASK)), key)


def fit_candidate(train: DataFrame, candidate: Candidate, key: str):
    """Fit on (label, features) rows; returns the Spark ML model or the forest."""
    rows = balance_rows(train, candidate, key).withColumn("label", F.col("label").cast("double"))
    estimator = candidate.make()
    if not isinstance(estimator, (BaggedTrees, LogisticRegression)):  # which draw their rows once, or keep them in packed blocks
        rows = spread(rows, key)
    if isinstance(estimator, LogisticRegression):
        estimator = _l2_strength(estimator, train.count())
    if candidate.balance == "weights":
        estimator = estimator.setWeightCol("weight")
    return estimator.fit(rows)


def positive_scores(model, rows: DataFrame, key: str) -> DataFrame:
    if isinstance(model, BaggedTreesModel):
        return model.score(rows, key)
    scored = model.transform(rows.withColumn("label", F.col("label").cast("double")))
    return scored.select(key, F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


Scorer = Callable[[DataFrame], DataFrame]


def fitted_scorer(train: DataFrame, candidate: Candidate, key: str) -> Scorer:
    """Fit the candidate once; what is returned gives rows their probability of class 1, as often as it is called."""
    if candidate.neighbours:
        rows = balance_rows(train, candidate, key)
        return lambda asked: neighbour_vote(rows, asked, key, "features", "label", candidate.neighbours)
    model = fit_candidate(train, candidate, key)
    return lambda asked: positive_scores(model, asked, key)


def score_candidate(train: DataFrame, test: DataFrame, candidate: Candidate, key: str) -> DataFrame:
    """Test rows with the candidate's probability of class 1."""
    return fitted_scorer(train, candidate, key)(test)


def evaluate(train: DataFrame, test: DataFrame, candidates: list[Candidate], key: str) -> DataFrame:
    """One metrics row per candidate, best AUC first; ``fitted`` of the frame holds the fitted candidates by name.

    Candidates are fitted side by side: the many short jobs of an iterative fit leave cores idle that the others use.
    """

    def one(candidate: Candidate) -> tuple[DataFrame, Scorer]:
        scorer = fitted_scorer(train, candidate, key)
        scored = cut_lineage(scorer(test))
        trained_on = balance_rows(train, candidate, key).agg(F.count(F.lit(1))).scalar()
        row = classifier_metrics(scored, "label", "score").select(
            F.lit(candidate.name).alias("model"), "*", trained_on.alias("train_rows"), F.lit(candidate.balance).alias("class_balance")
        )
        return row, scorer

    side = inheritable_thread_target(train.sparkSession)(one)
    with ThreadPoolExecutor(max(1, len(candidates))) as pool:
        done = [w.result() for w in [pool.submit(side, c) for c in candidates]]
    metrics = union_all([row for row, _ in done]).orderBy(F.desc("roc_auc"))
    metrics.fitted = {c.name: scorer for c, (_, scorer) in zip(candidates, done)}
    return metrics


@dataclass
class Prepared:
    """Feature pipeline fitted on the training rows, and both parts with their vectors."""

    pipeline: PipelineModel
    train: DataFrame
    test: DataFrame


def prepare_returns(mart: DataFrame) -> Prepared:
    rows = cut_lineage(return_frame(mart))
    pipeline = mixed_feature_pipeline(RETURN_NUMERIC, RETURN_CATEGORIES).fit(rows.filter("part = 'train'"))
    ready = cut_lineage(pipeline.transform(rows).select("order_id", "label", "part", "features"))
    return Prepared(pipeline, ready.filter("part = 'train'"), ready.filter("part = 'test'"))


def prepare_churn(panel: DataFrame, train_dates: list, test_dates: list) -> Prepared:
    """Temporal split: the scaler only sees training dates."""
    rows = cut_lineage(churn_frame(panel))
    stamps = lambda dates: [F.lit(d).cast("timestamp_ntz") for d in dates]
    train, test = (rows.filter(F.col("snapshot_date").isin(stamps(d))) for d in (train_dates, test_dates))
    pipeline = numeric_feature_pipeline(FEATURES).fit(train)
    # Vectors are made from the written numbers whenever they are read: written too, they would double the table.
    vectors = lambda part: pipeline.transform(part).select("row_key", "label", "future_spend", "features")
    return Prepared(pipeline, vectors(train), vectors(test))


# ---------------------------------------------------------------- importances and coefficients


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's entries from the column metadata."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    entries = [a for group in attributes.values() for a in group]
    return [a["name"] for a in sorted(entries, key=lambda a: a["idx"])]


def source_feature(encoded: str, numeric: list[str], categories: list[str]) -> str:
    """The input column behind an encoded vector entry."""
    for c in categories:
        if encoded.startswith(f"{c}_onehot"):
            return c
    if encoded.startswith("scaled_"):
        return numeric[int(encoded.rsplit("_", 1)[1])]
    return encoded


def importance_frame(spark: SparkSession, model_name: str, values: list[float], names: list[str], numeric: list[str], categories: list[str]) -> DataFrame:
    """Importance summed back to the input columns. One row per vector entry goes in."""
    rows = [(model_name, source_feature(n, numeric, categories), float(v)) for n, v in zip(names, values)]
    return (
        spark.createDataFrame(rows, "model string, feature string, importance double")
        .groupBy("model", "feature")
        .agg(F.sum("importance").alias("importance"))
    )


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` features per model by (importance, name)."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def grouped_importances(prepared: Prepared, candidates: list[Candidate], key: str, numeric: list[str], categories: list[str]) -> DataFrame:
    """Importances of every weighted candidate, summed back to the input columns."""
    spark, names = prepared.train.sparkSession, feature_names(prepared.train)
    return union_all(
        [
            importance_frame(spark, c.name, model_importances(fit_candidate(prepared.train, c, key)), names, numeric, categories)
            for c in candidates
            if c.make and c.balance == "weights"
        ]
    )


def model_importances(model) -> list[float]:
    """Absolute coefficients of a linear model or impurity importances of a tree model."""
    if hasattr(model, "coefficientMatrix"):
        return [abs(v) for v in model.coefficients.toArray()]
    return list(model.featureImportances.toArray())


def coefficient_frame(spark: SparkSession, names: list[str], values) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc("coefficient"), "feature")


# ---------------------------------------------------------------- baselines


def majority_baseline(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Every test row scored with the majority class of the training rows."""
    counts = class_counts(train, "label")
    major = float(max(counts, key=lambda c: (counts[c], -c)))
    return test.select(key, "label", F.lit(major).alias("score"))


def shuffled_labels(rows: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Give every row the label of another one: labels and rows are numbered in two hash orders and re-joined."""
    a = rows.withColumn("_a", F.xxhash64(key, F.lit(seed)))
    b = rows.select(F.col(key).alias("_other"), F.col("label").alias("_label"), F.xxhash64(key, F.lit(seed + 1)).alias("_b"))
    left = global_row_number(a, [F.col("_a"), F.col(key)], "_n").drop("_a", "label")
    right = global_row_number(b, [F.col("_b"), F.col("_other")], "_n").select("_n", F.col("_label").alias("label"))
    return left.join(right, "_n").drop("_n")


def null_models(prepared: Prepared, candidates: list[Candidate], key: str) -> DataFrame:
    """Metrics of the majority class and of the candidates trained on shuffled labels."""
    majority = classifier_metrics(cut_lineage(majority_baseline(prepared.train, prepared.test, key)), "label", "score").select(
        F.lit("Majority class").alias("model"), "*"
    )
    shuffled = cut_lineage(shuffled_labels(prepared.train, key))
    trained = evaluate(shuffled, prepared.test, candidates, key)
    named = trained.select(F.concat(F.col("model"), F.lit(", shuffled labels")).alias("model"), *majority.columns[1:])
    return majority.unionByName(named)


# ---------------------------------------------------------------- value and price regressions

# The penalty grids.
RIDGE_ALPHAS = [0.1, 1.0, 10.0, 100.0]
LASSO_ALPHAS = [0.0001, 0.001, 0.01, 0.1, 1.0]
PRICE_LASSO_ALPHAS = [0.001, 0.01, 0.1, 1.0]
FOLDS = 5


def linear_models(found: Moments, lasso_alphas: list[float]) -> dict[str, LinearFit]:
    """Least squares, ridge and lasso from one pass of moments; the penalties chosen by cross-validation over fixed grids."""
    return {
        "OLS": least_squares(found.whole),
        "Ridge": cross_validated(found, ridge, RIDGE_ALPHAS),
        "Lasso": cross_validated(found, lasso, lasso_alphas),
    }


def predicted_spend(model, rows: DataFrame) -> DataFrame:
    """Prediction back on the money scale, never negative."""
    return model.transform(rows).withColumn("predicted_spend", F.greatest(F.lit(0.0), F.expm1("prediction")))


def value_moments(rows: DataFrame) -> Moments:
    """Moments of log spend over the feature vectors."""
    return moments(rows, "features", C.log1p_floor_zero(F.col("future_spend")), "row_key", FOLDS, SEED)


def value_ridge(rows: DataFrame) -> LinearFit:
    return cross_validated(value_moments(rows), ridge, RIDGE_ALPHAS)


def value_models(prepared: Prepared) -> dict[str, LinearFit]:
    return linear_models(value_moments(prepared.train), LASSO_ALPHAS)


def value_regression(prepared: Prepared) -> DataFrame:
    """Errors of the three value models on the test dates, on the money scale; best MAE first."""
    parts = [
        regression_metrics(predicted_spend(model, prepared.test), "future_spend", "predicted_spend").select(F.lit(name).alias("model"), "*")
        for name, model in value_models(prepared).items()
    ]
    return union_all(parts).orderBy("mae")


def price_pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            StringIndexer(inputCols=["category", "brand"], outputCols=["category_i", "brand_i"], handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=["category_i", "brand_i"], outputCols=["category_v", "brand_v"], dropLast=True, handleInvalid="keep"),
            VectorAssembler(inputCols=["rating", "category_v", "brand_v"], outputCol="features"),
        ]
    )


def price_regression(products: DataFrame) -> DataFrame:
    """How far catalogue attributes explain the list price: errors on a hashed 20% of the products."""
    rows = products.select("product_id", "price", "rating", "category", "brand").dropna()
    rows = rows.withColumn("in_train", hash_share("product_id") < 0.8)
    ready = cut_lineage(price_pipeline().fit(rows).transform(rows).select("product_id", "price", "features", "in_train"))
    train, test = ready.filter("in_train"), ready.filter("NOT in_train")
    parts = []
    found = moments(train, "features", F.col("price"), "product_id", FOLDS, SEED)
    for name, model in linear_models(found, PRICE_LASSO_ALPHAS).items():
        scored = model.transform(test).withColumn("predicted_price", F.greatest(F.lit(0.0), F.col("prediction")))
        parts.append(regression_metrics(scored, "price", "predicted_price").select(F.lit(name).alias("model"), "*"))
    return union_all(parts).orderBy("mae")


# ---------------------------------------------------------------- clusters

CLUSTER_INPUTS = ["recency_days", "order_count", "total_spend_log1p"]


def cluster_frame(current: DataFrame) -> DataFrame:
    rows = current.select("user_id", "total_spend", "churn", *[F.col(c).cast("double").alias(c) for c in CLUSTER_INPUTS])
    rows = cut_lineage(rows)  # the scaler reads them, and so does the transformation
    return cut_lineage(numeric_feature_pipeline(CLUSTER_INPUTS).fit(rows).transform(rows).drop("raw_features"))


def rfm_kmeans(current: DataFrame, ks: range = range(2, 7), starts: int = 20, iterations: int = 300) -> tuple[DataFrame, DataFrame, int]:
    """Clusters with the k of best silhouette, the silhouette per k (best of several starts), and the chosen k."""
    rows = cluster_frame(current)
    evaluator = ClusteringEvaluator(featuresCol="features", distanceMeasure="squaredEuclidean", predictionCol="cluster")
    fits = fit_kmeans_grid(rows, "user_id", "features", ks, starts, iterations, SEED)
    best, tried = None, []
    for k in ks:
        clustered = assign_clusters(rows, "features", fits[k], "cluster")
        silhouette = evaluator.evaluate(clustered)
        tried.append((k, silhouette))
        if best is None or silhouette > best[0]:
            best = (silhouette, clustered, k)
    scores = rows.sparkSession.createDataFrame(tried, "k int, silhouette double")
    return best[1], scores, best[2]


def cluster_profile(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency_days").alias("recency_days"), F.avg("order_count").alias("order_count"),
        F.avg("total_spend").alias("total_spend"), F.avg("churn").alias("churn"),
    )
