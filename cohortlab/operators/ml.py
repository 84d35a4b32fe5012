"""Family I: model fitting on feature tables with Spark ML (ops 103-109).

Fits run on the whole split (not per mini-batch); scoring emits a long
(id, pred, label) table that the metric operators consume directly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier,
                                       MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators import metrics
from cohortlab.session import materialize, scratch_dir, write_once

SEED = 42


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _estimator(kind: str, task: str, label: str, **kw):
    binary = task != "los"
    if kind == "dt":
        cls = DecisionTreeClassifier if binary else DecisionTreeRegressor
        return cls(labelCol=label, maxDepth=kw.get("max_depth", 10), seed=SEED)
    if kind == "rf":
        cls = RandomForestClassifier if binary else RandomForestRegressor
        return cls(labelCol=label, numTrees=kw.get("n_trees", 100), maxDepth=kw.get("max_depth", 10), seed=SEED)
    if kind == "gbt":
        cls = GBTClassifier if binary else GBTRegressor
        return cls(labelCol=label, maxIter=kw.get("rounds", 100), stepSize=kw.get("lr", 1e-3),
                   maxDepth=kw.get("max_depth", 5), seed=SEED)
    raise ValueError(kind)


def fit_tree_model(train: DataFrame, features: list[str], label: str, kind: str = "dt", task: str = "mortality",
                   **kw) -> PipelineModel:
    """Ops 103-105: decision tree (depth 10), random forest (100 x depth 10) or
    gradient-boosted trees (lr 1e-3, 100 rounds); classifier or regressor by task."""
    d = train.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[_assembler(features), _estimator(kind, task, label, **kw)]).fit(d)


def fit_mlp(train: DataFrame, vec_cols: list[str], label: str, hidden: int = 256, max_iter: int = 100,
            n_classes: int = 2) -> PipelineModel:
    """Ops 106-107: one-hidden-layer MLP on embedding arrays; several arrays
    are concatenated (fused), which spans the length-1 attention fusions."""
    cols = [array_to_vector(F.col(c).cast("array<double>")).alias(f"_v{i}") for i, c in enumerate(vec_cols)]
    d = train.select("*", *cols).withColumn(label, F.col(label).cast("double"))
    dim = d.select(*[F.size(F.col(c)) for c in vec_cols]).first()
    n_in = int(sum(dim))
    mlp = MultilayerPerceptronClassifier(labelCol=label, layers=[n_in, hidden, n_classes], maxIter=max_iter,
                                         seed=SEED)
    asm = VectorAssembler(inputCols=[f"_v{i}" for i in range(len(vec_cols))], outputCol="features")
    model = Pipeline(stages=[asm, mlp]).fit(d)
    model._cohortlab_vec_cols = vec_cols  # noqa: SLF001 - remembered for scoring
    return model


def fit_mlp_on_validation(train: DataFrame, val: DataFrame, id_col: str, vec_cols: list[str], label: str, hidden: int = 256,
                          rounds: int = 4, iterations: int = 10, patience: int | None = None,
                          n_classes: int = 2) -> tuple[PipelineModel, list[float]]:
    """Ops 106-107 with the weights chosen on validation data.

    Each round goes on from the weights of the last one (warm start) and is scored by its AUROC on ``val``; the
    model of the best round is returned, the earliest of equals, with the AUROC of every round. ``patience``: rounds without
    a better one before training ends.
    """
    def prepared(d: DataFrame) -> DataFrame:
        arrays = [F.col(c).cast("array<double>") for c in vec_cols]
        return materialize(d.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias(label),
                                    *[array_to_vector(a).alias(f"_v{i}") for i, a in enumerate(arrays)]))
    train, val = prepared(train), prepared(val)
    joined = VectorAssembler(inputCols=[f"_v{i}" for i in range(len(vec_cols))], outputCol="features")
    train = joined.transform(train)
    layers = [len(train.select("features").first().features), hidden, n_classes]
    best, weights, history = None, None, []
    for _ in range(rounds):
        mlp = MultilayerPerceptronClassifier(labelCol=label, layers=layers, maxIter=iterations, seed=SEED)
        if weights is not None:
            mlp.setInitialWeights(weights)
        fitted = mlp.fit(train)
        weights = fitted.weights
        model = PipelineModel(stages=[joined, fitted])
        scores = model.transform(val).select(F.lit(1).alias("run"), F.col(label).alias("label"), vector_to_array(F.col("probability"))[1].alias("pred"))
        found = metrics.curve_metrics(metrics.pr_curve(scores, ["run"]), ["run"]).first()
        history.append(found.auroc if found else 0.0)
        if best is None or history[-1] > history[best[0]]:
            best = (len(history) - 1, model)
        elif patience is not None and len(history) - 1 - best[0] >= patience:
            break
    return best[1], history


# ---------------------------------------------------------------- models as expressions

MAX_NODES = 2_000  # tree nodes that one Spark plan may hold: the driver needs some KB for each


def tree_nodes(model: PipelineModel) -> Iterator[dict[int, dict]]:
    """Tree after tree its nodes by id: value (share of class 1 or prediction), children, feature and threshold.

    Read from the model's own saved form, which is as large as the model (trees x 2^depth nodes), not as the data.
    """
    from pyspark.sql import SparkSession
    spark, stage = SparkSession.getActiveSession(), model.stages[-1]
    path = scratch_dir(spark, "tree-model")
    stage.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    shares = isinstance(stage, (DecisionTreeClassificationModel, RandomForestClassificationModel))  # leaves vote with the share of class 1 they saw
    stats = F.col("impurityStats")
    value = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if shares else F.col("prediction")
    if data.where("leftChild >= 0 AND split.numCategories >= 0").limit(1).count():
        raise ValueError("splits on categories are not supported")
    rows = data.select("tree", "id", F.when(F.col("leftChild") < 0, value).alias("value"), "leftChild", "rightChild",
                       F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas()
    for _, part in rows.groupby("tree", sort=True):
        yield {n["id"]: n for n in part.to_dict("records")}


def _tree_sql(nodes: dict[int, dict], at: int, columns: list[str]) -> str:
    node = nodes[at]
    if node["leftChild"] < 0:
        return _double(node["value"])
    left, right = (_tree_sql(nodes, node[side], columns) for side in ("leftChild", "rightChild"))
    return f"CASE WHEN {columns[node['feature']]} <= {_double(node['threshold'])} THEN {left} ELSE {right} END"


def _double(x: float) -> str:
    text = repr(float(x))
    if not math.isfinite(x):
        return f"CAST('{text}' AS DOUBLE)"
    return text if "e" in text else f"{text}e0"  # with an exponent both engines read a double, as one word


def _summands(model: PipelineModel, columns: list[str]) -> tuple[list[tuple[str, int]], Callable[[str], str]]:
    """Each tree's share of the prediction as SQL over double columns with its number of nodes, and what makes the prediction of their sum."""
    stage = model.stages[-1]
    parts = [(f"({_tree_sql(nodes, 0, columns)})", len(nodes)) for nodes in tree_nodes(model)]
    if isinstance(stage, (GBTClassificationModel, GBTRegressionModel)):
        parts = [(f"{_double(w)} * {p}", n) for w, (p, n) in zip(stage.treeWeights, parts)]
        classifier = isinstance(stage, GBTClassificationModel)
        return parts, (lambda total: f"1 / (1 + exp(-2 * ({total})))") if classifier else (lambda total: f"({total})")
    return parts, lambda total: f"({total}) / {len(parts)}"


def model_sql(model: PipelineModel, features: Iterable[str]) -> str:
    """A fitted tree, forest or boosted ensemble as one SQL expression over its feature columns: P(class 1), or the value.

    Plain ``CASE`` and arithmetic with every threshold to its last digit, so Spark and other engines evaluate it
    alike. A null or NaN feature goes to the right, as in the fitted model.
    """
    parts, whole = _summands(model, [f"CAST({f} AS DOUBLE)" for f in features])
    return whole(" + ".join(p for p, _ in parts))


def score_by_expression(model: PipelineModel, features: list[str], df: DataFrame, id_col: str, label: str,
                        max_nodes: int | None = None) -> DataFrame:
    """Op 109 without the model: (id, pred, label) by the exported expression.

    The sum over the trees is taken some trees at a time, ``max_nodes`` (MAX_NODES) nodes or one tree, in the order of the
    expression, and the rows keep it: as one plan, or as generated code, a forest of 100 x 2^10 leaves is too much for the driver.
    """
    max_nodes = max_nodes or MAX_NODES
    parts, whole = _summands(model, features)
    d = df.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_label"),
                  *[F.col(f).cast("double").alias(f) for f in dict.fromkeys(features)], F.lit(0.0).alias("_sum"))
    taken, held = [], 0
    for at, (sql, n) in enumerate(parts):
        taken, held = [*taken, sql], held + n
        if at + 1 == len(parts) or held + parts[at + 1][1] > max_nodes:
            # a lambda is evaluated as it stands: no code is generated from the trees
            more = F.transform(F.array("_sum"), lambda total: reduce(lambda x, tree: x + F.expr(tree), taken, total))
            d, taken, held = d.withColumn("_sum", more[0]), [], 0
            if at + 1 < len(parts):
                d = write_once(d, "forest-sums")
    return d.select(F.col("_id").alias("id"), F.expr(whole("_sum")).alias("pred"), F.col("_label").alias("label"))


def loss_against_constant(scores: DataFrame, task: str = "mortality") -> DataFrame:
    """One row: mean loss (cross-entropy, or squared error for LOS) of the scores and of the best constant."""
    p, y = F.col("pred"), F.col("label")
    if task == "los":
        return scores.agg(F.avg((p - y) * (p - y)).alias("loss"), F.var_pop(y).alias("constant"))
    eps = 1e-12
    entropy = lambda q, t: -(t * F.ln(F.greatest(q, F.lit(eps))) + (1 - t) * F.ln(F.greatest(1 - q, F.lit(eps))))
    return scores.agg(F.avg(entropy(p, y)).alias("loss"), entropy(F.avg(y), F.avg(y)).alias("constant"))


def batch_score(model: PipelineModel, df: DataFrame, id_col: str, label: str, task: str = "mortality",
                vec_cols: list[str] | None = None) -> DataFrame:
    """Op 109: (id, pred, label); pred = P(class 1) for binary tasks, the value for LOS."""
    d = df
    if vec_cols:
        d = d.select("*", *[array_to_vector(F.col(c).cast("array<double>")).alias(f"_v{i}")
                            for i, c in enumerate(vec_cols)])
    out = model.transform(d)
    pred = F.col("prediction") if task == "los" else vector_to_array(F.col("probability"))[1]
    return out.select(F.col(id_col).alias("id"), pred.cast("double").alias("pred"),
                      F.col(label).cast("double").alias("label"))
