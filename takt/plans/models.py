"""Risk models on feature tables: training, whole-run cross-validation, calibration, scoring (Spark ML)."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.functions import scalar as sc
from takt.operators import evaluate as ev
from takt.operators.slices import beside, numbered
from takt.session import cut_lineage


def _numeric(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Missing values become 0 with a flag beside them (trees split on the flag)."""
    return df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"n_{c}") for c in numeric],
                     *[F.col(c).isNull().cast("double").alias(f"m_{c}") for c in numeric])


VALIDATION = "in_validation"


def _pipeline(numeric: list[str], levels: dict[str, list[str]], target: str, weight: str | None, iterations: int, depth: int, seed: int, early_stop: bool = False) -> Pipeline:
    """``levels`` are the frozen values of the categorical columns; any other value is a level of its own.

    With ``early_stop`` rows marked ``in_validation`` are not learned from: boosting ends when their error no longer falls.
    """
    index = [StringIndexerModel.from_labels(values, inputCol=c, outputCol=f"i_{c}", handleInvalid="keep") for c, values in levels.items()]
    parts = [f"n_{c}" for c in numeric] + [f"m_{c}" for c in numeric] + [f"i_{c}" for c in levels]
    gbt = GBTClassifier(labelCol=target, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed, maxBins=max(64, 2 + max([0, *map(len, levels.values())])), validationTol=STOP_TOL)
    if early_stop:
        gbt = gbt.setValidationIndicatorCol(VALIDATION)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[*index, VectorAssembler(inputCols=parts, outputCol="features"), gbt])


STOP_TOL = 0.0  # boosting ends with the first tree after which the validation error rises


def known_levels(df: DataFrame, categorical: list[str]) -> dict[str, list[str]]:
    """The values of each categorical column, in order: what a model's contract freezes. A line has as many as it has stations or kinds."""
    if not categorical:
        return {}
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in categorical]).first()
    return {c: list(row[c]) for c in categorical}


def balanced_weight(df: DataFrame, target: str) -> DataFrame:
    """df with ``weight``: positives weigh together as much as negatives."""
    counts = df.agg(F.count_if(F.col(target) == 1).alias("__pos"), F.count(F.lit(1)).alias("__all"))
    up = (F.col("__all") - F.col("__pos")) / F.greatest(F.col("__pos"), F.lit(1))
    return beside(df, counts).withColumn("weight", F.when(F.col(target) == 1, up).otherwise(1.0)).drop("__pos", "__all")


def n_trees(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def score_features(model: PipelineModel, features: DataFrame, numeric: list[str], threshold: float | None = None) -> DataFrame:
    """Probability per row; with a threshold also risk, warning and the threshold itself."""
    out = model.transform(_numeric(features, numeric)).withColumn("score", F.element_at(vector_to_array("probability"), 2)).select(*features.columns, "score")
    if threshold is None:
        return out
    return out.select("*", sc.risk_percent("score").alias("risk_percent"), F.lit(threshold).alias("decision_threshold"),
                      sc.crossed("score", F.lit(threshold)).alias("warning"))


def importance(model: PipelineModel) -> DataFrame:
    """Feature importance rows of the fitted trees."""
    stages = model.stages
    names, gbt = stages[-2].getInputCols(), stages[-1]
    from pyspark.sql import SparkSession
    values = gbt.featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(names, values)), "feature string, importance double")


def train_risk_model(features: DataFrame, split: DataFrame, numeric: list[str], categorical: list[str], target: str, iterations: int = 20, depth: int = 3, seed: int = 7,
                     levels: dict[str, list[str]] | None = None, class_weight: bool = True) -> tuple[PipelineModel, float, DataFrame]:
    """Fit on training runs, stop boosting and pick the F2 threshold on validation runs, report the splits with the number of trees.

    ``levels`` freezes the values of categorical columns (default: those of the whole table, not of the training part). The labelled
    feature table is written out once: boosting passes over it many times.
    """
    data = cut_lineage(features.filter(F.col(target).isNotNull()).join(split, "run_id"))
    levels = levels or known_levels(data, categorical)
    learn = data.filter("split <> 'test'").withColumn(VALIDATION, F.col("split") == "val")
    weight = "weight" if class_weight else None
    learn = balanced_weight(learn, target) if class_weight else learn
    model = _pipeline(numeric, levels, target, weight, iterations, depth, seed, early_stop=True).fit(_numeric(learn, numeric))
    scored = cut_lineage(score_features(model, data, numeric).withColumn("y", F.col(target)).select("run_id", "split", "y", "score"))
    best = ev.pick_threshold(scored.filter("split = 'val'"), 2.0).select("threshold").first()
    threshold = float(best["threshold"]) if best else 0.5
    table = ev.metric_table(scored, ["split"]).join(ev.confusion(scored, threshold, ["split"]), "split").withColumn("threshold", F.lit(threshold)).withColumn(
        "n_trees", F.lit(n_trees(model))).withColumn("most_trees", F.lit(iterations))
    return model, threshold, table


def stratified_folds(rows: DataFrame, target: str, k: int, seed: int = 0) -> DataFrame:
    """(run_id, fold): whole runs, dealt by their positives in a snake, so folds hold similar numbers of them; equal runs in seeded hash order."""
    runs = rows.groupBy("run_id").agg(F.count_if(F.col(target) == 1).alias("positives"))
    at = runs.withColumn("less", -F.col("positives")).withColumn("h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "run_id"), 256)).withColumn("one", F.lit(0))
    i = F.col("rn") - 1
    dealt = numbered(at, ["one"], ["less", "h"], slice_col=F.col("less"))  # runs of as many positives are a slice
    return dealt.select("run_id", F.when(F.floor(i / k) % 2 == 0, i % k).otherwise(k - 1 - i % k).cast("int").alias("fold"))


def cross_run_cv(features: DataFrame, folds: int, numeric: list[str], categorical: list[str], target: str, iterations: int = 12, depth: int = 3, seed: int = 7,
                 inner: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nested folds of whole runs: every row is scored once, by a model that never saw its run, with trees and threshold that inner folds chose.

    Outer and inner folds deal runs by their positives. Inside the training part of an outer fold, each inner fold in turn stops the
    boosting of a model fitted on the others; the middle number of trees is taken, and the F2 threshold of all inner scores. The
    driver loops over folds only; each fit is distributed. Returns the rows with score, and per fold its metrics with what was chosen.
    """
    whole = features.filter(F.col(target).isNotNull())
    data = cut_lineage(whole.join(stratified_folds(whole, target, folds, seed), "run_id"))
    levels = known_levels(data, categorical)
    out, chosen = None, []
    for k in range(folds):
        rest = data.filter(F.col("fold") != k)
        part = cut_lineage(rest.join(stratified_folds(rest, target, inner, seed + 1).withColumnRenamed("fold", "inner_fold"), "run_id"))
        trees, seen = [], None
        for j in range(inner):
            marked = balanced_weight(part.withColumn(VALIDATION, F.col("inner_fold") == j), target)
            m = _pipeline(numeric, levels, target, "weight", iterations, depth, seed, early_stop=True).fit(_numeric(marked, numeric))
            trees.append(n_trees(m))
            s = score_features(m, part.filter(F.col("inner_fold") == j), numeric).select(F.col(target).alias("y"), "score")
            seen = s if seen is None else seen.unionByName(s)
        best = ev.pick_threshold(cut_lineage(seen), 2.0).select("threshold").first()
        chosen.append((k, sorted(trees)[len(trees) // 2], float(best["threshold"]) if best else 0.5))
        m = _pipeline(numeric, levels, target, "weight", chosen[-1][1], depth, seed).fit(_numeric(balanced_weight(rest, target), numeric))
        s = score_features(m, data.filter(F.col("fold") == k), numeric)
        out = s if out is None else out.unionByName(s)
    picked = data.sparkSession.createDataFrame(chosen, "fold int, n_trees int, threshold double")
    scored = cut_lineage(out.withColumn("y", F.col(target)).join(picked, "fold"))
    hit = F.col("score") >= F.col("threshold")
    at = scored.groupBy("fold", "n_trees", "threshold").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"),
                                                             F.count_if(~hit & (F.col("y") == 1)).alias("fn"))
    return scored, ev.metric_table(scored, ["fold"]).join(at, "fold")


def _platt(train: DataFrame, rows: DataFrame) -> DataFrame:
    vec = lambda df: df.withColumn("x", array_to_vector(F.array(sc.logit("score"))))
    m = LogisticRegression(featuresCol="x", labelCol="y").fit(vec(train))
    return m.transform(vec(rows)).withColumn("calibrated", F.element_at(vector_to_array("probability"), 2)).select(*rows.columns, "calibrated")


def _isotonic(train: DataFrame, rows: DataFrame) -> DataFrame:
    # equal scores are merged first: the fit then depends on distinct scores, not rows
    grouped = train.groupBy("score").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    m = IsotonicRegression(featuresCol="score", labelCol="y", weightCol="w").fit(grouped)
    return m.transform(rows).withColumnRenamed("prediction", "calibrated")


def calibrate(scored: DataFrame, folds: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Cross-fitted Platt and isotonic scores next to the raw ones, and their metrics with the choice.

    ``best`` follows Brier, then log loss, then calibration error. ``platt_allowed`` is the stricter rule:
    Brier and at least two metrics better, PR-AUC down by at most .005 and ROC-AUC by at most .002.
    """
    data = cut_lineage(scored.select("run_id", "unit_id", "seq", F.col("y").cast("double").alias("y"), "score").join(ev.group_folds(scored, folds, seed), "run_id"))
    out = data.withColumn("method", F.lit("none")).withColumn("calibrated", F.col("score"))
    for name, fit in (("platt", _platt), ("isotonic", _isotonic)):
        for k in range(folds):
            part = fit(data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)).withColumn("method", F.lit(name))
            out = out.unionByName(part.select(*out.columns))
    long = cut_lineage(out.select("run_id", "unit_id", "seq", "y", "method", F.col("calibrated").alias("score")))
    table = ev.metric_table(long, ["method"])
    raw = table.filter("method = 'none'").select(*[F.col(c).alias(f"r_{c}") for c in ("brier", "log_loss", "ece", "pr_auc", "roc_auc")])
    best = table.agg(F.min_by("method", F.struct("brier", "log_loss", "ece", "method")).alias("b"))
    j = beside(beside(table, raw), best)
    better = sum((F.when(F.col(m) < F.col(f"r_{m}"), 1).otherwise(0) for m in ("brier", "log_loss", "ece")), F.lit(0))
    allowed = ((F.col("method") == "platt") & (F.col("brier") < F.col("r_brier")) & (better >= 2)
               & (F.col("r_pr_auc") - F.col("pr_auc") <= 0.005) & (F.col("r_roc_auc") - F.col("roc_auc") <= 0.002))
    return long, j.select(*table.columns, (F.col("method") == F.col("b")).alias("best"), F.coalesce(allowed, F.lit(False)).alias("platt_allowed"))
