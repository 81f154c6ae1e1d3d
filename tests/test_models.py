"""Risk models: early stopping, class weight, frozen levels, nested folds of whole runs."""
import random

import pytest
from pyspark.sql import functions as F

from takt.plans import models as md


@pytest.fixture(scope="module")
def rows(spark):
    """Nine runs, a third of the rows in one of them; risk follows x and the station, one row in eight is positive."""
    draw, out = random.Random(4), []
    for i in range(1800):
        run = 0 if i % 3 == 0 else i % 12
        x, station = draw.random(), draw.choice(["S01", "S02", "S03"])
        y = int(draw.random() < (0.35 if x > 0.7 and station != "S03" else 0.02))
        out.append((f"run_{run:02d}", x if i % 10 else None, station, y))
    return spark.createDataFrame(out, "run_id string, x double, station string, y int")


def test_boosting_stops_on_validation_runs_and_is_weighted(spark, rows):
    split = rows.select("run_id").distinct().withColumn("split", F.when(F.col("run_id") == "run_01", "test").when(F.col("run_id").isin("run_02", "run_03", "run_04"), "val").otherwise("train"))
    model, threshold, table = md.train_risk_model(rows, split, ["x"], ["station"], "y", iterations=15, levels={"station": ["S01", "S02", "S03", "S09"]})
    report = {r["split"]: r for r in table.collect()}
    assert set(report) == {"train", "val", "test"} and report["val"]["n_trees"] == md.n_trees(model) <= 15 == report["val"]["most_trees"]
    assert report["test"]["roc_auc"] > 0.6 and 0 < threshold < 1
    assert report["train"]["mean_score"] > 2 * report["train"]["positive_rate"]  # positives weigh as much as negatives
    plain = md.train_risk_model(rows, split, ["x"], ["station"], "y", iterations=15, class_weight=False)[2].filter("split = 'train'").first()
    assert plain["mean_score"] < report["train"]["mean_score"]
    # noise: the first tree already fits nothing that validation runs share
    noise = rows.withColumn("y", (F.pmod(F.xxhash64("run_id", "x", "station"), F.lit(2)) == 0).cast("int"))
    assert md.n_trees(md.train_risk_model(noise, split, ["x"], ["station"], "y", iterations=15)[0]) < 15
    # a value outside the frozen levels is scored, as a level of its own
    new = md.score_features(model, spark.createDataFrame([("r", 0.9, "S77"), ("r", None, None)], "run_id string, x double, station string"), ["x"]).collect()
    assert all(0 < r["score"] < 1 for r in new)


def test_nested_folds_keep_runs_apart_and_report_their_choices(spark, rows):
    folds = {r["run_id"]: r["fold"] for r in md.stratified_folds(rows, "y", 3, 7).collect()}
    assert len(folds) == 9 and sorted(list(folds.values()).count(k) for k in range(3)) == [3, 3, 3]
    positives = {r["run_id"]: r["n"] for r in rows.groupBy("run_id").agg(F.sum("y").alias("n")).collect()}
    most = sorted(positives, key=lambda r: (-positives[r], r))
    assert len({folds[r] for r in most[:3]}) == 3  # the richest runs lie in different folds
    scored, table = md.cross_run_cv(rows, 3, ["x"], ["station"], "y", iterations=6, seed=7)
    assert scored.count() == rows.count()
    assert {r["run_id"]: r["fold"] for r in scored.select("run_id", "fold").distinct().collect()} == folds
    report = table.collect()
    assert len(report) == 3 and all(1 <= r["n_trees"] <= 6 and 0 < r["threshold"] < 1 and r["tp"] + r["fn"] > 0 for r in report)
