"""Registered model queries on the station flow features and the labelled scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded
from takt.catalog.validate import flow_rows
from takt.contracts import FLOW_FEATURES
from takt.operators import evaluate as ev
from takt.plans import models as md

QUERIES, ORACLE, query = registry()
CATEGORICAL = ["station_id", "station_archetype"]
NUMERIC = [c for c in FLOW_FEATURES if c not in CATEGORICAL]


def _train(spark, d):
    f = flow_rows(spark, d)
    split = ev.split_runs(b.runs(spark, d), 0.2, 0.2, 7)
    return f, md.train_risk_model(f, split, NUMERIC, CATEGORICAL, "y_bottleneck")


@query("train_risk_model")
def train_risk_model(spark, d):
    return rounded(_train(spark, d)[1][2])


@query("feature_importance")
def feature_importance(spark, d):
    return rounded(md.importance(_train(spark, d)[1][0]))


@query("score_features")
def score_features(spark, d):
    f, (model, threshold, _) = _train(spark, d)
    return rounded(md.score_features(model, f, NUMERIC, threshold).select("run_id", "station_id", "prediction_event_sequence", "score", "risk_percent", "warning"))


@query("cross_run_cv")
def cross_run_cv(spark, d):
    return rounded(md.cross_run_cv(flow_rows(spark, d), 3, NUMERIC, CATEGORICAL, "y_bottleneck")[1])


@query("calibrate")
def calibrate(spark, d):
    return rounded(md.calibrate(b.scored(spark, d))[1])
