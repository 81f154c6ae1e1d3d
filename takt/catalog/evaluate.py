"""Registered queries over labelled scores: metrics, thresholds, policies, folds."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded
from takt.catalog.sql import with_ctes
from takt.functions import scalar as sc
from takt.operators import evaluate as ev
from takt.operators import select as sel
from takt.operators import windows as wn

QUERIES, ORACLE, query = registry()
THR, UTHR = 0.5, 0.7

POLICY_CTES = {
    "lists": """
  SELECT *, row_number() OVER w AS rn, list(score) OVER w AS xs, lag(score) OVER w AS prev,
    list(score) OVER (PARTITION BY run_id, unit_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x3
  FROM series WINDOW w AS (PARTITION BY run_id, unit_id ORDER BY seq)""",
    "pol": """
  SELECT run_id, unit_id, doc_id, y, station_index, final_index, seq, score, score AS raw,
    list_reduce(xs, lambda e, x: 0.3::DOUBLE * x + 0.7::DOUBLE * e) AS ema_03,
    list_reduce(xs, lambda e, x: 0.5::DOUBLE * x + 0.5::DOUBLE * e) AS ema_05,
    list_reduce(xs, lambda e, x: 0.7::DOUBLE * x + 0.3::DOUBLE * e) AS ema_07,
    CASE WHEN prev IS NOT NULL THEN least(score, prev) END AS two_consecutive, list_reverse_sort(x3)[2] AS two_of_three FROM lists""",
}


def policies(spark, d):
    return wn.alert_policies(b.scored_series(spark, d))


@query("alert_policies", with_ctes("series", """
SELECT run_id, unit_id, seq, round(raw, 6) AS raw, round(ema_03, 6) AS ema_03, round(ema_05, 6) AS ema_05, round(ema_07, 6) AS ema_07,
  two_consecutive, two_of_three FROM pol""", **POLICY_CTES))
def alert_policies(spark, d):
    p = policies(spark, d)
    return p.select("run_id", "unit_id", "seq", *[F.round(c, 6).alias(c) for c in ("raw", "ema_03", "ema_05", "ema_07")],
                    "two_consecutive", "two_of_three")


@query("ema", with_ctes("series", "SELECT run_id, unit_id, seq, round(ema_03, 6) AS ema FROM pol", **POLICY_CTES))
def ema(spark, d):
    return policies(spark, d).select("run_id", "unit_id", "seq", F.round("ema_03", 6).alias("ema"))


@query("second_highest_of_three", with_ctes("series", "SELECT run_id, unit_id, seq, two_of_three FROM pol", **POLICY_CTES))
def second_highest_of_three(spark, d):
    return policies(spark, d).select("run_id", "unit_id", "seq", "two_of_three")


@query("prev_next", with_ctes("series", f"""
SELECT run_id, unit_id, seq, score, lag(score) OVER w AS prev_value, lag(score >= {THR}) OVER w AS prev_flag
FROM series WINDOW w AS (PARTITION BY run_id, unit_id ORDER BY seq)"""))
def prev_next(spark, d):
    s = b.scored_series(spark, d).withColumn("flag", F.col("score") >= THR)
    return wn.prev_next(s, ["run_id", "unit_id"], "seq", "score", "flag").select(
        "run_id", "unit_id", "seq", "score", "prev_value", "prev_flag")


def _confusion_sql(by: str, key: str) -> str:
    return f"""
WITH c AS (SELECT {key}, count(*) FILTER (score < {THR} AND y = 0) AS tn, count(*) FILTER (score >= {THR} AND y = 0) AS fp,
  count(*) FILTER (score < {THR} AND y = 1) AS fn, count(*) FILTER (score >= {THR} AND y = 1) AS tp FROM scored {by}),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END::DOUBLE AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END::DOUBLE AS r,
  CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END::DOUBLE AS sp FROM c)
SELECT {key.split(' AS ')[-1]}, tn, fp, fn, tp, round(p, 6) AS precision, round(r, 6) AS recall, round((r + sp) / 2, 6) AS balanced_accuracy,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f1,
  round(CASE WHEN 4 * p + r = 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6)::DOUBLE AS f2 FROM m"""


def _with_scored(sql: str, names: str = "scored", **extra) -> str:
    prelude = with_ctes(names, "", **extra)
    return prelude.rstrip() + (",\n" + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)


@query("confusion_metrics", _with_scored(_confusion_sql("", "'all' AS scope")))
def confusion_metrics(spark, d):
    return rounded(ev.confusion(b.scored(spark, d), THR), default=6)


@query("per_run_metrics", _with_scored(_confusion_sql("GROUP BY run_id", "run_id")))
def per_run_metrics(spark, d):
    return rounded(ev.confusion(b.scored(spark, d), THR, ["run_id"]), default=6)


_CURVE = {
    "cv": """
  SELECT run_id, score, count(*) AS n, sum(y) AS pos, sum(count(*)) OVER w AS cum_n, sum(sum(y)) OVER w AS cum_pos,
    sum(count(*)) OVER (PARTITION BY run_id) AS all_n, sum(sum(y)) OVER (PARTITION BY run_id) AS all_pos
  FROM scored GROUP BY run_id, score WINDOW w AS (PARTITION BY run_id ORDER BY score DESC)""",
    "cva": """
  SELECT 'all' AS scope, score, count(*) AS n, sum(y) AS pos, sum(count(*)) OVER w AS cum_n, sum(sum(y)) OVER w AS cum_pos,
    sum(count(*)) OVER () AS all_n, sum(sum(y)) OVER () AS all_pos
  FROM scored GROUP BY score WINDOW w AS (ORDER BY score DESC)""",
}
_AP = """CASE WHEN max(all_pos) = 0 OR max(all_pos) = max(all_n) THEN max(all_pos)::DOUBLE / max(all_n)
  ELSE sum(pos * cum_pos / cum_n::DOUBLE) / max(all_pos) END"""
_AUC = """CASE WHEN max(all_pos) IN (0, max(all_n)) THEN NULL ELSE
  sum(pos * ((all_n - all_pos) - (cum_n - cum_pos) + (n - pos) / 2.0::DOUBLE)) / (max(all_pos) * (max(all_n) - max(all_pos)))::DOUBLE END"""


@query("pr_auc", with_ctes("scored", f"SELECT run_id, round({_AP}, 6) AS pr_auc FROM cv GROUP BY run_id", **_CURVE))
def pr_auc(spark, d):
    return rounded(ev.pr_auc(b.scored(spark, d), ["run_id"]), default=6)


@query("roc_auc", with_ctes("scored", f"SELECT run_id, round({_AUC}, 6) AS roc_auc FROM cv GROUP BY run_id", **_CURVE))
def roc_auc(spark, d):
    return rounded(ev.roc_auc(b.scored(spark, d), ["run_id"]), default=6)


@query("brier_log_loss", with_ctes("scored", """
SELECT run_id, round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss
FROM (SELECT *, least(greatest(score, 1e-8), 1 - 1e-8) AS p FROM scored) GROUP BY run_id"""))
def brier_log_loss(spark, d):
    return rounded(ev.brier_log_loss(b.scored(spark, d), ["run_id"]), default=6)


_BINS = {"bn": """
  SELECT s.*, k AS bin FROM scored s JOIN range(15) AS r(k)
    ON score >= k / 15.0::DOUBLE AND (score < (k + 1) / 15.0::DOUBLE OR (k = 14 AND score <= 1.0))"""}


@query("reliability_table", with_ctes("scored", """
SELECT 'all' AS scope, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_p, round(avg(y), 6) AS rate,
  round(avg(y) - avg(score), 6) AS gap FROM bn GROUP BY bin""", **_BINS))
def reliability_table(spark, d):
    return rounded(ev.reliability_table(b.scored(spark, d)), default=6)


@query("ece", with_ctes("scored", """
SELECT run_id, round(sum(n * abs(g)) / sum(n), 6) AS ece FROM (
  SELECT run_id, bin, count(*) AS n, avg(y) - avg(score) AS g FROM bn GROUP BY run_id, bin) GROUP BY run_id""", **_BINS))
def ece(spark, d):
    return rounded(ev.ece(b.scored(spark, d), 15, ["run_id"]), default=6)


@query("metric_spread", with_ctes("scored", f"""
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (
  SELECT 'pr_auc' AS metric, {_AP} AS v FROM cv GROUP BY run_id
  UNION ALL SELECT 'roc_auc', {_AUC} FROM cv GROUP BY run_id
  UNION ALL SELECT 'brier', avg((least(greatest(score, 1e-8), 1 - 1e-8) - y) ** 2) FROM scored GROUP BY run_id) GROUP BY metric""", **_CURVE))
def metric_spread(spark, d):
    s = b.scored(spark, d)
    t = ev.pr_auc(s, ["run_id"]).join(ev.roc_auc(s, ["run_id"]), "run_id").join(ev.brier_log_loss(s, ["run_id"]), "run_id")
    return rounded(ev.metric_spread(t, ["pr_auc", "roc_auc", "brier"]), default=6)


@query("metric_table", with_ctes("scored", f"""
SELECT a.run_id, n_rows, round(mean_score, 6) AS mean_score, round(positive_rate, 6) AS positive_rate, round(pr, 6) AS pr_auc,
  round(auc, 6) AS roc_auc, round(brier, 6) AS brier, round(ll, 6) AS log_loss, round(e, 6) AS ece
FROM (SELECT run_id, count(*) AS n_rows, avg(score) AS mean_score, avg(y) AS positive_rate, avg((p - y) ** 2) AS brier,
    avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll FROM (SELECT *, least(greatest(score, 1e-8), 1 - 1e-8) AS p FROM scored) GROUP BY run_id) a
  JOIN (SELECT run_id, {_AP} AS pr, {_AUC} AS auc FROM cv GROUP BY run_id) c ON a.run_id = c.run_id
  JOIN (SELECT run_id, sum(n * abs(g)) / sum(n) AS e FROM (
    SELECT run_id, bin, count(*) AS n, avg(y) - avg(score) AS g FROM bn GROUP BY run_id, bin) GROUP BY run_id) x ON a.run_id = x.run_id""",
                                  **_CURVE, **_BINS))
def metric_table(spark, d):
    return rounded(ev.metric_table(b.scored(spark, d), ["run_id"]), default=6)


@query("pick_threshold", with_ctes("scored", """
SELECT 'all' AS scope, score AS threshold, round(f, 6) AS f_score FROM (
  SELECT *, 5 * p * r / (4 * p + r + 1e-15) AS f FROM (SELECT *, cum_pos / cum_n::DOUBLE AS p, cum_pos / all_pos::DOUBLE AS r FROM cva))
ORDER BY f DESC, score LIMIT 1""", **_CURVE))
def pick_threshold(spark, d):
    return ev.pick_threshold(b.scored(spark, d), 2.0).withColumn("f_score", F.round("f_score", 6))


def _units_sql(col: str, src: str) -> str:
    return f"SELECT run_id, unit_id, max(y) AS y, max({col}) AS s FROM {src} WHERE station_index < final_index GROUP BY run_id, unit_id"


def _first_sql(col: str, src: str, thr: str) -> str:
    return f"""SELECT run_id, unit_id, max(y) AS y, coalesce(bool_or({col} >= {thr}), false) AS alerted,
    arg_min(station_index, seq) FILTER ({col} >= {thr}) AS first_alert_station
  FROM {src} WHERE station_index < final_index GROUP BY run_id, unit_id"""


_POLICY_METRICS = """
  count(*) FILTER (y = 1) AS positive_units, count(*) FILTER (y = 0) AS negative_units,
  count(*) FILTER (y = 1 AND alerted) AS alerted_positive_units, count(*) FILTER (y = 0 AND alerted) AS alerted_negative_units,
  round(count(*) FILTER (y = 1 AND alerted) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 6) AS unit_recall,
  round(count(*) FILTER (y = 0 AND alerted) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE, 6) AS false_warning_rate,
  round(coalesce(count(*) FILTER (y = 1 AND alerted) / nullif(count(*) FILTER (alerted), 0)::DOUBLE, 0), 6) AS unit_precision,
  quantile_cont(first_alert_station, 0.5) FILTER (y = 1 AND alerted)::DOUBLE AS median_first_alert"""


@query("first_alerts", with_ctes("series", f"SELECT * FROM ({_first_sql('score', 'series', UTHR)})"))
def first_alerts(spark, d):
    return ev.first_alerts(b.scored_series(spark, d), UTHR)


@query("unit_policy_metrics", with_ctes("series", f"SELECT run_id, {_POLICY_METRICS} FROM ({_first_sql('score', 'series', UTHR)}) GROUP BY run_id"))
def unit_policy_metrics(spark, d):
    return rounded(ev.unit_policy_metrics(b.scored_series(spark, d), UTHR, by=["run_id"]), default=6)


CAP = 0.3


def _threshold_sql(src: str, col: str, cap: float) -> str:
    return f"""
SELECT 'all' AS scope, round(CASE WHEN ok THEN t ELSE (SELECT max(s) FROM u) END, 6) AS threshold, round(CASE WHEN ok THEN recall ELSE 0 END, 6)::DOUBLE AS unit_recall,
  round(CASE WHEN ok THEN fwr ELSE 0 END, 6)::DOUBLE AS false_warning_rate, round(CASE WHEN ok THEN prec ELSE 0 END, 6)::DOUBLE AS unit_precision,
  p AS positive_units, n AS negative_units
FROM (SELECT (SELECT count(*) FROM u WHERE y = 1) AS p, (SELECT count(*) FROM u WHERE y = 0) AS n) c
LEFT JOIN (SELECT t, recall, fwr, prec, (recall, prec, -fwr) >= (0.0, 0.0, 0.0) AS ok FROM (
    SELECT s AS t, sum(sum(y)) OVER w / (SELECT count(*) FROM u WHERE y = 1)::DOUBLE AS recall,
      sum(count(*) - sum(y)) OVER w / (SELECT count(*) FROM u WHERE y = 0)::DOUBLE AS fwr,
      sum(sum(y)) OVER w / sum(count(*)) OVER w::DOUBLE AS prec FROM u WHERE s IS NOT NULL GROUP BY s WINDOW w AS (ORDER BY s DESC))
  WHERE fwr <= {cap} + 1e-15 ORDER BY recall DESC, prec DESC, fwr LIMIT 1) b ON true"""


@query("unit_threshold", with_ctes("series", _threshold_sql("series", "score", CAP), u=_units_sql("score", "series")))
def unit_threshold(spark, d):
    return rounded(ev.unit_threshold(b.scored_series(spark, d), "score", CAP), default=6)


@query("unit_threshold_factory", with_ctes("scored", _threshold_sql("scored", "score", 0.2).replace("1e-15", "1e-12"), u=_units_sql("score", "scored")))
def unit_threshold_factory(spark, d):
    return rounded(ev.unit_threshold(b.scored(spark, d), "score", 0.2, slack=1e-12, floor_one=True), default=6)


@query("unit_threshold_grid", with_ctes("scored", """
SELECT threshold, round(recall, 6) AS unit_recall, round(fwr, 6) AS false_warning_rate, round(prec, 6) AS unit_precision FROM (
  SELECT round(q, 6) AS threshold, (SELECT count(*) FROM u WHERE y = 1 AND s >= q) / (SELECT count(*) FROM u WHERE y = 1)::DOUBLE AS recall,
    (SELECT count(*) FROM u WHERE y = 0 AND s >= q) / (SELECT count(*) FROM u WHERE y = 0)::DOUBLE AS fwr,
    coalesce((SELECT count(*) FROM u WHERE y = 1 AND s >= q) / nullif((SELECT count(*) FROM u WHERE s >= q), 0)::DOUBLE, 0) AS prec
  FROM (SELECT x + 1e-12 * 0 AS q FROM (SELECT unnest(quantile_cont(s, list_transform(range(101), lambda i: i / 100.0::DOUBLE))) AS x FROM u)))
WHERE fwr <= 0.2 ORDER BY recall DESC, prec DESC, fwr, threshold DESC LIMIT 1""", u=_units_sql("score", "scored")))
def unit_threshold_grid(spark, d):
    return rounded(ev.unit_threshold_grid(b.scored(spark, d), "score", 0.2, 101), default=6)


def _all_policy_sql() -> str:
    parts = []
    for i, p in enumerate(ev.POLICIES):
        parts.append(f"""SELECT '{p}' AS policy, {-i} AS policy_rank, t.threshold, t.unit_recall, t.false_warning_rate, t.unit_precision,
  t.positive_units, t.negative_units,
  (SELECT quantile_cont(first_alert_station, 0.5) FROM (SELECT max(y) AS y, arg_min(station_index, seq) FILTER ({p} >= t.threshold) AS first_alert_station
     FROM pol WHERE station_index < final_index GROUP BY run_id, unit_id) WHERE y = 1 AND first_alert_station IS NOT NULL)::DOUBLE AS median_first_alert
FROM ({_threshold_sql('pol', p, CAP).replace('FROM u ', f'FROM u{i} ').replace('FROM u)', f'FROM u{i})')}) t""")
    return " UNION ALL ".join(parts)


_UNITS6 = {f"u{i}": _units_sql(p, "pol") for i, p in enumerate(ev.POLICIES)}


@query("policy_table", with_ctes("series", "SELECT * EXCLUDE (policy_rank) FROM (" + _all_policy_sql() + ")", **POLICY_CTES, **_UNITS6))
def policy_table(spark, d):
    return rounded(ev.all_policies(policies(spark, d), CAP).drop("policy_rank"), default=6)


@query("policy_choice", with_ctes("series", f"""SELECT policy, threshold, unit_recall, unit_precision, false_warning_rate, median_first_alert
FROM ({_all_policy_sql()}) ORDER BY unit_recall DESC, unit_precision DESC, false_warning_rate, median_first_alert NULLS LAST, policy_rank DESC LIMIT 1""",
                                  **POLICY_CTES, **_UNITS6))
def policy_choice(spark, d):
    t = ev.all_policies(policies(spark, d), CAP)
    return rounded(ev.policy_choice(t).select("policy", "threshold", "unit_recall", "unit_precision", "false_warning_rate",
                                                            "median_first_alert"), default=6)


SWEEP = [0.3, 0.5, 0.6, 0.7, 0.8, 0.9]


@query("threshold_sweep", with_ctes("series", f"""
SELECT t AS threshold, round(count(*) FILTER (y = 1 AND s >= t) / count(*) FILTER (y = 1)::DOUBLE, 6) AS unit_recall,
  round(count(*) FILTER (y = 0 AND s >= t) / count(*) FILTER (y = 0)::DOUBLE, 6) AS false_warning_rate,
  round(coalesce(count(*) FILTER (y = 1 AND s >= t) / nullif(count(*) FILTER (s >= t), 0)::DOUBLE, 0), 6) AS unit_precision,
  count(*) FILTER (y = 1 AND s >= t) AS alerted_positive_units, count(*) FILTER (y = 0 AND s >= t) AS alerted_negative_units
FROM u, (SELECT unnest({SWEEP})::DOUBLE AS t) GROUP BY t""", u=_units_sql("score", "series")))
def threshold_sweep(spark, d):
    return rounded(ev.threshold_sweep(b.scored_series(spark, d), SWEEP, (0.6, 0.8), 0.1)[0], default=6)


@query("threshold_sweep_verdict", with_ctes("series", f"""
SELECT round(max(r) - min(r), 6) AS recall_span, round(max(f) - min(f), 6) AS fwr_span,
  CASE WHEN max(r) - min(r) <= 0.1 AND max(f) - min(f) <= 0.1 THEN 'PASS' ELSE 'WARN' END AS status
FROM (SELECT t, count(*) FILTER (y = 1 AND s >= t) / count(*) FILTER (y = 1)::DOUBLE AS r,
  count(*) FILTER (y = 0 AND s >= t) / count(*) FILTER (y = 0)::DOUBLE AS f
FROM u, (SELECT unnest({SWEEP})::DOUBLE AS t) WHERE t BETWEEN 0.6 AND 0.8 GROUP BY t)""", u=_units_sql("score", "series")))
def threshold_sweep_verdict(spark, d):
    return rounded(ev.threshold_sweep(b.scored_series(spark, d), SWEEP, (0.6, 0.8), 0.1)[1], default=6)


@query("wilson_interval", with_ctes("scored", """
SELECT run_id, k, n, round(greatest(0, (p + z * z / 2 / n - z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) * n / (n + z * z) * (1 + z * z / n) / (1 + z * z / n)), 6)::DOUBLE AS low,
  round(least(1, (p + z * z / 2 / n + z * sqrt(p * (1 - p) / n + z * z / 4 / n / n)) * n / (n + z * z)), 6)::DOUBLE AS high
FROM (SELECT run_id, CAST(sum(y) AS BIGINT) AS k, count(*) AS n, avg(y) AS p, 1.959963984540054::DOUBLE AS z FROM scored GROUP BY run_id)"""))
def wilson_interval(spark, d):
    g = b.scored(spark, d).groupBy("run_id").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = sc.wilson("k", "n")
    return rounded(g.select("run_id", "k", "n", low.alias("low"), high.alias("high")), default=6)


_HASH = "CAST('0x' || substr(sha256({}), 1, 13) AS BIGINT)"


@query("run_block_bootstrap", with_ctes("series", f"""
, per AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS pos, count(*) OVER () AS r, p, n, tp, fp FROM (SELECT run_id, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n,
  count(*) FILTER (y = 1 AND alerted) AS tp, count(*) FILTER (y = 0 AND alerted) AS fp FROM ({_first_sql('score', 'series', UTHR)}) GROUP BY run_id)),
draws AS (SELECT iteration, {_HASH.format("'7|' || iteration || '|' || pos")} % r AS pos FROM per, range(1000) AS t(iteration)),
sums AS (SELECT iteration, sum(p) AS p, sum(n) AS n, sum(tp) AS tp, sum(fp) AS fp FROM draws JOIN per ON per.pos = draws.pos GROUP BY iteration),
m AS (SELECT unnest([{{'metric': 'unit_recall', 'v': tp / nullif(p, 0)}}, {{'metric': 'false_warning_rate', 'v': fp / nullif(n, 0)}}, {{'metric': 'unit_precision', 'v': coalesce(tp / nullif(tp + fp, 0), 0)}}]) AS x FROM sums)
SELECT x.metric AS metric, round(avg(x.v), 6) AS mean, round(quantile_cont(x.v, 0.025), 6) AS low, round(quantile_cont(x.v, 0.975), 6) AS high FROM m GROUP BY x.metric"""))
def run_block_bootstrap(spark, d):
    return rounded(ev.run_block_bootstrap(b.scored_series(spark, d), UTHR), default=6)


@query("median_bootstrap", with_ctes("series", f"""
, alerts AS (SELECT first_alert_station::DOUBLE AS x, run_id || '|' || unit_id AS unit_key FROM ({_first_sql('score', 'series', UTHR)}) WHERE y = 1 AND alerted),
drawn AS (SELECT iteration, x, len([c FOR c IN {ev.poisson_steps()} IF {_HASH.format("'7|' || iteration || '|' || unit_key")} / 4503599627370496.0::DOUBLE >= c]) AS m FROM alerts, range(200) AS t(iteration)),
meds AS (SELECT iteration, quantile_cont(x, 0.5) AS med FROM (SELECT iteration, x, unnest(range(m)) FROM drawn) GROUP BY iteration)
SELECT round(avg(med), 6) AS mean, round(quantile_cont(med, 0.025), 6) AS low, round(quantile_cont(med, 0.975), 6) AS high FROM meds"""))
def median_bootstrap(spark, d):
    f = ev.first_alerts(b.scored_series(spark, d), UTHR).filter("y = 1 AND alerted").withColumn(
        "unit_key", F.concat_ws("|", "run_id", "unit_id"))
    return rounded(ev.median_bootstrap(f, "first_alert_station"), default=6)


_RUN_ORDER = "row_number() OVER (ORDER BY sha256('7|' || run_id), run_id)"


@query("group_folds", with_ctes("scored", """
SELECT run_id, CAST(ntile(5) OVER (ORDER BY sha256('7|' || run_id), run_id) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT run_id FROM scored)"""))
def group_folds(spark, d):
    return ev.group_folds(b.scored(spark, d), 5, 7)


@query("balanced_folds", with_ctes("scored", """
SELECT run_id, CAST(positives AS BIGINT) AS positives, n_units, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold FROM (
  SELECT *, row_number() OVER (ORDER BY positives DESC, n_units DESC, run_id) - 1 AS i FROM (
    SELECT run_id, sum(y) AS positives, count(*) AS n_units FROM u GROUP BY run_id))""", u=_units_sql("score", "scored")))
def balanced_folds(spark, d):
    return ev.balanced_folds(b.scored(spark, d), 5)


@query("split_runs", with_ctes("scored", """
SELECT run_id, CASE WHEN q < 0.2::DOUBLE THEN 'test' WHEN q < 0.2::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'train' END AS split FROM (
  SELECT run_id, (row_number() OVER (ORDER BY sha256('7|' || run_id), run_id) - 1) / (count(*) OVER ())::DOUBLE AS q
  FROM (SELECT DISTINCT run_id FROM scored))"""))
def split_runs(spark, d):
    return ev.split_runs(b.scored(spark, d), 0.15, 0.2, 7)


@query("resample_units", with_ctes("scored", f"""
, u AS (SELECT run_id, unit_id, max(y) AS y, {_HASH.format("'7|' || run_id || '|' || unit_id")} AS h FROM scored GROUP BY run_id, unit_id),
kept AS (SELECT run_id, unit_id FROM u WHERE y = 1 UNION ALL SELECT run_id, unit_id FROM (SELECT *, row_number() OVER (ORDER BY h, run_id, unit_id) AS r FROM u WHERE y = 0)
  WHERE r <= (SELECT round(count(*) FILTER (y = 1) * 0.7 / 0.3) FROM u))
SELECT s.run_id, s.unit_id, s.y, s.seq FROM scored s JOIN kept k ON k.run_id = s.run_id AND k.unit_id = s.unit_id"""))
def resample_units(spark, d):
    return ev.resample_units(b.scored(spark, d), 0.3, 7).select("run_id", "unit_id", "y", "seq")


@query("resample_units_counts", with_ctes("scored", """
SELECT count(*) FILTER (y = 1) AS positive_units, least(count(*) FILTER (y = 0), CAST(round(count(*) FILTER (y = 1) * 0.7 / 0.3) AS BIGINT)) AS negative_units
FROM (SELECT run_id, unit_id, max(y) AS y FROM scored GROUP BY run_id, unit_id)"""))
def resample_units_counts(spark, d):
    r = ev.resample_units(b.scored(spark, d), 0.3, 7).groupBy("run_id", "unit_id").agg(F.max("y").alias("y"))
    return r.agg(F.count_if(F.col("y") == 1).alias("positive_units"), F.count_if(F.col("y") == 0).alias("negative_units"))


_HARD = {
    "u": _units_sql("score", "series"),
    "hard": f"""
  SELECT run_id, unit_id, 'hard_negative' AS kind FROM (SELECT *, row_number() OVER (ORDER BY s DESC, run_id, unit_id) AS r,
    ceil(0.1::DOUBLE * count(*) OVER ()) AS take FROM u WHERE y = 0) WHERE r <= take
  UNION ALL SELECT run_id, unit_id, 'hard_positive' FROM ({_first_sql('score', 'series', 0.95)}) WHERE y = 1 AND NOT alerted""",
}


def _hard(spark, d):
    s = b.scored_series(spark, d)
    return s, ev.hard_examples(s, ev.first_alerts(s, 0.95))


@query("hard_examples", with_ctes("series", "SELECT * FROM hard", **_HARD))
def hard_examples(spark, d):
    return _hard(spark, d)[1]


@query("row_weights", with_ctes("series", """
SELECT s.run_id, s.unit_id, s.seq, CASE WHEN h.run_id IS NOT NULL THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM series s LEFT JOIN (SELECT * FROM hard WHERE kind = 'hard_positive') h ON s.run_id = h.run_id AND s.unit_id = h.unit_id""", **_HARD))
def row_weights(spark, d):
    s, h = _hard(spark, d)
    return ev.row_weights(s, h.filter("kind = 'hard_positive'"), 3.0).select("run_id", "unit_id", "seq", "weight")


@query("blend_scores", with_ctes("scored", """
SELECT run_id, unit_id, round(0.5 * score + 0.5 * other, 9) AS blend, round((score + other + score * other) / 3, 9) AS bagged,
  CASE WHEN station_index <= 17 THEN 'early' WHEN station_index <= 23 THEN 'mid' ELSE 'late' END AS band,
  round(CASE WHEN station_index <= 17 THEN score ELSE other END, 9) AS routed
FROM (SELECT run_id, unit_id, score, 1 - score * score AS other, station_index * 3 AS station_index FROM scored)"""))
def blend_scores(spark, d):
    s = b.scored(spark, d).withColumn("other", 1 - F.col("score") * F.col("score")).withColumn(
        "third", F.col("score") * F.col("other")).withColumn("station_index", F.col("station_index") * 3)
    s = ev.stage_route(ev.bagged_mean(ev.blend(s, "score", "other"), ["score", "other", "third"]),
                       {"early": "score", "mid": "other", "late": "other"})
    return rounded(s.select("run_id", "unit_id", "blend", "bagged", "band", "routed"), default=9)


def contributions(spark, d):
    """Long contribution rows of the bottleneck prediction binding."""
    p = b.bottleneck_predictions(spark, d)
    return p.select(F.col("emission").alias("row_id"), "probability", F.explode("drivers").alias("x")).select(
        "row_id", "x.feature", F.when(F.col("x.direction") == "decreases_risk", -F.col("x.contribution"))
        .otherwise(F.col("x.contribution")).alias("contribution"))


CONTRIB = {"cb": f"""
  SELECT emission AS row_id, list_extract({b.DRIVER_FEATURES}, j + 1) AS feature, (j + 1) / 10.0::DOUBLE * CASE WHEN j % 3 = 2 THEN -1 ELSE 1 END AS contribution
  FROM (SELECT emission, (k + o) % 6 AS j FROM bp, range(3) AS r(o))"""}


@query("top_k_drivers", with_ctes("bp", """
SELECT row_id, feature, contribution, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank, CASE WHEN contribution > 0 THEN 'increases_risk' WHEN contribution < 0 THEN 'decreases_risk' ELSE 'neutral' END AS direction
FROM cb QUALIFY rank <= 2""", **CONTRIB))
def top_k_drivers(spark, d):
    return sel.top_k_drivers(contributions(spark, d), 2)


@query("top_k_signed", with_ctes("bp", """
SELECT row_id, feature, contribution, CASE WHEN contribution > 0 THEN 'increases' ELSE 'decreases' END AS effect, CAST(row_number() OVER (PARTITION BY row_id, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank
FROM cb WHERE contribution <> 0 QUALIFY rank <= 1""", **CONTRIB))
def top_k_signed(spark, d):
    return sel.top_k_signed(contributions(spark, d), 1)


@query("global_importance", with_ctes("bp", """
SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs, round(avg(contribution), 6) AS mean_signed FROM cb GROUP BY feature""", **CONTRIB))
def global_importance(spark, d):
    return rounded(ev.global_importance(contributions(spark, d)), default=6)


@query("contribution_audit", with_ctes("bp", """
SELECT count(*) AS n, round(max(abs(rebuilt - margin)), 6) AS max_margin_error,
  round(max(abs(1 / (1 + exp(-rebuilt)) - 1 / (1 + exp(-margin)))), 6) AS max_probability_error,
  max(abs(rebuilt - margin)) > 1e-5 OR max(abs(1 / (1 + exp(-rebuilt)) - 1 / (1 + exp(-margin)))) > 1e-5 AS rejected
FROM (SELECT row_id, -1.0::DOUBLE + sum(contribution) AS rebuilt, -1.0::DOUBLE + sum(contribution) + CASE WHEN row_id % 1000 = 0 THEN 0.001::DOUBLE ELSE 0 END AS margin FROM cb GROUP BY row_id)""", **CONTRIB))
def contribution_audit(spark, d):
    c = contributions(spark, d)
    p = c.groupBy("row_id").agg((F.lit(-1.0) + F.sum("contribution")).alias("m")).select(
        "row_id", F.lit(-1.0).alias("base"), (F.col("m") + F.when(F.col("row_id") % 1000 == 0, 0.001).otherwise(0.0)).alias("margin"))
    p = p.withColumn("probability", sc.sigmoid("margin"))
    return rounded(ev.contribution_audit(c, p), default=6)


@query("case_samples", with_ctes("scored", f"""
SELECT run_id, unit_id, "case", score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY pick, seq) AS rank FROM (
  SELECT *, CASE WHEN score >= {THR} AND y = 1 THEN 'TP' WHEN score >= {THR} THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS "case",
    CASE WHEN score >= {THR} THEN -score ELSE abs(score - {THR}) END AS pick FROM scored)) WHERE rank <= 5"""))
def case_samples(spark, d):
    return sel.case_samples(b.scored(spark, d), THR, 5).select("run_id", "unit_id", "case", "score", "rank")


@query("first_alert", with_ctes("series", f"""
SELECT run_id, unit_id, min(seq) AS seq, arg_min(station_index, seq) AS station_index, arg_min(score, seq) AS score
FROM series WHERE score >= {UTHR} GROUP BY run_id, unit_id"""))
def first_alert(spark, d):
    return sel.first_alert(b.scored_series(spark, d), UTHR)


@query("unit_labels", with_ctes("series", "SELECT run_id, unit_id, max(y) AS y, count(*) AS n_rows FROM series GROUP BY run_id, unit_id"))
def unit_labels(spark, d):
    return b.scored_series(spark, d).groupBy("run_id", "unit_id").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("n_rows"))


@query("unit_prevalence", with_ctes("series", """
SELECT run_id, round(avg(y), 6) AS prevalence, count(*) AS n_units FROM (SELECT run_id, unit_id, max(y) AS y FROM series GROUP BY run_id, unit_id) GROUP BY run_id"""))
def unit_prevalence(spark, d):
    return rounded(unit_labels(spark, d).groupBy("run_id").agg(F.avg("y").alias("prevalence"), F.count(F.lit(1)).alias("n_units")), default=6)
