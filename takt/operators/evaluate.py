"""Scoring metrics, thresholds, alert-policy evaluation, folds and resampling.

Inputs are rows (run_id, unit_id, y, score, station_index, final_index, seq). Curves work on distinct
scores with counts, scanned in score slices, so a metric over all rows never sorts rows in one task.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takt.functions import scalar as sc
from takt.operators.slices import beside, exact_quantiles, numbered, running, total
from takt.session import cut_lineage

POLICIES = ["raw", "ema_03", "ema_05", "ema_07", "two_consecutive", "two_of_three"]


def scoped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("scope", F.lit("all")), ["scope"])


def totals_of(df: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """Totals per group; over everything, one row without a key, where the only group is the whole."""
    return df.agg(*aggregates) if by == ["scope"] else df.groupBy(*by).agg(*aggregates)


def attached(df: DataFrame, totals: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Totals beside each row of their group: an equi-join, or a scalar subquery for the whole."""
    return beside(df, totals) if by == ["scope"] else df.join(totals, by, how)


def curve(scored: DataFrame, by: list[str], score: str = "score", weight: Column | None = None) -> DataFrame:
    """Per distinct score (descending): own and cumulative counts of rows and positives, and totals."""
    w = weight if weight is not None else F.lit(1)
    hist = (scored.filter(F.col(score).isNotNull()).withColumn("__neg", -F.col(score).cast("double"))
            .groupBy(*by, "__neg").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("pos")))
    cum = running(hist, by, ["__neg"], {"cum_n": total("n"), "cum_pos": total("pos")},
                  slice_col=F.floor(F.col("__neg") * 1024))
    tot = totals_of(hist, by, F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    return attached(cum, tot, by).withColumn("threshold", -F.col("__neg")).drop("__neg")


def confusion(scored: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """Counts and threshold metrics; 0 on empty denominators."""
    df, by = scoped(scored, list(by))
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    c = df.groupBy(*by).agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
                            F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    p, r = sc.rate("tp", F.col("tp") + F.col("fp")), sc.rate("tp", F.col("tp") + F.col("fn"))
    spec = sc.rate("tn", F.col("tn") + F.col("fp"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn(
        "balanced_accuracy", (F.col("recall") + spec) / 2).withColumn(
        "f1", sc.rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn(
        "f2", sc.rate(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")))


def pr_auc(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Average precision over distinct scores; the positive rate for a single class."""
    df, by = scoped(scored, list(by))
    c = curve(df, by)
    step = F.col("pos") * F.col("cum_pos") / F.col("cum_n")
    one = (F.max("all_pos") == 0) | (F.max("all_pos") == F.max("all_n"))
    return c.groupBy(*by).agg(F.when(one, F.max("all_pos") / F.max("all_n"))
                              .otherwise(sc.ratio(F.sum(step), F.max("all_pos"))).alias("pr_auc"))


def roc_auc(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; NULL for a single class."""
    df, by = scoped(scored, list(by))
    c = curve(df, by)
    neg, cum_neg = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    below = F.col("all_n") - F.col("all_pos") - cum_neg
    won = F.sum(F.col("pos") * (below + neg / 2))
    return c.groupBy(*by).agg(sc.ratio(won, F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("roc_auc"))


def brier_log_loss(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    df, by = scoped(scored, list(by))
    p, y = sc.clip_probability("score", 1e-8), F.col("y")
    return df.groupBy(*by).agg(
        F.avg(F.pow(p - y, 2)).alias("brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def _bin(p: Column, bins: int) -> Column:
    """Equal-width bin, last one closed; the guess from p * bins is settled against the edges k / bins."""
    k = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    k = F.when(p < k / F.lit(float(bins)), k - 1).when((k < bins - 1) & (p >= (k + 1) / F.lit(float(bins))), k + 1).otherwise(k)
    return k.cast("int")


def reliability_table(scored: DataFrame, bins: int = 15, by: list[str] = ()) -> DataFrame:
    df, by = scoped(scored, list(by))
    return df.withColumn("bin", _bin(F.col("score"), bins)).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_p"), F.avg("y").alias("rate")).withColumn(
        "gap", F.col("rate") - F.col("mean_p"))


def ece(scored: DataFrame, bins: int = 15, by: list[str] = ()) -> DataFrame:
    t = reliability_table(scored, bins, by)
    by = list(by) or ["scope"]
    return t.groupBy(*by).agg(sc.ratio(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("ece"))


def metric_table(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """All probability metrics side by side."""
    keys = list(by) or ["scope"]
    df, _ = scoped(scored, list(by))
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("score").alias("mean_score"),
                                 F.avg("y").alias("positive_rate"))
    out = base
    for part in (pr_auc(scored, by), roc_auc(scored, by), brier_log_loss(scored, by), ece(scored, 15, by)):
        out = out.join(part, keys)
    return out


def metric_spread(table: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample std, min and max of each metric across rows (runs or folds)."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                                            for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                      F.min("v").alias("min"), F.max("v").alias("max"))


def pick_threshold(scored: DataFrame, beta: float = 2.0, by: list[str] = ()) -> DataFrame:
    """Threshold with the best F-beta on the curve; the lowest one wins ties."""
    df, by = scoped(scored, list(by))
    c = curve(df, by)
    p, r = F.col("cum_pos") / F.col("cum_n"), sc.rate("cum_pos", "all_pos")
    b2 = beta * beta
    f = (1 + b2) * p * r / (b2 * p + r + 1e-15)
    return (c.withColumn("f_score", f).groupBy(*by)
            .agg(F.max_by(F.struct("threshold", "f_score"), F.struct("f_score", -F.col("threshold"))).alias("b"))
            .select(*by, "b.threshold", "b.f_score"))


def unit_table(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row per unit from the rows before its final inspection: label and largest score."""
    return scored.filter(F.col("station_index") < F.col("final_index")).groupBy("run_id", "unit_id").agg(
        F.max("y").alias("y"), F.max(score).alias("max_score"))


def first_alerts(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Per unit: label, whether it was alerted, station of its first alert."""
    hit = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return scored.filter(F.col("station_index") < F.col("final_index")).groupBy("run_id", "unit_id").agg(
        F.max("y").alias("y"), F.bool_or(hit).alias("alerted"),
        F.min_by("station_index", F.when(hit, F.col("seq"))).alias("first_alert_station"))


def _policy_from_units(units: DataFrame, by: list[str]) -> DataFrame:
    """Metrics from unit rows (y, alerted, first_alert_station)."""
    pos, hit = F.col("y") == 1, F.col("alerted")
    counts = units.groupBy(*by).agg(
        F.count_if(pos).alias("positive_units"), F.count_if(~pos).alias("negative_units"),
        F.count_if(pos & hit).alias("alerted_positive_units"), F.count_if(~pos & hit).alias("alerted_negative_units"))
    med = exact_quantiles(units.filter(pos & hit), by, "first_alert_station", {"median_first_alert": 0.5},
                          slice_col=F.col("__x").cast("long"))
    tp, fp = F.col("alerted_positive_units"), F.col("alerted_negative_units")
    return counts.join(med, by, "left").select(
        *by, "positive_units", "negative_units", tp, fp, sc.ratio(tp, "positive_units").alias("unit_recall"),
        sc.ratio(fp, "negative_units").alias("false_warning_rate"), sc.rate(tp, tp + fp).alias("unit_precision"),
        "median_first_alert")


def unit_policy_metrics(scored: DataFrame, threshold: float, score: str = "score", by: list[str] = ()) -> DataFrame:
    df, by = scoped(first_alerts(scored, threshold, score), list(by))
    return _policy_from_units(df, by)


def unit_threshold(scored: DataFrame, score: str = "score", cap: float = 0.05, slack: float = 1e-15,
                   by: list[str] = (), floor_one: bool = False) -> DataFrame:
    """Best feasible unit-level threshold (recall, precision, -false-warning rate) under the cap.

    Without a feasible one, or when every feasible one is worse than silence, the threshold lies just
    above the largest score (no alert).
    """
    df, by = scoped(unit_table(scored, score), list(by))
    return threshold_from_units(df, by, cap, slack, floor_one)


def threshold_from_units(df: DataFrame, by: list[str], cap: float, slack: float = 1e-15, floor_one: bool = False) -> DataFrame:
    """The same search from unit rows (y, max_score); units without a score stay in the denominators."""
    c = curve(df.withColumnRenamed("max_score", "s"), by, "s")
    totals = totals_of(df, by, F.count_if(F.col("y") == 1).alias("total_pos"), F.count_if(F.col("y") == 0).alias("total_neg"),
                       F.max("max_score").alias("top"))
    j = attached(c, totals, by)
    recall = sc.ratio("cum_pos", "total_pos")
    fwr = sc.ratio(F.col("cum_n") - F.col("cum_pos"), "total_neg")
    precision = F.col("cum_pos") / (F.greatest(F.lit(1), F.col("cum_n")) if floor_one else F.col("cum_n"))
    rank = F.struct(recall.alias("recall"), precision.alias("precision"), (-fwr).alias("neg_fwr"))
    best = totals_of(j.withColumn("rank", rank).filter(-F.col("rank.neg_fwr") <= cap + slack), by, F.max(F.struct("rank", "threshold")).alias("b"))
    none_rank = F.struct(F.lit(0.0).alias("recall"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("neg_fwr"))
    use = F.col("b").isNotNull() & ~F.coalesce(none_rank > F.col("b.rank"), F.lit(False))
    above = F.col("top") + F.greatest(F.abs("top"), F.lit(1e-300)) * 2.220446049250313e-16
    if by == ["scope"]:
        totals = totals.filter("total_pos + total_neg > 0 OR top IS NOT NULL").withColumn("scope", F.lit("all"))
    return attached(totals, best, by, "left").select(
        *by, F.when(use, F.col("b.threshold")).otherwise(above).alias("threshold"),
        F.when(use, F.col("b.rank.recall")).otherwise(0.0).alias("unit_recall"),
        F.when(use, -F.col("b.rank.neg_fwr")).otherwise(0.0).alias("false_warning_rate"),
        F.when(use, F.col("b.rank.precision")).otherwise(0.0).alias("unit_precision"),
        F.col("total_pos").alias("positive_units"), F.col("total_neg").alias("negative_units"))


def unit_threshold_grid(scored: DataFrame, score: str = "score", cap: float = 0.05, points: int = 2001) -> DataFrame:
    """Older search: candidates are evenly spaced quantiles of the unit scores, not the scores themselves."""
    units = unit_table(scored, score).withColumn("scope", F.lit("all"))
    qs = exact_quantile_grid(units, "max_score", points)
    # every candidate is answered from the cumulative curve: counts at or above it
    c = curve(units.withColumnRenamed("max_score", "s"), ["scope"], "s")
    asked = (qs.select(F.lit("all").alias("scope"), (-F.col("q")).alias("__neg"), F.lit(1).alias("k"), F.col("q"))
             .unionByName(c.select("scope", (-F.col("threshold")).alias("__neg"), F.lit(0).alias("k"),
                                   F.struct("cum_n", "cum_pos").alias("got"), "all_n", "all_pos"), allowMissingColumns=True))
    from takt.operators.slices import latest
    seen = running(asked, ["scope"], ["__neg", "k"], {"at": latest("got")}, slice_col=F.floor(F.col("__neg") * 1024))
    r = beside(seen.filter("k = 1").drop("all_n", "all_pos"), c.agg(F.max("all_n").alias("all_n"), F.max("all_pos").alias("all_pos")))
    recall, fwr = sc.ratio("at.cum_pos", "all_pos"), sc.ratio(F.col("at.cum_n") - F.col("at.cum_pos"), F.col("all_n") - F.col("all_pos"))
    ranked = r.select("q", recall.alias("unit_recall"), fwr.alias("false_warning_rate"),
                      sc.rate("at.cum_pos", "at.cum_n").alias("unit_precision")).filter(F.col("false_warning_rate") <= cap)
    return ranked.agg(F.max(F.struct("unit_recall", "unit_precision", (-F.col("false_warning_rate")).alias("neg_fwr"),
                                     F.col("q").alias("threshold"))).alias("b")).select(
        "b.threshold", "b.unit_recall", (-F.col("b.neg_fwr")).alias("false_warning_rate"), "b.unit_precision")


def exact_quantile_grid(df: DataFrame, value: str, points: int) -> DataFrame:
    """Evenly spaced linear quantiles of one column as rows (i, q)."""
    from takt.operators.slices import latest
    hist = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0))
    cum = running(hist, ["g"], ["x"], {"cum": total("n")}, slice_col=F.floor(F.col("x") * 1024))
    size = cum.groupBy("g").agg(F.max("cum").alias("size"))
    grid = (size.select("g", "size", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
            .withColumn("pos", F.col("i") * (F.col("size") - 1) / F.lit(float(points - 1))))
    ask = grid.select("g", "i", "pos", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.floor("pos").alias("at")),
                                                         F.struct(F.lit(1).alias("e"), F.ceil("pos").alias("at")))).alias("a"))
    # the value holding 0-based rank r is the first one whose cumulative count exceeds r: look down from above
    rows = (cum.select("g", (-(F.col("cum") - 1)).alias("o"), F.lit(0).alias("k"), F.col("x").alias("v"))
            .unionByName(ask.select("g", (-F.col("a.at")).alias("o"), F.lit(1).alias("k"), "i", "pos", F.col("a.e").alias("e")),
                         allowMissingColumns=True))
    got = running(rows, ["g"], ["o", "k"], {"val": latest("v")}, width=1 << 16).filter("k = 1")
    lo, hi = F.max(F.when(F.col("e") == 0, F.col("val"))), F.max(F.when(F.col("e") == 1, F.col("val")))
    frac = F.max(F.col("pos") - F.floor("pos"))
    return got.groupBy("i").agg((lo + frac * (hi - lo)).alias("q"))


def policy_choice(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """Lexicographic best row: recall, precision, fewer false warnings, earlier median alert."""
    df, by = scoped(table, list(by))
    median = F.coalesce(-F.col("median_first_alert"), F.lit(float("-inf")))
    order = F.struct(F.col("unit_recall"), F.col("unit_precision"), -F.col("false_warning_rate"), median, F.col("policy_rank"))
    keep = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("r")).select(*by, "r.*")


def all_policies(scored_policies: DataFrame, cap: float = 0.05) -> DataFrame:
    """Unit threshold and metrics of every policy column, one row per policy.

    The policy columns become long rows once, so all policies share the same passes.
    """
    pre = scored_policies.filter(F.col("station_index") < F.col("final_index")).select(
        "run_id", "unit_id", "y", "station_index", "seq", F.explode(F.array(*[
            F.struct(F.lit(p).alias("policy"), F.lit(-i).alias("policy_rank"), F.col(p).alias("s"))
            for i, p in enumerate(POLICIES)])).alias("x")).select("*", "x.*").drop("x")
    by = ["policy", "policy_rank"]
    # unit-level tables are read by several scans each: written once, so the score series is scanned twice in all
    units = cut_lineage(pre.groupBy(*by, "run_id", "unit_id").agg(F.max("y").alias("y"), F.max("s").alias("max_score")))
    t = cut_lineage(threshold_from_units(units, by, cap))
    hit = F.coalesce(F.col("s") >= F.col("threshold"), F.lit(False))
    firsts = cut_lineage(pre.join(t.select(*by, "threshold"), by).groupBy(*by, "run_id", "unit_id").agg(
        F.max("y").alias("y"), F.bool_or(hit).alias("alerted"),
        F.min_by("station_index", F.when(hit, F.col("seq"))).alias("first_alert_station")))
    return t.join(_policy_from_units(firsts, by).select(*by, "median_first_alert"), by, "left")


def threshold_sweep(scored: DataFrame, thresholds: list[float], window: tuple[float, float], tolerance: float,
                    score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Unit metrics at each threshold, and PASS/WARN from their span inside a window.

    Units are reduced to one row each first; all thresholds are counted in that one pass.
    """
    u = unit_table(scored, score)
    pos = F.col("y") == 1
    aggs = [F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")]
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.col("max_score") >= t, F.lit(False))
        aggs += [F.count_if(pos & hit).alias(f"tp{i}"), F.count_if(~pos & hit).alias(f"fp{i}")]
    rows = u.agg(*aggs).select("p", "n", F.explode(F.array(*[F.struct(
        F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)])).alias("x"))
    table = rows.select("x.threshold", sc.ratio("x.tp", "p").alias("unit_recall"), sc.ratio("x.fp", "n").alias("false_warning_rate"),
                        sc.rate("x.tp", F.col("x.tp") + F.col("x.fp")).alias("unit_precision"),
                        F.col("x.tp").alias("alerted_positive_units"), F.col("x.fp").alias("alerted_negative_units"))
    inside = table.filter(F.col("threshold").between(*window))
    verdict = inside.agg((F.max("unit_recall") - F.min("unit_recall")).alias("recall_span"),
                         (F.max("false_warning_rate") - F.min("false_warning_rate")).alias("fwr_span")).withColumn(
        "status", F.when((F.col("recall_span") <= tolerance) & (F.col("fwr_span") <= tolerance), "PASS").otherwise("WARN"))
    return table, verdict


def run_block_bootstrap(scored: DataFrame, threshold: float, iterations: int = 1000, seed: int = 7,
                        score: str = "score") -> DataFrame:
    """Resample whole runs with replacement; 2.5 / 97.5 % quantiles of the unit metrics.

    Runs shrink to four counts first. Each iteration draws as many runs as there are, by seeded hash,
    so a draw needs no random state and repeats exactly.
    """
    per_run = first_alerts(scored, threshold, score).groupBy("run_id").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"),
        F.count_if((F.col("y") == 1) & F.col("alerted")).alias("tp"), F.count_if((F.col("y") == 0) & F.col("alerted")).alias("fp"))
    ids = numbered_runs(per_run)
    size = per_run.agg(F.count(F.lit(1)).alias("r"))
    draws = (beside(ids.select("pos"), size)
             .select("pos", "r", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
             .select("iteration", F.pmod(hashed(F.lit(str(seed)), "iteration", "pos"), F.col("r")).alias("pos")))
    sums = draws.join(ids, "pos").groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("p", "n", "tp", "fp")])
    m = sums.select(sc.ratio("tp", "p").alias("unit_recall"), sc.ratio("fp", "n").alias("false_warning_rate"),
                    sc.rate("tp", F.col("tp") + F.col("fp")).alias("unit_precision"))
    # one value per iteration: the quantile input is bounded by the iteration count
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in m.columns])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("low"),
                                      F.percentile("v", F.lit(0.975)).alias("high"))


def hashed(*parts) -> Column:
    """Whole number below 16^13 that the parts' text decides, the same in any engine that has SHA-256."""
    text = F.concat_ws("|", *[sc.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def poisson_steps(mean: float = 1.0) -> list[float]:
    """Cumulative Poisson probabilities up to the last one below 1 in double precision."""
    p, total, steps, k = math.exp(-mean), 0.0, [], 0
    while total + p > total:
        total += p
        steps.append(total)
        k += 1
        p *= mean / k
    return [x for x in steps if x < 1.0]


def median_bootstrap(values: DataFrame, value: str, iterations: int = 200, seed: int = 7) -> DataFrame:
    """Bootstrap of a median over few distinct levels: each iteration reweights the level counts.

    Poisson(1) multiplicities per (iteration, row), by the whole inverse distribution of a hashed uniform, are
    summed per level before any shuffle, so the shuffle carries iterations x levels, not rows. A median of an even
    number of rows is the mean of the two in the middle.
    """
    u = hashed(F.lit(str(seed)), "iteration", "unit_key") / F.lit(float(16 ** 13))
    times = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in poisson_steps()), F.lit(0))
    w = (values.select(F.col(value).cast("double").alias("x"), "unit_key",
                       F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")).withColumn("u", u)
         .withColumn("m", times).filter("m > 0").groupBy("iteration", "x").agg(F.sum("m").alias("m")))
    order = Window.partitionBy("iteration").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    c = w.withColumn("cum", F.sum("m").over(order)).withColumn("all", F.sum("m").over(Window.partitionBy("iteration")))
    low, high = F.min(F.when(F.col("cum") * 2 >= F.col("all"), F.col("x"))), F.min(F.when(F.col("cum") * 2 > F.col("all"), F.col("x")))
    med = c.groupBy("iteration").agg(((low + high) / 2).alias("median"))
    return med.agg(F.avg("median").alias("mean"), F.percentile("median", F.lit(0.025)).alias("low"),
                   F.percentile("median", F.lit(0.975)).alias("high"))


def numbered_runs(df: DataFrame) -> DataFrame:
    """0-based position of each run in id order (one row per run)."""
    return df.withColumn("pos", (F.row_number().over(Window.orderBy("run_id")) - 1).cast("long"))


def _in_hash_order(df: DataFrame, seed: int) -> DataFrame:
    """Runs with their number from 1 in seeded hash order and how many there are; counted slice by slice, not in one task."""
    runs = df.select("run_id").distinct().withColumn("__h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "run_id"), 256)).withColumn("__one", F.lit(0))
    ranked = numbered(runs, ["__one"], ["__h", "run_id"], slice_col=F.conv(F.substring("__h", 1, 3), 16, 10).cast("long"))
    return beside(ranked, runs.agg(F.count(F.lit(1)).alias("__n")))


def group_folds(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Whole runs to folds of sizes at most one apart, in seeded hash order."""
    each, more, i = F.floor(F.col("__n") / k), F.col("__n") % k, F.col("rn") - 1
    longer = more * (each + 1)  # the first folds have one run more
    fold = F.when(i < longer, F.floor(i / (each + 1))).otherwise(more + F.floor((i - longer) / F.greatest(each, F.lit(1))))
    return _in_hash_order(df, seed).select("run_id", fold.cast("int").alias("fold"))


def balanced_folds(df: DataFrame, k: int) -> DataFrame:
    """Whole runs dealt in a snake by their positive units, so folds hold similar numbers of them."""
    runs = unit_table(df).groupBy("run_id").agg(F.sum("y").alias("positives"), F.count(F.lit(1)).alias("n_units"))
    keyed = runs.select("*", (-F.col("positives")).alias("__p"), (-F.col("n_units")).alias("__u"), F.lit(0).alias("__one"))
    i = F.col("rn") - 1
    return numbered(keyed, ["__one"], ["__p", "__u", "run_id"], slice_col=F.col("__p")).select("run_id", "positives", "n_units", F.when(
        F.floor(i / k) % 2 == 0, i % k).otherwise(k - 1 - i % k).cast("int").alias("fold"))


def split_runs(df: DataFrame, val_share: float, test_share: float, seed: int = 0) -> DataFrame:
    """train / val / test by whole run in seeded hash order."""
    q = (F.col("rn") - 1) / F.col("__n")
    return _in_hash_order(df, seed).select("run_id", F.when(q < test_share, "test").when(q < test_share + val_share, "val").otherwise("train").alias("split"))


def resample_units(df: DataFrame, target_rate: float, seed: int = 0, forced: DataFrame | None = None) -> DataFrame:
    """Keep positive units, draw negatives down to the target unit rate, keep all rows of kept units.

    The n-th smallest seeded hash is found from hash-slice counts; no single task ranks all units.
    """
    u = df.groupBy("run_id", "unit_id").agg(F.max("y").alias("y")).withColumn(
        "h", hashed(F.lit(str(seed)), "run_id", "unit_id"))
    if forced is not None:
        u = u.join(forced.select("run_id", "unit_id", F.lit(True).alias("forced")), ["run_id", "unit_id"], "left")
        u = u.withColumn("h", F.when(F.coalesce("forced", F.lit(False)), F.lit(-1).cast("long")).otherwise(F.col("h"))).drop("forced")
    u = u.withColumn("g", F.lit(0))
    need = u.agg(F.round(F.count_if(F.col("y") == 1) * (1 - target_rate) / target_rate).cast("long").alias("need"))
    neg = running(u.filter("y = 0"), ["g"], ["h", "run_id", "unit_id"], {"rn": total(F.lit(1))},
                  slice_col=F.shiftright("h", 42))
    kept = beside(neg, need).filter(F.col("rn") <= F.col("need")).select("run_id", "unit_id").unionByName(
        u.filter("y = 1").select("run_id", "unit_id"))
    return df.join(kept, ["run_id", "unit_id"], "left_semi")


def row_weights(df: DataFrame, hard: DataFrame, weight: float) -> DataFrame:
    mark = hard.select("run_id", "unit_id", F.lit(True).alias("__hard"))
    return df.join(mark, ["run_id", "unit_id"], "left").withColumn(
        "weight", F.when(F.col("__hard"), weight).otherwise(1.0)).drop("__hard")


def hard_examples(scored: DataFrame, policy_units: DataFrame, share: float = 0.1) -> DataFrame:
    """Hardest ceil(share) negatives by largest score, and positives the policy missed."""
    u = unit_table(scored).withColumn("g", F.lit(0))
    neg = u.filter("y = 0").withColumn("neg", -F.coalesce("max_score", F.lit(-1.0)))
    size = neg.agg(F.ceil(share * F.count(F.lit(1))).alias("take"))
    ranked = running(neg, ["g"], ["neg", "run_id", "unit_id"], {"rn": total(F.lit(1))}, slice_col=F.floor(F.col("neg") * 1024))
    hard_neg = beside(ranked, size).filter(F.col("rn") <= F.col("take")).select(
        "run_id", "unit_id", F.lit("hard_negative").alias("kind"))
    missed = policy_units.filter((F.col("y") == 1) & ~F.col("alerted")).select(
        "run_id", "unit_id", F.lit("hard_positive").alias("kind"))
    return hard_neg.unionByName(missed)


def blend(scores: DataFrame, a: str, z: str, weight: float = 0.5) -> DataFrame:
    return scores.withColumn("blend", weight * F.col(a) + (1 - weight) * F.col(z))


def bagged_mean(scores: DataFrame, columns: list[str]) -> DataFrame:
    return scores.withColumn("bagged", sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns))


def stage_route(scores: DataFrame, by_band: dict[str, str]) -> DataFrame:
    """Take each row's score from the model of its line stage."""
    band = sc.stage_band("station_index")
    pick = F.coalesce(*[F.when(band == b, F.col(c)) for b, c in by_band.items()])
    return scores.withColumn("band", band).withColumn("routed", pick)


def contribution_audit(contrib: DataFrame, preds: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """base + contributions against the margin, and the probability it implies."""
    s = contrib.groupBy("row_id").agg(F.sum("contribution").alias("total"))
    j = preds.join(s, "row_id").withColumn("rebuilt", F.col("base") + F.col("total"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("rebuilt") - F.col("margin"))).alias("max_margin_error"),
                 F.max(F.abs(sc.sigmoid("rebuilt") - F.col("probability"))).alias("max_probability_error")).withColumn(
        "rejected", (F.col("max_margin_error") > tolerance) | (F.col("max_probability_error") > tolerance))


def global_importance(contrib: DataFrame) -> DataFrame:
    return contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean_signed"))
