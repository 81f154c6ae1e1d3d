"""Structured Streaming operators over the bus and the prediction streams."""
from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from takt.contracts import FLOW_FEATURES, FLOW_META, PREDICTIONS, TABLES
from takt.plans import station_flow as flow_features
from takt.plans import unit_quality
from takt.streaming import folds
from takt.streaming.timed import check_provider, flow_rows_stream, unit_history_stream


END = "end_of_run"  # a leading underscore would be renamed on the way to Python


class KeyedFold(StatefulProcessor):
    """Keeps one small state value per key and hands each micro-batch of the key to a pure step; an end row clears the key."""

    def __init__(self, step: Callable, order: Sequence[str], columns: Sequence[str], whole: Sequence[str], ttl_ms: int | None = None):
        self.step, self.order, self.columns, self.whole, self.ttl_ms = step, list(order), list(columns), list(whole), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the store drops a key ttl_ms after its last write
        self.state = handle.getValueState("state", "blob binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        got = self.state.get() if self.state.exists() else None
        state = pickle.loads(bytes(got[0])) if got is not None else {}
        pdf = pd.concat(list(rows), ignore_index=True)
        ended = False
        if END in pdf:
            ended = bool(pdf[END].any())
            pdf = pdf[~pdf[END].astype(bool)].drop(columns=END)
            pdf = pdf.astype({c: "int64" for c in self.whole if not pdf[c].isna().any()})  # end rows had NULLs there
        if len(pdf):
            state, out = self.step(key, state, pdf.sort_values(self.order, kind="stable"))
            yield out[self.columns].astype(object).where(out[self.columns].notna(), None)
        if ended:
            self.state.clear()
        elif len(pdf):
            self.state.update((pickle.dumps(state),))

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, keys: Sequence[str], step: Callable, order: Sequence[str], schema: str, ttl_ms: int | None = None,
                ends: DataFrame | None = None) -> DataFrame:
    """Run a fold per key; state lives in RocksDB, so it may be larger than executor memory.

    ``ends`` is a stream of keys that are over (see ``end_rows``); their state is removed. What comes for such a key
    later starts anew.
    """
    check_provider(stream.sparkSession)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    whole = [c for c, t in stream.dtypes if t in ("bigint", "int")]
    if ends is not None:
        stream = stream.withColumn(END, F.lit(False)).unionByName(ends.select(*keys).withColumn(END, F.lit(True)), allowMissingColumns=True)
    mode = "processingTime" if ttl_ms else "None"
    return stream.groupBy(*keys).transformWithStateInPandas(KeyedFold(step, order, names, whole, ttl_ms), outputStructType=schema, outputMode="Append", timeMode=mode)


def end_rows(finished: DataFrame, known: DataFrame) -> DataFrame:
    """Markers of finished runs (a stream of run_id) as one row for every key of the run: ``known`` holds the keys, run_id among them."""
    return finished.join(known.distinct(), "run_id").select(*known.columns)


def finished_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Runs as their marker documents appear; a torn document is no marker."""
    from takt.contracts import TABLES
    from takt.sources.runs import run_of_path
    raw = spark.readStream.option("wholetext", True).text(glob)
    return raw.select(run_of_path().alias("run_id"), F.from_json("value", TABLES["run_metadata"]).alias("doc")).filter(
        F.col("doc.schema_version").isNotNull()).select("run_id")


def bus_stream(spark: SparkSession, folder: str, max_files: int = 128) -> DataFrame:
    """Bus records as they arrive; files appear whole, so a torn last line cannot be read."""
    return spark.readStream.schema(TABLES["runtime_bus"]).option("header", True).option("maxFilesPerTrigger", max_files).csv(folder)


def prediction_stream(spark: SparkSession, folder: str, kind: str, max_files: int = 128) -> DataFrame:
    return spark.readStream.schema(PREDICTIONS[kind]).option("maxFilesPerTrigger", max_files).json(folder)


def with_event_time(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", delay)


def ordered_input(stream: DataFrame, keys: Sequence[str], columns: str, ends: DataFrame | None = None) -> DataFrame:
    """Rows with a ``late`` mark: keep ``NOT late``, send the others to quarantine."""
    return fold_stream(stream, keys, folds.quarantine, ["__arrival"] if "__arrival" in stream.columns else ["event_sequence"], columns + ", late boolean", ends=ends)


def flow_windows_stream(events: DataFrame) -> DataFrame:
    """Window statistics per station event; state = the last 20 minutes of one station."""
    cols = events.select("run_id", "station_id", "timestamp_ms", "event_sequence", "queue_length_after", "cycle_time_ms", "event_type")
    return fold_stream(cols, ["run_id", "station_id"], folds.flow_step, ["timestamp_ms", "event_sequence"], folds.FLOW_SCHEMA)


def bottleneck_features_stream(events: DataFrame, stations: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """The 28 flow features of every station event, live, and their labels later.

    A row of kind 'features' comes as soon as the watermark has passed its event, with status 'pending' (or 'already_full'); a row of
    kind 'label' with the same keys comes when the horizon has passed (seen) or the station has ended (not seen), and holds ``future_max``.
    """
    return flow_features.feature_rows(flow_rows_stream(events, delay, **settings), stations, ["kind", "seen", "future_max"])


def labelled_flow_features(rows: DataFrame) -> DataFrame:
    """Feature rows of the stream with the labels that have come by now; rows without one are censored."""
    keys = ["run_id", "station_id", "prediction_event_sequence"]
    label = rows.filter("kind = 'label'").select(*keys, F.col("seen").alias("__seen"), F.col("future_max").alias("__max"))
    j = rows.filter("kind = 'features'").join(label, keys, "left")
    open_, seen = ~F.col("currently_at_capacity"), F.coalesce("__seen", F.lit(False))
    return j.withColumn("target_eligibility_status", F.when(~open_, "already_full").when(seen, "eligible").otherwise("censored")).withColumn(
        "y_bottleneck", F.when(open_ & seen, F.coalesce(F.col("__max") >= F.col("capacity"), F.lit(False)).cast("int"))).select(
        *FLOW_META, *FLOW_FEATURES, "y_bottleneck")


def defect_features_stream(elements: DataFrame, units: DataFrame, stations: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """The 30 unit features of every arrival up to the final station, from what ``station_readings_stream`` wrote."""
    final = unit_quality.final_station(stations).select("run_id", "final_station_index")
    rows = unit_history_stream(elements, delay, **settings).join(final, "run_id").filter("prediction_station_index <= final_station_index")
    rows = rows.withColumn("label_completeness_status", F.lit(None).cast("string")).withColumn("y_defect", F.lit(None).cast("int"))
    return unit_quality.feature_rows(rows, units, stations).drop("label_completeness_status", "y_defect")


def dark_transitions_stream(arrivals: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    return fold_stream(arrivals, ["run_id", "unit_id"], folds.monotone_step, ["timestamp_ms", "station_index", "seq"],
                       "run_id string, unit_id string, seq long, verdict string", ends=ends)


def alert_policy_stream(scored: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    return fold_stream(scored, ["run_id", "unit_id"], folds.policy_step, ["seq"],
                       "run_id string, unit_id string, seq long, raw double, ema_03 double, ema_05 double, ema_07 double, two_consecutive double, two_of_three double", ends=ends)


def warning_sessions(preds: DataFrame, key: str, ends: DataFrame | None = None) -> DataFrame:
    return fold_stream(preds.withColumn("series_key", F.col(key)), ["run_id", "series_key"], folds.session_step, ["emission"],
                       "run_id string, series_key string, start_ms long, end_ms long, point_count long, open_ended boolean", ends=ends)


def latest_state(stream: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Latest record per key, for update mode."""
    return stream.groupBy("run_id", key).agg(F.max_by(F.struct(*fields), "emission").alias("r")).select("run_id", key, "r.*")


def rate_windows(stream: DataFrame, size: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """Arrivals and services per station and sliding window, for boards."""
    return stream.groupBy("run_id", "station_id", F.window("event_time", size, slide)).agg(
        F.count_if(F.col("event_type") == "UNIT_ARRIVED").alias("arrivals"), F.count_if(F.col("event_type") == "PROCESSING_COMPLETED").alias("services")).select(
        "run_id", "station_id", F.unix_millis("window.start").alias("window_start_ms"), "arrivals", "services")


def unit_enrichment(stream: DataFrame, read_units: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """foreachBatch body joining each batch to the units known at that time."""
    def batch(df: DataFrame, batch_id: int) -> None:
        sink(df.join(read_units(), ["run_id", "unit_id"], "left"), batch_id)
    return batch


def completed_runs(spark: SparkSession, root: str, glob: str = "run_*/run_metadata.json") -> DataFrame:
    """Runs whose marker document names a schema: their streams may be drained and closed."""
    from takt.sources.runs import read_run_documents
    return read_run_documents(spark, f"{root}/{glob}").filter(F.col("doc.schema_version").isNotNull()).select("run_id")


def idempotent_sink(path: str, keys: Sequence[str], order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each batch owns one folder, so a replayed batch overwrites itself.

    Of rows with equal keys the one with the largest ``order`` stays; duplicates over batches: see ``read_idempotent``.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        last_of_key(df, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def last_of_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: the one with the largest order, of equal ones the largest in its columns' order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("__last")).select(
        *[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in df.columns])


def read_idempotent(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """What the writer's batches hold together, one row a key."""
    return last_of_key(spark.read.parquet(path).drop("batch"), keys, order)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Drain what is there (AvailableNow) into files; returns the query for its status."""
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    q = w.format(fmt).option("path", path).start()
    q.awaitTermination()
    return q
