"""Changes to the result tables, each as ``tables -> next table``: upsert, append, update, delete."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.functions.logs import severity
from logtide.plans.bounded import BROADCAST_ROWS, join_small, settle
from logtide.plans.materialize import materialize
from logtide.plans.ordering import RowOrder, with_position
from logtide.schemas import ALERTS, ANOMALIES, FEATURE_STATISTICS, LOGS_METADATA, MODEL_PERFORMANCE
from logtide.sources import tables


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
    """Ad-hoc SQL over result tables; values go in as named parameters, ``:name`` in the text.

    Tables stand behind FROM or JOIN, or anywhere as ``{name}``.
    """
    for name in tables:  # the frames are arguments of the query, so no view of the session is replaced
        query = re.sub(rf"\b(FROM|JOIN)(\s+){re.escape(name)}\b", rf"\1\2{{{name}}}", query, flags=re.IGNORECASE)
    return spark.sql(query, args=params or {}, **tables)


def assign_ids(rows: DataFrame, stored: DataFrame, time: str, tie: str) -> DataFrame:
    """Add ``id``: consecutive numbers after the highest stored one, in the order of (time, tie).

    The numbers come from per-second row counts, so no task ever holds the whole batch. The rows are
    stored first: counting and numbering must see the same times, also where they come from a clock.
    """
    return number_rows(materialize(rows), stored, time, tie)


def number_rows(rows: DataFrame, stored: DataFrame, time: str, tie: str) -> DataFrame:
    """``assign_ids`` for rows that are stored already. A batch of at most ``BROADCAST_ROWS`` is numbered in one
    task; the numbers are the same either way."""
    last = F.coalesce(stored.agg(F.max("id").alias("last")).scalar(), F.lit(0))
    if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        place = F.row_number().over(Window.orderBy(time, tie))
        return rows.withColumn("id", (place + last).cast("long"))
    return (
        with_position(rows, RowOrder(None, time, tie))
        .withColumn("id", (F.col("_pos") + 1 + last).cast("long"))
        .drop("_key", "_sec", "_pos")
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in table order and type; columns the rows lack are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def newest_per_key(batch: DataFrame, key: str, newest_by: list[str]) -> DataFrame:
    """One row per key, the greatest by ``newest_by``. Copies combine map-side, however many there are."""
    rest = [c for c in batch.columns if c != key]
    # all columns end the order, so that rows alike in newest_by do not leave the others to chance
    ordered = [c for c, t in batch.dtypes if c in rest and not t.startswith(("map", "variant"))]
    best = F.max_by(F.struct(*rest), F.struct(*newest_by, F.struct(*ordered))).alias("_row")
    return batch.groupBy(key).agg(best).select(key, "_row.*").select(*batch.columns)


def upsert_anomalies(stored: DataFrame, batch: DataFrame, now: Column | None = None,
                     newest_by: list[str] | None = None) -> DataFrame:
    """Anomaly table after a batch keyed by ``log_id``.

    New keys are inserted, with level INFO, version v1.0, ``detected_at`` and ``is_confirmed`` by
    default. Known keys change only in score, model name and model version. ``newest_by`` decides
    between copies inside the batch, and after it all its columns.
    """
    batch = _known(_settled(batch, now, newest_by), stored)
    return _changed(stored, batch).unionByName(_inserted(stored, batch))


def _settled(batch: DataFrame, now: Column | None, newest_by: list[str] | None) -> DataFrame:
    """Batch with defaults, one row per key."""
    batch = batch.withColumns({
        "log_level": F.coalesce("log_level", F.lit("INFO")),
        "model_version": F.coalesce("model_version", F.lit("v1.0")),
    })
    if "detected_at" not in batch.columns:
        moment = now if now is not None else F.current_timestamp()
        batch = batch.withColumn("detected_at", moment.cast("timestamp_ntz"))
    return newest_per_key(batch, "log_id", newest_by or ["timestamp", "anomaly_score"])


def _known(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch with ``_since``, the detection time of its keys in the table, and ``_known``; stored once, with what
    the table knows of each key, since updates, insertions and their numbers all read it."""
    known = stored.select("log_id", F.col("detected_at").alias("_since"), F.lit(True).alias("_known"))
    return materialize(batch.join(known, "log_id", "left"))


def _changed(stored: DataFrame, batch: DataFrame) -> DataFrame:
    changed = ["anomaly_score", "model_name", "model_version"]
    update = batch.filter("_known").select("log_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed])
    return conform(stored.join(update, "log_id", "left").withColumns({
        c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in changed
    }), ANOMALIES)


def _inserted(stored: DataFrame, batch: DataFrame) -> DataFrame:
    fresh = number_rows(batch.filter("_known is null"), stored, "timestamp", "log_id")
    return conform(fresh.withColumn("is_confirmed", F.lit(False)), ANOMALIES)


#: Ids of stored anomalies and alerts are the day's number times this, and a place in the day.
IDS_PER_DAY = 10 ** 10


def with_day_ids(rows: DataFrame, spark: SparkSession, root: str, name: str, schema: T.StructType, day: str, tie: str,
             small: bool) -> DataFrame:
    """``rows`` with ids: unique, growing by day, and in a day behind all ids of its folder, by (``day``, ``tie``).

    Only the ids of the days at hand are read. A small batch is numbered in one task, as by ``number_rows``.
    """
    rows = rows.withColumn("_day", tables.day_of(day))
    own = [r["_day"] for r in rows.select("_day").distinct().collect()]  # at most one for each day of the table
    last = []
    for d in own:
        stored = tables.read_table(spark, root, name, schema, [d])
        first = 0 if d == tables.NO_DAY else (dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days * IDS_PER_DAY
        last.append((d, max(first, stored.agg(F.max("id")).first()[0] or 0)))
    base = spark.createDataFrame(last, "_day string, _base long")
    if small:
        place = F.row_number().over(Window.partitionBy("_day").orderBy(day, tie))
        placed = rows.withColumn("_place", place)
    else:
        placed = with_position(materialize(rows), RowOrder("_day", day, tie)).withColumn("_place", F.col("_pos") + 1)
        placed = placed.drop("_key", "_sec", "_pos")
    return placed.join(F.broadcast(base), "_day").withColumn("id", F.col("_base") + F.col("_place")).drop(
        "_day", "_base", "_place")


def merge_anomalies(spark: SparkSession, root: str, batch: DataFrame, now: Column | None = None,
                    own_days: bool = False) -> DataFrame:
    """``upsert_anomalies`` into the stored table; gives the stored rows of the batch.

    New keys are appended to their detection days. Known ones are looked up (``tables.look_up``), and days are written
    anew only where a known key's score or model has changed, so a batch repeated after a failure changes nothing.
    With ``own_days`` keys are looked up in the batch's detection days only, which is right where the detection time
    is a function of the row; then the cost of a batch does not depend on how much is stored.
    """
    batch = settle(_settled(batch, now, None))
    small = not hasattr(batch, "_stored_at")
    days = [r["d"] for r in batch.select(tables.day_of("detected_at").alias("d")).distinct().collect()]
    stored = tables.read_table(spark, root, "anomalies", ANOMALIES, days if own_days else None)
    changed = ["anomaly_score", "model_name", "model_version"]
    known = tables.look_up(stored, batch, "log_id", ["log_id", "id", "detected_at", *changed], settle)
    was = known.select("log_id", F.col("id").alias("_id"), F.col("detected_at").alias("_since"),
                       *[F.col(c).alias(f"_{c}") for c in changed])
    both = settle(join_small(batch, was, "log_id"))
    fresh = both.filter("_id is null").drop("_id", "_since", *[f"_{c}" for c in changed])
    fresh = conform(settle(with_day_ids(fresh, spark, root, "anomalies", ANOMALIES, "detected_at", "log_id", small).withColumn(
        "is_confirmed", F.lit(False))), ANOMALIES)
    if not fresh.isEmpty():
        tables.append_table(fresh, root, "anomalies", ANOMALIES, "detected_at")
    other = F.lit(False)
    for c in changed:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    update = both.filter(F.col("_id").isNotNull() & other)
    touched = [r["d"] for r in update.select(tables.day_of("_since").alias("d")).distinct().collect()]
    if touched:
        part = tables.read_table(spark, root, "anomalies", ANOMALIES, touched)
        rows = materialize(_changed(part, update.select(*batch.columns).withColumn("_known", F.lit(True))))
        tables.replace_days(rows, root, "anomalies", ANOMALIES, "detected_at")
    again = both.filter("_id is not null").withColumns({"id": F.col("_id"), "detected_at": F.col("_since")})
    return conform(again, ANOMALIES).unionByName(fresh)


def open_alerts(spark: SparkSession, root: str, anomalies: DataFrame, min_score: float = 0.8) -> None:
    """Append an alert for each of the given stored anomalies of high score that has none.

    Alerts carry the detection time of their anomaly, so they are looked up in its days only.
    """
    rows = settle(alert_rows(anomalies, min_score))
    days = [r["d"] for r in rows.select(tables.day_of("created_at").alias("d")).distinct().collect()]
    if not days:
        return
    stored = tables.read_table(spark, root, "alerts", ALERTS, days)
    known = tables.look_up(stored, rows, "anomaly_id", ["anomaly_id"], settle)
    fresh = settle(rows.join(known, "anomaly_id", "left_anti"))
    if not fresh.isEmpty():
        small = not hasattr(fresh, "_stored_at")
        numbered = with_day_ids(fresh, spark, root, "alerts", ALERTS, "created_at", "anomaly_id", small)
        tables.append_table(conform(numbered, ALERTS), root, "alerts", ALERTS, "created_at")


def new_rows(stored: DataFrame, rows: DataFrame, schema: T.StructType, time: str, tie: str) -> DataFrame:
    """``rows`` under new ids, as ``append_rows`` adds them."""
    return conform(assign_ids(rows, stored, time, tie), schema)


def append_rows(stored: DataFrame, rows: DataFrame, schema: T.StructType, time: str, tie: str) -> DataFrame:
    """Stored table plus ``rows`` under new ids."""
    return conform(stored, schema).unionByName(new_rows(stored, rows, schema, time, tie))


def record_metrics(stored: DataFrame, metrics: DataFrame, model_name: str, model_version: str,
                   evaluation_date: Column | None = None) -> DataFrame:
    """Model-performance table plus one row per metric (``metric_name``, ``metric_value``, ``dataset_size``)."""
    rows = performance_rows(metrics, model_name, model_version, evaluation_date)
    return append_rows(stored, rows, MODEL_PERFORMANCE, "created_at", "metric_name")


def performance_rows(metrics: DataFrame, model_name: str, model_version: str, evaluation_date: Column | None = None) -> DataFrame:
    """Rows of the model-performance table, still without id."""
    date = evaluation_date if evaluation_date is not None else F.current_date()
    return metrics.withColumns({
        "model_name": F.lit(model_name), "model_version": F.lit(model_version), "evaluation_date": date,
    }).withColumn("created_at", F.col("evaluation_date").cast("timestamp_ntz"))


def record_feature_statistics(stored: DataFrame, statistics: DataFrame, date: Column | None = None) -> DataFrame:
    """Feature-statistics table plus the given (feature_name, stat_type, stat_value, sample_size) rows."""
    day = date if date is not None else F.current_date()
    rows = statistics.withColumn("calculation_date", day).withColumns({
        "created_at": F.col("calculation_date").cast("timestamp_ntz"),
        "_tie": F.concat_ws("/", "feature_name", "stat_type"),
    })
    return append_rows(stored, rows, FEATURE_STATISTICS, "created_at", "_tie")


def create_alerts(stored: DataFrame, anomalies: DataFrame, min_score: float = 0.8,
                  alert_type: str = "anomaly_score") -> DataFrame:
    """Alert table plus one open alert per anomaly above ``min_score``."""
    return append_rows(stored, alert_rows(anomalies, min_score, alert_type), ALERTS, "created_at", "anomaly_id")


def alert_rows(anomalies: DataFrame, min_score: float = 0.8, alert_type: str = "anomaly_score") -> DataFrame:
    """An open alert, still without id, per anomaly above ``min_score``."""
    return anomalies.filter(F.col("anomaly_score") > min_score).select(
        F.col("id").alias("anomaly_id"), severity(F.col("anomaly_score")).alias("severity"),
        F.lit(alert_type).alias("alert_type"), F.col("message").alias("description"), F.lit("open").alias("status"),
        F.col("detected_at").alias("created_at"),
    )


def orphan_alerts(alerts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Alerts that refer to no anomaly."""
    return alerts.filter(F.col("anomaly_id").isNotNull()).join(
        anomalies.select(F.col("id").alias("anomaly_id")), "anomaly_id", "left_anti").select(*alerts.columns)


def update_rows(table: DataFrame, condition: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Next table with ``values`` set where ``condition`` holds, and the row count as a 1-row table."""
    hit = F.coalesce(condition, F.lit(False))
    types = {f.name: f.dataType for f in table.schema.fields}
    changed = table.select(*[
        F.when(hit, values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in table.columns
    ])
    return changed, table.agg(F.count_if(hit).alias("row_count"))


def delete_rows(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Next table without the rows for which ``condition`` is true, and their count."""
    hit = F.coalesce(condition, F.lit(False))
    return table.filter(~hit), table.agg(F.count_if(hit).alias("row_count"))


def retain(table: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; rows without a date stay."""
    old = F.col(column) < as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return delete_rows(table, old)[0]


# The states an alert passes through, in order.
ALERT_STATES = ["open", "acknowledged", "resolved"]


def move_alerts(alerts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply status changes (``id``, ``new_status``, ``changed_at``): next table, and refused changes.

    An alert only moves forward; a change to its present or an earlier state, or to an unknown one, is
    refused. Several changes of one alert in a batch count as the last of them.
    """
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(ALERT_STATES) for x in (s, i)])
    changes = newest_per_key(changes, "id", ["changed_at", "new_status"])
    joined = alerts.join(changes, "id", "left")
    legal = F.coalesce(rank[F.col("new_status")] > rank[F.col("status")], F.lit(False))
    marked = joined.withColumn("_legal", legal)
    status = F.when(F.col("_legal"), F.col("new_status")).otherwise(F.col("status"))
    moved = marked.withColumns({
        "status": status,
        **{
            f"{state}_at": F.when(F.col("_legal") & (F.col("new_status") == state),
                                  F.col("changed_at")).otherwise(F.col(f"{state}_at"))
            for state in ALERT_STATES[1:]
        },
    })
    known = alerts.select("id", "status")
    refused = changes.join(known, "id", "left").filter(~F.coalesce(
        rank[F.col("new_status")] > rank[F.col("status")], F.lit(False)))
    return conform(moved, ALERTS), refused


# What a reviewer can say about an anomaly.
FEEDBACK = ["true_positive", "false_positive", "unknown"]


def apply_feedback(anomalies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Anomaly table with reviews (``log_id``, ``feedback``, ``notes``); an unknown verdict is ignored."""
    valid = feedback.filter(F.col("feedback").isin(FEEDBACK)).select(
        "log_id", F.col("feedback").alias("_feedback"), F.col("notes").alias("_notes"))
    valid = newest_per_key(valid, "log_id", ["_feedback", "_notes"])
    reviewed = F.col("_feedback").isNotNull()
    return conform(anomalies.join(valid, "log_id", "left").withColumns({
        "is_confirmed": F.when(reviewed, F.col("_feedback") == "true_positive").otherwise(F.col("is_confirmed")),
        "feedback": F.coalesce("_feedback", "feedback"),
        "notes": F.coalesce("_notes", "notes"),
    }), ANOMALIES)


def feedback_precision(anomalies: DataFrame) -> DataFrame:
    """Share of confirmed anomalies among those with a clear verdict, per model."""
    yes = F.count_if(F.col("feedback") == "true_positive")
    no = F.count_if(F.col("feedback") == "false_positive")
    return anomalies.groupBy("model_name").agg(
        yes.alias("true_positives"), no.alias("false_positives"),
        F.coalesce(F.try_divide(yes, yes + no), F.lit(0.0)).alias("precision"),
    )


def recent_anomalies(anomalies: DataFrame, as_of: Column, hours: int = 24, min_score: float = 0.7,
                     limit: int = 100) -> DataFrame:
    """Highest scores detected within ``hours`` before ``as_of``."""
    since = as_of.cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return (
        anomalies.filter((F.col("detected_at") > since) & (F.col("anomaly_score") >= min_score))
        .orderBy(F.desc("anomaly_score"), "log_id").limit(limit)
        .select("id", "log_id", "timestamp", "log_type", "message", "anomaly_score", "model_name", "detected_at")
    )


def recent_critical_anomalies(anomalies: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Open alerts of high or critical severity with their anomalies, highest score first."""
    since = as_of.cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    open_alerts = alerts.filter(F.col("severity").isin("high", "critical") & (F.col("status") == "open"))
    return (
        anomalies.filter(F.col("detected_at") > since)
        .join(open_alerts.select(F.col("anomaly_id").alias("id"), "severity", "status"), "id")
        .orderBy(F.desc("anomaly_score"), "id")
        .select("id", "timestamp", "log_type", "message", "anomaly_score", "model_name", "severity", "status")
    )


def create_critical_view(spark: SparkSession, anomalies: DataFrame, alerts: DataFrame, as_of: Column | None = None) -> None:
    """Register the view ``recent_critical_anomalies``."""
    moment = as_of if as_of is not None else F.current_timestamp()
    recent_critical_anomalies(anomalies, alerts, moment).createOrReplaceTempView("recent_critical_anomalies")


def detected_on(anomalies: DataFrame, date: Column) -> DataFrame:
    return anomalies.filter(F.to_date("detected_at") == date)


def daily_report(anomalies: DataFrame, date: str) -> DataFrame:
    """Batch row of one day: number and time range of the anomalies detected on it."""
    return detected_on(anomalies, F.to_date(F.lit(date))).agg(
        F.lit(date).alias("batch_id"), F.count(F.lit(1)).alias("total_logs"),
        F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"),
    )


def append_daily_report(stored: DataFrame, anomalies: DataFrame, date: str) -> DataFrame:
    return append_rows(stored, report_rows(anomalies, date), LOGS_METADATA, "created_at", "batch_id")


def report_rows(anomalies: DataFrame, date: str) -> DataFrame:
    """The row of one day, still without id."""
    return daily_report(anomalies, date).withColumn("created_at", F.to_date("batch_id").cast("timestamp_ntz"))
