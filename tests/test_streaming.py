"""Streams over a file source, run to their end with availableNow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide import catalog, schemas
from logtide.models.forest import fit_forest, score_forest
from logtide.operators import summary
from logtide.operators.features import build_features, type_statistics
from logtide.operators.scoring import combine_scores, predicted_anomalies
from logtide.sources import tables
from logtide.streaming import features as stream
from logtide.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    """Write batches as files in order; read them as a stream of one file per micro-batch."""
    def make(*batches):
        path = str(tmp_path / "in")
        for n, df in enumerate(batches):
            part = df.coalesce(1)
            part.write.mode("append").parquet(path)
        return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option(
            "latestFirst", "false").parquet(path)

    return make


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def ending(logs):
    """A late row of a type of its own, whose time lets all others come out."""
    return logs.limit(1).withColumns({"timestamp": F.lit(dt.datetime(2024, 6, 1)), "log_type": F.lit("END"),
                                      "log_id": F.lit("end")}).select(*logs.columns)


def rows(spark, *items):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=m), "A", f"u{i}", s, int(s > 0.5)) for i, m, s in items],
        "log_id string, timestamp timestamp_ntz, log_type string, user_id string, combined_score double,"
        " is_anomaly_predicted int")


def test_summary_of_a_stream_equals_the_batch(spark, small, source, tmp_path):
    scored = catalog.scored_logs(spark, small)
    end = spark.createDataFrame([("end", dt.datetime(2024, 3, 1), "END")], "log_id string, timestamp timestamp_ntz, log_type string")
    stream = source(scored.unionByName(end, allowMissingColumns=True).repartition(1).sortWithinPartitions("timestamp"))
    got = run(jobs.hourly_summary(stream), tmp_path, "summary").filter("log_type <> 'END'")
    want = summary.hourly_summary(scored, approximate_users=True)
    digits = lambda df: sorted(df.withColumn("avg_anomaly_score", F.round("avg_anomaly_score", 9)).collect())
    assert digits(got) == digits(want)


def test_late_rows_are_dropped(spark, source, tmp_path):
    stream = source(rows(spark, ("a", 10, 0.6)), rows(spark, ("b", 400, 0.1)), rows(spark, ("b2", 401, 0.1)), rows(spark, ("late", 20, 0.9), ("c", 420, 0.2)),
                    rows(spark, ("d", 2000, 0.1)))
    got = {r["window_start"]: r["log_count"] for r in run(jobs.hourly_summary(stream), tmp_path, "late").collect()}
    assert got[T0] == 1
    assert got[T0 + dt.timedelta(hours=6)] == 2


def test_deduplication(spark, source, tmp_path):
    stream = source(rows(spark, ("a", 1, 0.1), ("b", 2, 0.1)), rows(spark, ("a", 1, 0.1), ("c", 3, 0.1)))
    assert sorted(r["log_id"] for r in run(jobs.deduplicate(stream), tmp_path, "unique").collect()) == ["a", "b", "c"]


def test_sliding_volume(spark, source, tmp_path):
    stream = source(rows(spark, ("a", 1, 0.1), ("b", 7, 0.1)))
    got = {r["window_start"]: r["log_count"] for r in run(jobs.sliding_volume(stream), tmp_path, "volume", "complete").collect()}
    assert got[T0] == 2 and got[T0 + dt.timedelta(minutes=5)] == 1 and len(got) == 13


def test_stream_scoring_merges_batches(spark, small, source, tmp_path):
    table = build_features(catalog.logs(spark, small))
    table.write.parquet(str(tmp_path / "features"))
    table = spark.read.parquet(str(tmp_path / "features"))
    model = fit_forest(table, trees=10)
    stream = source(table.filter("hour < 12"), table.filter("hour >= 12"), table.filter("hour < 3"))
    query = jobs.score_stream(stream, model, str(tmp_path / "store"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = tables.read_table(spark, str(tmp_path / "store"), "anomalies", schemas.ANOMALIES)
    want = predicted_anomalies(combine_scores(score_forest(table, model, relative_to_training=True)))
    assert {r["log_id"] for r in got.collect()} == {r["log_id"] for r in want.collect()}
    assert got.count() == want.count() > 0


def test_raw_stream_finds_what_one_batch_over_all_rows_finds(spark, small, source, tmp_path):
    logs = catalog.logs(spark, small).drop("event_id", "value", "k")
    statistics = type_statistics(logs)
    table = build_features(logs)
    table.write.parquet(str(tmp_path / "features"))
    table = spark.read.parquet(str(tmp_path / "features"))
    model = fit_forest(table, trees=10)
    parts = [logs.filter("timestamp < '2024-01-10'"),
             logs.filter("timestamp >= '2024-01-10' and timestamp < '2024-01-20'"), logs.filter("timestamp >= '2024-01-20'"), ending(logs)]
    query = jobs.score_raw_stream(source(*parts), model, statistics, str(tmp_path / "store"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    got = tables.read_table(spark, str(tmp_path / "store"), "anomalies", schemas.ANOMALIES)
    want = predicted_anomalies(combine_scores(score_forest(table, model, relative_to_training=True)))
    assert {(r["log_id"], round(r["anomaly_score"], 9)) for r in got.collect()} == {
        (r["log_id"], round(r["combined_score"], 9)) for r in want.collect()}
    alerts = tables.read_table(spark, str(tmp_path / "store"), "alerts", schemas.ALERTS)
    assert alerts.count() == got.filter("anomaly_score > 0.8").count()


@pytest.mark.parametrize("cuts", [1, 7])
def test_features_of_a_stream_equal_the_table_however_it_is_cut(spark, small, source, tmp_path, cuts):
    """Rows of a second in several batches, in any order within the lateness, and quiet types included."""
    logs = catalog.logs(spark, small).drop("event_id", "value", "k")
    logs.write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    statistics = type_statistics(logs)
    near = (F.unix_timestamp("timestamp") + F.pmod(F.xxhash64("log_id"), F.lit(7200))).alias("arrival")
    ordered = [r["arrival"] for r in logs.select(near).orderBy("arrival").collect()]
    edges = [ordered[len(ordered) * k // cuts] for k in range(cuts)] + [ordered[-1] + 1]
    parts = [logs.filter((near >= a) & (near < b)) for a, b in zip(edges, edges[1:])] + [ending(logs)]
    got = run(stream.stream_features(source(*parts), statistics, "3 hours"), tmp_path, f"features_{cuts}")
    want = build_features(logs, statistics=statistics)
    assert got.columns == want.columns and got.dtypes == want.dtypes

    def plain(df):
        doubles = {c: F.round(c, 6) + 0.0 for c, t in df.dtypes if t == "double"}
        return sorted(map(tuple, df.filter("log_id <> 'end'").withColumns(doubles).collect()), key=str)

    assert plain(got) == plain(want)


def test_state_is_bounded_by_the_hour():
    import numpy as np
    import pandas as pd

    held = stream.TypeState()
    for k in range(40):
        seconds = np.arange(k * 600, (k + 1) * 600)
        held.add(pd.DataFrame({"_sec": seconds, "timestamp": seconds, "log_id": [f"i{s}" for s in seconds],
                               "_value": np.where(seconds % 3 == 0, 1.0 * seconds, np.nan),
                               "response_time_ms": 1.0 * seconds}))
        out = held.take((k + 1) * 600)
        assert len(out) == 600 and held.waiting is None and len(held.seconds) <= 3601
    assert out["count_5min"].tolist() == [301] * 600 and out["count_1hour"].tolist() == [3601] * 600
    assert out["max_response_time_5min"].iloc[-1] == 23997.0 and out["response_time_lag_3"].iloc[0] == 39 * 600 - 3


def test_cost_of_a_batch_does_not_grow_with_what_is_stored(spark, small, tmp_path):
    """A batch lists, reads and writes its own days only."""
    from logtide.operators import results

    read = []
    whole = tables.read_table

    def watched(spark, root, name, schema, only=None):
        read.append((name, only))
        return whole(spark, root, name, schema, only)

    table = build_features(catalog.logs(spark, small))
    table.write.parquet(str(tmp_path / "features"))
    table = spark.read.parquet(str(tmp_path / "features"))
    model = fit_forest(table, trees=5)
    days = [table.filter(F.to_date("timestamp") == f"2024-01-{d:02d}") for d in range(2, 8)]
    results.tables.read_table = watched
    try:
        for part in days:
            jobs._store_findings(part, model, str(tmp_path / "store"), 0.3, True)
    finally:
        results.tables.read_table = whole
    assert read and all(only is not None and len(only) <= 1 for _, only in read)


def test_sessions_of_a_stream_equal_the_batch(spark, small, source, tmp_path):
    """Sessions that merge over batches, and a pause of exactly the gap."""
    from logtide.operators import detectors

    logs = catalog.logs(spark, small).drop("event_id", "value", "k")
    even = logs.limit(1).withColumns({"user_id": F.lit("even"), "timestamp": F.lit(T0)})
    logs = logs.unionByName(even).unionByName(even.withColumn("timestamp", F.lit(T0 + dt.timedelta(minutes=30))))
    logs.write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    half = F.lit(dt.datetime(2024, 1, 15, 12, 20))
    stream_ = source(logs.filter(F.col("timestamp") < half), logs.filter(F.col("timestamp") >= half),
                     ending(logs).withColumn("user_id", F.lit("end")))
    got = run(jobs.user_sessions(stream_), tmp_path, "sessions").filter("user_id <> 'end'")
    want = detectors.sessions(logs)
    columns = ["user_id", "session_start", "session_end", "log_count", "anomaly_count"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert got.filter("user_id = 'even'").count() == 1
