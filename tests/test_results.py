"""Result tables: snapshots, upsert, lifecycle, feedback, composite jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide import catalog, schemas
from logtide.models import forest, sequence
from logtide.operators import jobs, results
from logtide.sources import tables
from logtide.sources.logs import read_logs

NOW = dt.datetime(2024, 2, 1)
BATCH = ("log_id string, timestamp timestamp_ntz, log_level string, log_type string, message string,"
         " anomaly_score double, model_name string, model_version string, features string")


def batch(spark, *items, version="v1.0"):
    rows = [(i, NOW - dt.timedelta(days=d), None, "ERROR", f"m{i}", s, "ensemble", version, "{}") for i, d, s in items]
    return spark.createDataFrame(rows, BATCH)


def now():
    return F.lit(NOW)


def empty(spark, schema=schemas.ANOMALIES):
    return spark.createDataFrame([], schema)


def test_upsert_inserts_then_changes_three_columns(spark):
    first = results.upsert_anomalies(empty(spark), batch(spark, ("b", 1, 0.6), ("a", 2, 0.7)), now())
    again = results.upsert_anomalies(
        first, batch(spark, ("b", 0, 0.9), ("c", 3, 0.8), version="v2").withColumn("message", F.lit("new")),
        now() + F.expr("INTERVAL 1 DAY"))
    rows = {r["log_id"]: r for r in again.collect()}
    assert {k: r["id"] for k, r in rows.items()} == {"a": 1, "b": 2, "c": 3}
    b = rows["b"]
    assert (b["anomaly_score"], b["model_version"], b["message"], b["detected_at"]) == (0.9, "v2", "mb", NOW)
    assert rows["a"]["log_level"] == "INFO" and rows["a"]["is_confirmed"] is False
    assert rows["c"]["detected_at"] == NOW + dt.timedelta(days=1)
    assert again.schema.names == schemas.ANOMALIES.names


def test_upsert_twice_is_upsert_once(spark):
    items = batch(spark, ("a", 1, 0.6), ("a", 1, 0.9), ("b", 1, 0.7))
    once = results.upsert_anomalies(empty(spark), items, now())
    twice = results.upsert_anomalies(once, items, now())
    assert once.count() == 2
    assert sorted(once.collect()) == sorted(twice.collect())


def test_many_copies_of_one_key_and_one_detection_time(spark):
    items = batch(spark, *[("hot" if i % 3 == 0 else f"k{i}", 1, i / 1000) for i in range(300)])
    got = results.upsert_anomalies(empty(spark), items, now())
    assert got.count() == 201
    assert got.filter("log_id = 'hot'").first()["anomaly_score"] == pytest.approx(0.297)
    assert sorted(r["id"] for r in got.select("id").collect()) == list(range(1, 202))


def test_ids_are_the_same_for_a_batch_beyond_one_task(spark, monkeypatch):
    items = batch(spark, *[(f"k{i:03d}", i % 4, i / 1000) for i in range(200)])
    small = results.assign_ids(items, empty(spark), "timestamp", "log_id").select("log_id", "id")
    monkeypatch.setattr(results, "BROADCAST_ROWS", 10)
    large = results.assign_ids(items, empty(spark), "timestamp", "log_id").select("log_id", "id")
    assert sorted(small.collect()) == sorted(large.collect())


def found(spark, *items):
    return batch(spark, *items).withColumn("detected_at", F.col("timestamp"))


def stored_rows(spark, root, name="anomalies", schema=schemas.ANOMALIES):
    return sorted(map(tuple, tables.read_table(spark, root, name, schema).collect()), key=str)


def files(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


@pytest.mark.parametrize("own_days", [True, False])
def test_merge_appends_new_keys_and_writes_changed_days_only(spark, tmp_path, own_days):
    root = str(tmp_path)
    results.merge_anomalies(spark, root, found(spark, ("a", 1, 0.6), ("b", 2, 0.7), ("c", 3, 0.8)), own_days=own_days)
    before = files(tmp_path)
    got = results.merge_anomalies(spark, root, found(spark, ("b", 2, 0.9), ("d", 4, 0.5), ("e", 3, 0.4)), own_days=own_days)
    after = files(tmp_path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {f.split("/")[1] for f in kept} == {"day=2024-01-31", "day=2024-01-29"} and len(after) == 5
    table = tables.read_table(spark, root, "anomalies", schemas.ANOMALIES)
    assert {r["log_id"]: r["anomaly_score"] for r in table.collect()} == {"a": 0.6, "b": 0.9, "c": 0.8, "d": 0.5, "e": 0.4}
    assert table.select("id").distinct().count() == 5
    assert {r["log_id"]: r["id"] for r in got.collect()} == {
        r["log_id"]: r["id"] for r in table.collect() if r["log_id"] in "bde"}
    assert {r["id"] - r["id"] % results.IDS_PER_DAY for r in table.filter("log_id in ('c', 'e')").collect()} == {
        (dt.date(2024, 1, 29) - dt.date(1970, 1, 1)).days * results.IDS_PER_DAY}
    # the pure form gives the same rows but for the ids
    pure = results.upsert_anomalies(results.upsert_anomalies(empty(spark), found(
        spark, ("a", 1, 0.6), ("b", 2, 0.7), ("c", 3, 0.8))), found(spark, ("b", 2, 0.9), ("d", 4, 0.5), ("e", 3, 0.4)))
    assert sorted(map(tuple, pure.drop("id").collect()), key=str) == sorted(map(tuple, table.drop("id").collect()), key=str)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root, items = str(tmp_path), found(spark, ("a", 1, 0.95), ("b", 2, 0.7), ("c", 1, 0.85))
    for _ in range(2):
        results.open_alerts(spark, root, results.merge_anomalies(spark, root, items))
        once = files(tmp_path)
    results.open_alerts(spark, root, results.merge_anomalies(spark, root, items, own_days=True))
    assert files(tmp_path) == once
    assert len(stored_rows(spark, root)) == 3 and len(stored_rows(spark, root, "alerts", schemas.ALERTS)) == 2


def test_a_large_batch_goes_through_stored_tables(spark, tmp_path, monkeypatch):
    from logtide.plans import bounded
    items = [(f"k{i:03d}", i % 3, 0.5 + i / 1000) for i in range(300)]
    results.merge_anomalies(spark, str(tmp_path / "a"), found(spark, *items))
    monkeypatch.setattr(tables, "PUSHED_KEYS", 5)
    monkeypatch.setattr(bounded.fetch_bounded, "__defaults__", (10, 640))
    results.merge_anomalies(spark, str(tmp_path / "b"), found(spark, *items))
    results.merge_anomalies(spark, str(tmp_path / "b"), found(spark, *items))
    assert stored_rows(spark, str(tmp_path / "a")) == stored_rows(spark, str(tmp_path / "b"))


def test_a_look_up_leaves_row_groups_unread(spark, tmp_path):
    """Few keys against many: the scan gives out a part of the rows only, whatever the order of the keys."""
    rows = spark.range(200_000).select(
        F.md5(F.col("id").cast("string")).alias("log_id"), F.lit(NOW).alias("detected_at"), F.col("id"))
    table = results.conform(rows, schemas.ANOMALIES)
    spark.conf.set("parquet.block.size", str(256 * 1024))
    tables.append_table(table.coalesce(2), str(tmp_path), "anomalies", schemas.ANOMALIES, "detected_at")
    stored = tables.read_table(spark, str(tmp_path), "anomalies", schemas.ANOMALIES)
    keys = rows.filter("id in (5, 77777, 199999)")

    def scanned(df):
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return got, plan.metrics().apply("numOutputRows").value()

    got, read = tables.look_up(stored, keys, "log_id", ["log_id", "id"], scanned)
    spark.conf.unset("parquet.block.size")
    assert sorted(r["id"] for r in got) == [5, 77777, 199999] and 0 < read < 100_000
    assert spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "10"


def test_retention_drops_folders_and_writes_the_border_day_only(spark, tmp_path):
    root = str(tmp_path)
    results.merge_anomalies(spark, root, found(spark, ("a", 1, 0.6), ("b", 90, 0.7), ("c", 91, 0.8), ("d", 200, 0.8)))
    before = files(tmp_path)
    jobs.retention_job(spark, root, now())
    assert files(tmp_path) == {f: t for f, t in before.items() if f.split("/")[1] in ("day=2024-01-31", "day=2023-11-03")}
    jobs.retention_job(spark, root, now() + F.expr("INTERVAL 6 HOURS"))
    assert [r[1] for r in stored_rows(spark, root)] == ["a"]
    border = found(spark, ("x", 90, 0.6)).unionByName(found(spark, ("y", 90, 0.6)).withColumn(
        "detected_at", F.col("detected_at") + F.expr("INTERVAL 9 HOURS")))
    results.merge_anomalies(spark, root, border)
    jobs.retention_job(spark, root, now() + F.expr("INTERVAL 6 HOURS"))
    assert sorted(r[1] for r in stored_rows(spark, root)) == ["a", "y"]


def test_compaction_keeps_rows(spark, tmp_path):
    root = str(tmp_path)
    for k in range(4):
        results.merge_anomalies(spark, root, found(spark, (f"k{k}", 1, 0.6), (f"m{k}", 2, 0.6)))
    rows = stored_rows(spark, root)
    jobs.compaction_job(spark, root, "2024-01-31")
    assert stored_rows(spark, root) == rows
    assert len(list((tmp_path / "anomalies" / "day=2024-01-31").glob("*.parquet"))) < 4
    assert len(list((tmp_path / "anomalies" / "day=2024-01-30").glob("*.parquet"))) == 4


def test_update_delete_and_retention(spark):
    table = results.upsert_anomalies(
        empty(spark), batch(spark, ("a", 1, 0.6), ("b", 100, 0.7), ("c", 5, 0.8)).withColumn("detected_at", F.col("timestamp")))
    table = table.withColumn("detected_at", F.when(F.col("log_id") != "c", F.col("detected_at")))
    changed, count = results.update_rows(table, F.col("anomaly_score") > 0.65, {"notes": F.lit("x")})
    assert count.first()[0] == 2 and changed.filter("notes = 'x'").count() == 2
    left, count = results.delete_rows(table, F.col("log_id") == "a")
    assert count.first()[0] == 1 and left.count() == 2
    assert {r["log_id"] for r in results.retain(table, "detected_at", now(), 90).collect()} == {"a", "c"}


def test_alert_lifecycle(spark):
    table = results.upsert_anomalies(empty(spark), batch(spark, ("a", 1, 0.85), ("b", 2, 0.99), ("c", 3, 0.8)), now())
    alerts = results.create_alerts(empty(spark, schemas.ALERTS), table)
    assert sorted((r["severity"], r["status"]) for r in alerts.collect()) == [("critical", "open"), ("high", "open")]
    changes = spark.createDataFrame([(1, "acknowledged", NOW), (2, "resolved", NOW), (9, "resolved", NOW)],
                                    "id long, new_status string, changed_at timestamp_ntz")
    moved, refused = results.move_alerts(alerts, changes)
    assert {r["id"]: (r["status"], r["acknowledged_at"], r["resolved_at"]) for r in moved.collect()} == {
        1: ("acknowledged", NOW, None), 2: ("resolved", None, NOW)}
    assert [r["id"] for r in refused.collect()] == [9]
    back = spark.createDataFrame([(2, "open", NOW), (1, "lost", NOW)], changes.schema)
    same, refused = results.move_alerts(moved, back)
    assert sorted(same.collect()) == sorted(moved.collect()) and refused.count() == 2


def test_orphans_and_view(spark):
    table = results.upsert_anomalies(empty(spark), batch(spark, ("a", 1, 0.9), ("b", 2, 0.95)), now())
    alerts = results.create_alerts(empty(spark, schemas.ALERTS), table)
    assert results.orphan_alerts(alerts, table).isEmpty()
    assert results.orphan_alerts(alerts, table.filter("log_id = 'a'")).count() == 1
    results.create_critical_view(spark, table, alerts, now() + F.expr("INTERVAL 1 HOUR"))
    got = spark.sql("SELECT message FROM recent_critical_anomalies ORDER BY anomaly_score DESC").collect()
    assert [r[0] for r in got] == ["mb", "ma"]


def test_feedback(spark):
    table = results.upsert_anomalies(empty(spark), batch(spark, ("a", 1, 0.9), ("b", 2, 0.95), ("c", 2, 0.95)), now())
    said = spark.createDataFrame([("a", "true_positive", "yes"), ("b", "false_positive", None), ("c", "hm", None)],
                                 "log_id string, feedback string, notes string")
    got = results.apply_feedback(table, said)
    assert {r["log_id"]: (r["is_confirmed"], r["feedback"], r["notes"]) for r in got.collect()} == {
        "a": (True, "true_positive", "yes"), "b": (False, "false_positive", None), "c": (False, None, None)}
    assert results.feedback_precision(got).first()["precision"] == 0.5


def test_daily_report_is_appended(spark):
    table = results.upsert_anomalies(empty(spark), batch(spark, ("a", 1, 0.9), ("b", 3, 0.9)), now())
    one = results.append_daily_report(empty(spark, schemas.LOGS_METADATA), table, "2024-02-01")
    two = results.append_daily_report(one, table, "2024-02-02")
    assert [(r["id"], r["batch_id"], r["total_logs"]) for r in two.orderBy("id").collect()] == [
        (1, "2024-02-01", 2), (2, "2024-02-02", 0)]


def test_jobs_end_to_end(spark, small, tmp_path):
    root, raw = str(tmp_path / "store"), str(tmp_path / "raw")
    catalog.logs(spark, small).drop("event_id", "value", "k").write.parquet(raw)
    table = jobs.features_job(spark, raw, str(tmp_path / "features"))
    assert table.count() == 1000
    date = F.to_date(F.lit("2024-01-31"))
    model = jobs.train_forest_job(spark, str(tmp_path / "features"), str(tmp_path / "forest"), root, date, trees=20)
    loaded = forest.load_forest(spark, str(tmp_path / "forest"))
    assert loaded.nodes.equals(model.nodes) and loaded.scaler == model.scaler and loaded.offset == model.offset
    seq = jobs.train_sequences_job(spark, str(tmp_path / "features"), str(tmp_path / "sequences"), root, date,
                                   length=10, components=8)
    seq2 = sequence.load_sequences(spark, str(tmp_path / "sequences"))
    assert seq2.threshold == seq.threshold and (seq2.components == seq.components).all()
    metrics = tables.read_table(spark, root, "model_performance", schemas.MODEL_PERFORMANCE)
    assert metrics.count() == 6 and metrics.select("id").distinct().count() == 6

    out = str(tmp_path / "scores")
    done = jobs.scoring_job(spark, str(tmp_path / "features"), loaded, out, root, now()).first()
    anomalies = tables.read_table(spark, root, "anomalies", schemas.ANOMALIES)
    assert done["total"] == 1000 and 0 < done["anomalies"] == anomalies.count()
    again = jobs.scoring_job(spark, str(tmp_path / "features"), loaded, out, root, now()).first()
    assert again == done
    assert tables.read_table(spark, root, "anomalies", schemas.ANOMALIES).count() == anomalies.count()
    alerts = tables.read_table(spark, root, "alerts", schemas.ALERTS)
    assert alerts.count() == anomalies.filter("anomaly_score > 0.8").count()

    enriched = jobs.enrichment_job(spark, raw, str(tmp_path / "enriched"))
    assert enriched.rows.count() == 1000 and enriched.top is None
    assert enriched.bursts.agg(F.sum("count")).first()[0] == 1000 and (tmp_path / "enriched" / "log_type=ERROR").is_dir()
    assert read_logs(spark, str(tmp_path / "enriched")).filter("log_type = 'ERROR'").count() > 0
    jobs.retention_job(spark, root, now() + F.expr("INTERVAL 91 DAYS"))
    assert tables.read_table(spark, root, "anomalies", schemas.ANOMALIES).count() == 0


def test_daily_chain_from_raw_json_to_the_stored_report(spark, small, tmp_path):
    root, raw, models = str(tmp_path / "store"), str(tmp_path / "raw"), str(tmp_path / "models")
    payload = F.to_json(F.struct("status_code", "response_time_ms", "user_id"))
    rows = catalog.logs(spark, small).select(
        "log_id", F.col("timestamp").cast("string").alias("timestamp"), "log_level", "log_type", "message",
        payload.alias("extra_data"), "is_anomaly")
    rows.write.parquet(raw)
    flat = jobs.read_raw_logs(spark, raw)
    assert dict(flat.dtypes)["timestamp"] == "timestamp_ntz" and flat.filter("response_time_ms is not null").count() > 0
    jobs.features_job(spark, raw, str(tmp_path / "first"))
    for n, trees in ((1, 5), (2, 7)):
        jobs.train_forest_job(spark, str(tmp_path / "first"), f"{models}/forest_{n}", root,
                              F.to_date(F.lit("2024-01-30")), trees=trees)
    assert forest.load_forest(spark, jobs.newest_model(spark, f"{models}/forest_*")).nodes["tree"].nunique() == 7
    reports = jobs.daily_job(spark, raw, str(tmp_path / "work"), f"{models}/forest_*", root, "2024-01-31")
    anomalies = tables.read_table(spark, root, "anomalies", schemas.ANOMALIES)
    assert [(r["id"], r["batch_id"], r["total_logs"]) for r in reports.collect()] == [(1, "2024-01-31", anomalies.count())]
    weak = tables.read_table(spark, root, "model_performance", schemas.MODEL_PERFORMANCE).filter(
        "metric_name = 'f1_score' and metric_value < 0.7").select("model_name", "metric_value").distinct().count()
    alerts = tables.read_table(spark, root, "alerts", schemas.ALERTS)
    assert alerts.filter("alert_type = 'model_quality'").count() == weak > 0
    jobs.monitoring_job(spark, root, now())
    assert tables.read_table(spark, root, "alerts", schemas.ALERTS).count() == alerts.count()

    rows.unionByName(rows.limit(1)).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="unique_log_id"):
        jobs.daily_job(spark, str(tmp_path / "bad"), str(tmp_path / "none"), f"{models}/forest_*", root, "2024-02-01")
    assert not (tmp_path / "none").exists()


def test_enrichment_job_gives_bursts_and_top_windows(spark, small, tmp_path):
    catalog.scored_logs(spark, small).drop("event_id", "value", "k").write.parquet(str(tmp_path / "raw"))
    got = jobs.enrichment_job(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "combined_score", top=3)
    assert got.top.count() == 3 and got.summary.agg(F.sum("log_count")).first()[0] == 1000
    best = got.summary.agg(F.max("max_anomaly_score")).first()[0]
    assert got.top.first()["max_anomaly_score"] == best and got.bursts.count() == 1


def test_time_split(spark):
    from logtide.operators.evaluate import time_split

    df = batch(spark, *[(f"k{i}", i, 0.5) for i in range(10)])
    early, late = time_split(df, 0.7)
    assert early.count() == 7 and late.count() == 3
    assert early.agg(F.max("timestamp")).first()[0] < late.agg(F.min("timestamp")).first()[0]
    assert time_split(df.limit(0))[0].count() == 0
