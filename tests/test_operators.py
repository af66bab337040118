"""Edge rows of the features, the enrichment, the scores and the reports."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from logtide.catalog import logs, rounded
from logtide.functions import logs as fn
from logtide.operators import detectors, enrich, evaluate, features, monitor, reports, scoring, summary, text
from logtide.schemas import FEATURE_TABLE, FEATURE_TABLE_EXTRA
from logtide.sources import logs as sources

T0 = dt.datetime(2024, 1, 6, 8, 59, 59)
LOGS = ("log_id string, timestamp timestamp_ntz, log_type string, log_level string, message string,"
        " response_time_ms double, user_id string, status_code int, is_anomaly boolean")


def log(i, seconds=0.0, kind="API_REQUEST", level="INFO", message="ok", rt=None, user="u", code=200, bad=False):
    return (f"log_{i}", T0 + dt.timedelta(seconds=seconds), kind, level, message, rt, user, code, bad)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), LOGS)


def by_id(df, *columns):
    return {r["log_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_temporal_borders(spark):
    df = frame(spark, log(1), log(2, 1), log(3, 9 * 3600), log(4, 9 * 3600 + 1), log(5, 2 * 86400))
    got = by_id(features.temporal_features(df), "hour", "day_of_week", "is_weekend", "is_business_hours")
    assert got == {"log_1": (8, 7, 1, 0), "log_2": (9, 7, 1, 1), "log_3": (17, 7, 1, 1), "log_4": (18, 7, 1, 0),
                   "log_5": (8, 2, 0, 0)}


def test_level_codes_unknown_and_null(spark):
    df = frame(spark, *[log(i, level=x) for i, x in enumerate(["DEBUG", "CRITICAL", "TRACE", None])])
    assert by_id(df.withColumn("c", fn.level_code(F.col("log_level"))), "c") == {
        "log_0": (0,), "log_1": (4,), "log_2": (None,), "log_3": (None,)}


def test_rolling_peers_border_and_foreign_types(spark):
    df = frame(spark, log(1, rt=10.0), log(2, 0.4, rt=30.0), log(3, 300, rt=None), log(4, 301, rt=7.0),
               log(5, 10, kind="ERROR", rt=99.0))
    got = by_id(features.rolling_statistics(df), "count_5min", "avg_response_time_5min", "max_response_time_5min")
    assert got["log_1"] == got["log_2"] == (2, 20.0, 30.0)  # rows of one second see each other
    assert got["log_3"] == (3, 20.0, 30.0)                  # both borders closed
    assert got["log_4"] == (2, 7.0, 7.0)
    assert got["log_5"] == (1, 0.0, 0.0)                    # response times of API requests only


def test_statistics_of_small_groups(spark):
    df = frame(spark, log(1, rt=5.0), log(2, rt=None), log(3, kind="ERROR", rt=4.0), log(4, kind="ERROR", rt=4.0))
    got = by_id(features.statistical_features(df), "response_time_zscore", "is_slow_response")
    assert set(got.values()) == {(0.0, 0)}


def test_type_index_by_frequency_then_name(spark):
    df = frame(spark, log(1, kind="B"), log(2, kind="A"), log(3, kind="C"), log(4, kind="C"), log(5, kind=None))
    got = {r["log_type"]: r["log_type_indexed"] for r in features.type_statistics(df).collect()}
    assert got == {"C": 0.0, "A": 1.0, "B": 2.0, None: None}


def test_type_index_of_a_long_list(spark, monkeypatch):
    df = frame(spark, log(1, kind="B"), log(2, kind="A"), log(3, kind="C"), log(4, kind="C"), log(5, kind=None))
    monkeypatch.setattr(features, "fetch_bounded", lambda _: None)
    got = {r["log_type"]: r["log_type_indexed"] for r in features.type_statistics(df).collect()}
    assert got == {"C": 0.0, "A": 1.0, "B": 2.0, None: None}


def test_feature_table_columns_and_zero_fill(spark):
    got = features.build_features(frame(spark, log(1, rt=None, code=None), log(2, 5, rt=3.0)))
    assert got.columns == FEATURE_TABLE + FEATURE_TABLE_EXTRA
    rows = by_id(got, "response_time_ms", "response_time_lag_1", "count_lag_1", "status_code")
    assert rows == {"log_1": (0.0, 0.0, 0, 0), "log_2": (3.0, 0.0, 1, 200)}


@pytest.mark.parametrize("slice_rows, hot_cell", [(5, 1_000_000), (64, 3)])
def test_feature_table_does_not_depend_on_the_cutting(spark, small, slice_rows, hot_cell):
    df = logs(spark, small)
    whole = rounded(features.build_features(df))
    cut = rounded(features.build_features(df.repartition(7), slice_rows=slice_rows, hot_cell=hot_cell))
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_feature_table_of_nothing(spark):
    assert features.build_features(frame(spark)).count() == 0
    assert enrich.build_enriched(frame(spark)).count() == 0


def test_selection_reports_missing_columns(spark):
    df, missing = features.select_existing(frame(spark, log(1)), ["message", "nope", "log_id"])
    assert (df.columns, missing) == (["message", "log_id"], ["nope"])


def test_status_codes(spark):
    texts = ["x returned 404 in 150ms", "took 150ms", "200 then 500", "", None]
    df = frame(spark, *[log(i, message=m) for i, m in enumerate(texts)])
    assert by_id(enrich.status_features(df), "extracted_status_code", "is_error_status") == {
        "log_0": ("404", 1), "log_1": ("", 0), "log_2": ("200", 0), "log_3": ("", 0), "log_4": (None, 0)}


def test_inter_arrival(spark):
    df = frame(spark, log(1), log(2, 90), log(3, 5, kind="ERROR"))
    got = by_id(enrich.inter_arrival(df), "prev_timestamp", "inter_arrival_seconds")
    assert got == {"log_1": (None, 0), "log_2": (T0, 90), "log_3": (None, 0)}


def test_variability_of_equal_and_of_large_values(spark):
    df = frame(spark, log(1, rt=7.1), log(2, 1, rt=7.1), log(3, 2, rt=7.1), log(4, 9000, rt=1e9), log(5, 9001, rt=1e9 + 1))
    got = by_id(enrich.hourly_variability(df), "variance_response_time", "coefficient_variation")
    assert got["log_1"] == (None, None)
    assert got["log_3"] == (0.0, 0.0)
    assert got["log_5"][0] == pytest.approx(0.5, rel=1e-9)


def test_entropy(spark):
    df = frame(spark, log(1, level="INFO"), log(2, 1, level="WARN"), log(3, 2, level=None))
    got = by_id(enrich.hourly_variability(df), "log_level_entropy", "log_level_entropy_literal")
    assert got["log_1"] == (0.0, 0.0)
    assert got["log_2"] == pytest.approx((1.0, 0.5))
    assert got["log_3"] == pytest.approx((1.0, 0.5))
    arrays = spark.createDataFrame([([],), (["a", "b", "a", "b"],), (["a"],), (["a", None, None, "b"],)], "v array<string>")
    assert [r[0] for r in arrays.select(fn.array_entropy_bits(F.col("v"))).collect()] == pytest.approx([0.0, 1.0, 0.0, 1.5])


def test_row_bursts_never_fire_but_time_bursts_do(spark):
    rows = [log(i, i * 4000) for i in range(40)] + [log(100 + i, 1_000_000 + i) for i in range(8)]
    df = frame(spark, *rows)
    assert enrich.row_bursts(df).filter("is_burst = 1").count() == 0
    fired = {r["log_id"] for r in enrich.time_bursts(df, 300).filter("is_burst = 1").collect()}
    assert fired and fired <= {f"log_{100 + i}" for i in range(8)}


def test_scaler_constant_column_and_empty_table(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = scoring.scale(df, scoring.fit_scaler(df, ["a", "b"]), []).collect()
    mean, std = 4 / 3, math.sqrt((1 + 9 + 0) / 3 - (4 / 3) ** 2)
    assert [r["a"] for r in got] == pytest.approx([(1 - mean) / std, (3 - mean) / std, -mean / std])
    assert [r["b"] for r in got] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        scoring.fit_scaler(df.limit(0), ["a"])


def test_min_max_equal_scores_and_nulls(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "s double")
    for invert in (True, False):
        assert [r["n"] for r in scoring.min_max(df, "s", "n", invert=invert).collect()] == [0.0, 0.0, None]
    two = spark.createDataFrame([(1.0,), (3.0,)], "s double")
    assert [r["n"] for r in scoring.min_max(two, "s", "n", invert=True).collect()] == [1.0, 0.0]


def test_combined_score(spark):
    df = spark.createDataFrame([(0.5, None), (0.6, None), (None, None), (0.2, 1.0)], "if_score double, other double")
    got = scoring.combine_scores(df).collect()
    assert [(r["combined_score"], r["is_anomaly_predicted"]) for r in got] == [(0.5, 0), (0.6, 1), (0.0, 0), (0.2, 0)]
    mixed = scoring.combine_scores(df, {"if_score": 1.0, "other": 3.0}).collect()
    assert [r["combined_score"] for r in mixed] == pytest.approx([0.5, 0.6, 0.0, 0.8])


def test_evaluation_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "a int, p int")
    row = evaluate.evaluate(df, "a", "p").first()
    assert (row["precision"], row["recall"], row["f1_score"], row["tn"]) == (0.0, 0.0, 0.0, 2)
    assert sorted(tuple(r) for r in evaluate.confusion_matrix(df, "a", "p").collect()) == [
        (0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_holdout_split_is_a_partition(spark, small):
    df = logs(spark, small)
    train, test = evaluate.holdout_split(df, 0.8)
    assert train.count() + test.count() == df.count() and train.join(test, "log_id", "left_semi").isEmpty()


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    got = {r["bin"]: r["count"] for r in reports.histogram(df, "v", 10).collect()}
    assert got == {**{i: 1 for i in range(9)}, 9: 2}
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [(r["bin"], r["count"]) for r in reports.histogram(same, "v", 10).collect()] == [(0, 2)]


def test_quality_checks_fail_loudly(spark):
    good = frame(spark, log(1), log(2))
    monitor.require_quality(good)
    for bad, rule in ((good.limit(0), "not_empty"), (frame(spark, log(1), log(1)), "unique_log_id"),
                      (good.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")), "timestamp_present")):
        with pytest.raises(ValueError, match=rule):
            monitor.require_quality(bad)


def test_seasonal_rule(spark):
    df = spark.createDataFrame([(10.0, 1.0, 0.0), (4.1, 1.0, 1.0), (4.0, 1.0, 1.0), (-2.1, 1.0, 1.0)],
                               "v double, m double, s double")
    assert [r[0] for r in df.select(fn.is_seasonal_anomaly(F.col("v"), F.col("m"), F.col("s"))).collect()] == [
        False, True, False, True]


@pytest.mark.parametrize("slice_rows", [1, 7, 150, 100_000])
def test_ewma_is_the_recursion(spark, slice_rows):
    """A spike far back still counts, however the rows are cut."""
    values = [5.0, None, 1e25, 9.0, 9.0, None] + [2.0, 4.0, 4.5, 8.0] * 45
    df = frame(spark, *[log(i, i, rt=v) for i, v in enumerate(values)])
    got = by_id(detectors.ewma(df, alpha=0.3, slice_rows=slice_rows), "ewma")
    y = None
    for i, v in enumerate(values):
        if v is None:
            assert got[f"log_{i}"] == (None,)
        else:
            y = v if y is None else 0.3 * v + 0.7 * y
            assert got[f"log_{i}"][0] == pytest.approx(y, rel=1e-12)


def test_sessions_split_after_the_gap(spark):
    df = frame(spark, log(1), log(2, 1800), log(3, 3601, bad=True), log(4, 10, user=None))
    got = detectors.sessions(df).orderBy("session_start").collect()
    assert [(r["log_count"], r["anomaly_count"]) for r in got] == [(2, 0), (1, 1)]


def test_summary_windows(spark):
    df = frame(spark, log(1), log(2, 1), log(3, 2, user=None)).withColumns({
        "combined_score": F.lit(0.4), "is_anomaly_predicted": F.lit(1)})
    got = summary.hourly_summary(df).orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["log_count"], r["unique_users"], r["anomaly_count"]) for r in got] == [
        (8, 1, 1, 1), (9, 2, 1, 2)]


def test_text_vectors(spark):
    df = frame(spark, log(1, message="Disk is full"), log(2, message="disk full, disk!"), log(3, message=None))
    terms = [tuple(r) for r in text.term_counts(df, 3).collect()]
    assert terms == [("disk", 3, 2), ("full", 2, 2), ("disk full", 1, 1)]
    rows = text.text_vectors(df, 3).orderBy("log_id").collect()
    assert [list(r["term_vector"].toArray()) for r in rows] == [[1, 1, 0], [2, 1, 1], [0, 0, 0]]


def test_payload_and_timestamps(spark):
    df = spark.createDataFrame([("a", "2024-01-01T10:00:00.5", '{"status_code": 500, "service": "api"}'),
                                ("b", "soon", '{"action": "login"}'), ("c", None, None)],
                               "log_id string, timestamp string, extra_data string")
    got = by_id(sources.parse_timestamps(sources.flatten_payload(df)), "timestamp", "status_code", "service", "action")
    assert got == {"a": (dt.datetime(2024, 1, 1, 10, 0, 0, 500000), 500, "api", None), "b": (None, None, None, "login"),
                   "c": (None, None, None, None)}


def test_latest_run_and_globs(spark, tmp_path):
    import os

    for name, n, age in (("features_1", 3, 300), ("features_2", 5, 100), ("features_3", 2, 200)):
        df = spark.range(n).withColumn("log_type", F.lit("A"))
        sources.write_table(df, str(tmp_path / name), ["log_type"] if n == 5 else None)
        for folder, _, files in os.walk(tmp_path / name):
            for f in files:
                stamp = os.stat(f"{folder}/{f}").st_mtime - age
                os.utime(f"{folder}/{f}", (stamp, stamp))
    plain = str(tmp_path / "features_[13]")
    assert sources.read_logs(spark, plain).count() == 5
    assert sources.read_latest_run(spark, plain).count() == 2
    newest = sources.read_latest_run(spark, str(tmp_path / "features_*"))
    assert newest.count() == 5 and "log_type" in newest.columns


def test_term_weights_make_rows_of_present_terms_only(spark):
    """No row of a text for every term of the vocabulary; a term in all texts stays, with weight 0."""
    from logtide.operators import text

    rows = [("a", "alpha beta alpha"), ("b", "alpha"), ("c", "alpha gamma"), ("c", "alpha gamma"), (None, "alpha beta"), ("d", "")]
    found = text.term_weights(spark.createDataFrame(rows[:5], "log_id string, message string"))
    given = sorted((str(r["log_id"]), r["term"], round(r["weight"], 6)) for r in found.collect())
    half = 0.693147
    assert [g for g in given if g[1] == "alpha"] == [(k, "alpha", 0.0) for k in ("None", "a", "b", "c", "c")]
    assert [g for g in given if g[1] == "beta"] == [("None", "beta", half), ("a", "beta", half)]
    assert len(given) == 14
    plan = text.term_weights(spark.createDataFrame(rows, "log_id string, message string"))._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "explode(arrays_zip" in plan
