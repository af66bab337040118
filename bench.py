"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logtide.catalog import all_queries, logs  # noqa: E402
from logtide.models.forest import fit_forest  # noqa: E402
from logtide.operators.features import build_features  # noqa: E402
from logtide.plans.materialize import materialize  # noqa: E402
from logtide.session import build_session  # noqa: E402
from logtide.streaming.jobs import score_stream  # noqa: E402

HEADLINE = [
    "hourly_summary", "rolling_statistics", "lag_features", "feature_table", "enriched_logs", "time_bursts",
    "statistical_detector", "rolling_grid", "upsert_anomalies", "evaluation", "feature_statistics", "quality_checks",
    "response_time_box", "message_terms", "forest_scores", "sequence_errors",
]


#: Headline jobs that are also timed on ten copies of the table, shifted in time.
TENFOLD = ["feature_table", "enriched_logs", "forest_scores"]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def write(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def tenfold(spark, sf_dir: str) -> str:
    """Folder with an ``events`` table of ten copies, each behind the other in time and with ids of its own."""
    folder = f"{tempfile.mkdtemp(prefix='run-')}/tenfold"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = events.agg(((F.max("ts").cast("timestamp").cast("long") - F.min("ts").cast("timestamp").cast("long")) + 60)
                      .alias("s"), (F.max("event_id") + 1).alias("n")).first()
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    copies = copies.withColumns({
        "ts": F.col("ts") + F.make_dt_interval(secs=F.col("copy") * float(span["s"])),
        "event_id": F.col("event_id") + F.col("copy") * span["n"]}).drop("copy")
    copies.write.parquet(f"{folder}/events.parquet")
    return folder


def micro_batch_seconds(spark, sf_dir: str, batches: int = 5) -> list[float]:
    """Seconds of each micro-batch of about 200 feature rows through the scoring stream, after a first one."""
    folder = tempfile.mkdtemp(prefix="run-")
    table = materialize(build_features(logs(spark, sf_dir)))
    model = fit_forest(table, trees=50)
    part = F.pmod(F.xxhash64("log_id"), F.lit(max(1, table.count() // 200)))
    for n in range(batches + 1):
        table.filter(part == n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = score_stream(stream, model, f"{folder}/store", f"{folder}/checkpoint")
    query.awaitTermination()
    took = [p["durationMs"]["triggerExecution"] / 1000 for p in query.recentProgress if p["numInputRows"]]
    return took[1:]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    rows = logs(spark, sf_dir).count()
    cold = {name: timed(lambda n=name: write(queries[n](spark, sf_dir))) for name in ("hourly_summary", "feature_table")}
    seconds = {name: timed(lambda n=name: write(queries[n](spark, sf_dir))) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    rates = {name: round(rows / seconds[name]) for name in TENFOLD}
    out = {"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
           "sf": Path(sf_dir).name.removeprefix("sf"), "log_rows": rows, "logs_per_second": rates,
           "first_run_seconds": cold, "warm_seconds": {
               name: timed(lambda n=name: write(queries[n](spark, sf_dir))) for name in TENFOLD}}
    out["micro_batch_seconds"] = micro_batch_seconds(spark, sf_dir)
    large = tenfold(spark, sf_dir)
    out["tenfold_seconds"] = {name: timed(lambda n=name: write(queries[n](spark, large))) for name in TENFOLD}
    out["tenfold_logs_per_second"] = {name: round(10 * rows / s) for name, s in out["tenfold_seconds"].items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
