"""Log sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.schemas import LOG_PAYLOAD

def read_logs(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan of logs or features. ``path`` may be a glob over many runs."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records as they come in: times as text or timestamps, details as a JSON payload.

    Payload fields become columns, unless the record has a column of that name already.
    """
    rows = read_logs(spark, path)
    if dict(rows.dtypes).get("timestamp") == "string":
        rows = parse_timestamps(rows)
    if "extra_data" in rows.columns:
        fields = [f for f in LOG_PAYLOAD.fields if f.name not in rows.columns]
        rows = flatten_payload(rows, "extra_data", T.StructType(fields))
    return rows


def newest_file(spark: SparkSession, pattern: str) -> str:
    """Path of the newest Parquet file under ``pattern``, from file listings only."""
    newest = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .load(pattern).select("path", "modificationTime")
        .orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).first()
    )
    if newest is None:
        raise FileNotFoundError(f"no Parquet file in {pattern}")
    return newest["path"]


def newest_model(spark: SparkSession, pattern: str) -> str:
    """Folder of the newest stored model among those that match ``pattern``."""
    return newest_file(spark, pattern).rsplit("/", 2)[0]  # a model's tables are folders in it


def read_latest_run(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the run with the newest file among all runs that match ``pattern``.

    A run is a folder, or a single file that lies beside others. The choice looks at file listings
    only; rows are then read from that run alone.
    """
    path = newest_file(spark, pattern)
    folder, _, name = path.rpartition("/")
    if not name.startswith("part-"):
        return read_logs(spark, path, schema)
    while "=" in folder.rpartition("/")[2]:  # step out of partition folders
        folder = folder.rpartition("/")[0]
    return read_logs(spark, folder, schema)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet sink, overwriting. With ``partition_by`` the rows keep their tasks, so a hot
    partition value is written by many of them."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def flatten_payload(df: DataFrame, column: str = "extra_data", schema: T.StructType = LOG_PAYLOAD) -> DataFrame:
    """Replace a JSON payload by its fields as columns; a missing key gives null."""
    return (
        df.withColumn("_payload", F.from_json(F.col(column), schema))
        .select(*[c for c in df.columns if c != column], "_payload.*")
    )


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """ISO text to a zone-less timestamp; text that is none becomes null."""
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz"))


def flatten_known(df: DataFrame, column: str = "extra_data", schema: T.StructType = LOG_PAYLOAD) -> DataFrame:
    """``flatten_payload`` that keeps what the schema does not know: ``unknown`` holds the other keys as a map of JSON."""
    known = F.array(*[F.lit(n) for n in schema.fieldNames()])
    pairs = F.from_json(F.col(column), "map<string,string>")
    rest = F.map_filter(pairs, lambda k, v: ~F.array_contains(known, k))
    own = [F.col(c) for c in df.columns if c != column]
    return df.withColumns({"_payload": F.from_json(F.col(column), schema), "unknown": rest}).select(*own, "_payload.*", "unknown")


# Kinds of JSON values by the name of their type in a variant.
_KINDS = {"BOOLEAN": "boolean", "BIGINT": "integer", "STRING": "string", "VOID": "null"}


def payload_keys(df: DataFrame, column: str = "extra_data") -> DataFrame:
    """payload_key, kind, count: which keys the payloads have and what kinds of values, without any schema.

    Payloads are parsed to variants; text that is no JSON object has no key.
    """
    view = df.select(F.try_parse_json(F.col(column)).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    each = view.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
    name = F.schema_of_variant("value")
    kind = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise(
        F.coalesce(*[F.when(name == n, k) for n, k in _KINDS.items()], F.lit("number")))
    return each.groupBy(F.col("key").alias("payload_key"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("count"))
