"""Result tables: Parquet folders with a folder per day, written by Spark's own writers.

New rows are appended to their days; a change replaces the days that it touches (``partitionOverwriteMode`` dynamic,
staged by Spark and published when the job commits); retention drops folders. One job writes a table at a time.
Files are sorted by key inside a day and carry Parquet Bloom filters on it, so that a look-up of a few keys leaves most
row groups unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_DAY = "none"
#: Columns that rows are looked up by; the first one that a table has.
KEYS = ("log_id", "anomaly_id")
#: Most keys that are pushed into the scan; more are joined.
PUSHED_KEYS = 2_000


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def day_of(column: str | Column) -> Column:
    """Day that decides a row's folder, as text; rows without one have their own."""
    return F.coalesce(F.to_date(column).cast("string"), F.lit(NO_DAY))


def days(spark: SparkSession, root: str, name: str) -> list[str]:
    """Days that have a folder, ascending; a listing only."""
    pattern, fs = _at(spark, f"{root}/{name}/day=*")
    return sorted(f.getPath().getName().removeprefix("day=") for f in fs.globStatus(pattern) or [])


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType, only: list[str] | None = None) -> DataFrame:
    """The stored rows, of the given days where ``only`` names some; an empty table before the first write."""
    found = [d for d in days(spark, root, name) if only is None or d in only]
    if not found:
        return spark.createDataFrame([], schema)
    # the folders are named, so that no other is listed
    return spark.read.schema(schema).parquet(*[f"{root}/{name}/day={d}" for d in found])


def _write(df: DataFrame, root: str, name: str, schema: T.StructType, day: str, mode: str) -> None:
    rows = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("day", day_of(day))
    key = next((k for k in KEYS if k in schema.fieldNames()), None)
    if key:
        rows = rows.sortWithinPartitions("day", key)
    writer = rows.write.mode(mode).partitionBy("day").option("partitionOverwriteMode", "dynamic")
    if key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(f"{root}/{name}")


def append_table(df: DataFrame, root: str, name: str, schema: T.StructType, day: str) -> None:
    """Add rows; what is stored is neither read nor written."""
    _write(df, root, name, schema, day, "append")


def replace_days(df: DataFrame, root: str, name: str, schema: T.StructType, day: str) -> None:
    """Put ``df`` (which must not read the table itself) in the place of its days; all other days stay."""
    _write(df, root, name, schema, day, "overwrite")


def drop_days(spark: SparkSession, root: str, name: str, before: str) -> list[str]:
    """Remove the folders of the days before a day (yyyy-MM-dd); gives their days."""
    old = [d for d in days(spark, root, name) if d != NO_DAY and d < before]
    for d in old:
        where, fs = _at(spark, f"{root}/{name}/day={d}")
        fs.delete(where, True)
    return old


@contextmanager
def _pushed(spark: SparkSession, keys: int) -> Iterator[None]:
    """Lets an IN list of so many values reach the Bloom filters; by default ten values become their range."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), keys)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def look_up(stored: DataFrame, keys: DataFrame, key: str, columns: list[str], take, most: int = PUSHED_KEYS):
    """``take`` of the ``columns`` of the rows of ``stored`` whose ``key`` is in ``keys``; it must evaluate them.

    Up to ``most`` keys go into the scan as a list, which row groups are left out by; more are joined.
    """
    some = [r[0] for r in keys.select(key).distinct().limit(most + 1).collect() if r[0] is not None]
    if len(some) > most:
        return take(stored.select(*columns).join(keys.select(key).distinct(), key, "left_semi"))
    with _pushed(stored.sparkSession, len(some)):
        return take(stored.filter(F.col(key).isin(some)).select(*columns))


def compact(spark: SparkSession, root: str, name: str, schema: T.StructType, day: str, only: list[str]) -> None:
    """Write the given days anew, in few files sorted by key; for days that many small batches were appended to."""
    from logtide.plans.materialize import materialize, release

    for d in set(only) & set(days(spark, root, name)):
        kept = materialize(read_table(spark, root, name, schema, [d]))
        key = next((k for k in KEYS if k in schema.fieldNames()), None)
        replace_days(kept.repartitionByRange(key) if key else kept, root, name, schema, day)
        release(kept)
