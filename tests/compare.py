"""Side-by-side run of registered queries and their SQL. ``python tests/compare.py [sf_dir] [name …]``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(table) -> tuple[list[str], list[tuple]]:
    """Sorted column names, and rows sorted by their exact columns first."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    rows = [tuple(plain(v) for v in r) for r in zip(*columns)]
    exact = [i for i, f in enumerate(names) if str(table.schema.field(f).type) != "double"]
    return names, sorted(rows, key=lambda r: ([str(r[i]) for i in exact], [str(v) for v in r]))


def same(a: tuple, b: tuple) -> bool:
    """Equal as rounded: a digit that the two engines round apart is a difference."""
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1.0, abs(x)))
        for x, y in zip(a, b))


def type_names(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "").replace("[us, tz=UTC]", "[us]") for f in table.schema}


def difference(spark_table, sql_table) -> str | None:
    """What is different, or None."""
    names, left = rows_of(spark_table)
    other, right = rows_of(sql_table)
    if names != other:
        return f"columns {names} / {other}"
    if len(left) != len(right):
        return f"{len(left)} rows / {len(right)}"
    kinds, kinds2 = type_names(spark_table), type_names(sql_table)
    wrong = {n: (kinds[n], kinds2[n]) for n in names if kinds[n] != kinds2[n]}
    if wrong:
        return f"types {wrong}"
    bad = [(a, b) for a, b in zip(left, right) if not same(a, b)]
    return f"{len(bad)} rows differ, first: {names}\n   {bad[0][0]}\n   {bad[0][1]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from logtide.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            table = run(spark, sf_dir).toArrow()
            took = time.time() - start
            result = difference(table, con.execute(sql[name]).to_arrow_table()) if name in sql else None
            note = "ok" if name in sql else f"rows only: {table.num_rows}"
        except Exception as e:  # report and go on to the next query
            took, result = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        failed += result is not None
        print(f"{'FAIL' if result else 'ok  '} {name} {took:.2f}s {result or note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
