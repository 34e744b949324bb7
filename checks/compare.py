"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
import traceback

import duckdb

from linkloom.session import build_session, clean_up


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def rows(names, data) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, sf: str, name: str) -> tuple[int, list[str]]:
    """Rows of a query, and in what it differs from its SQL."""
    from checks.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        return len(got), []
    cur = con.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows(list(types), cur.fetchall())
    found = [f"type {c}: {t}, {types.get(c)}" for c, t in df.dtypes if KINDS.get(t) != types.get(c)]
    if sorted(df.columns) != sorted(types):
        found.append(f"columns {sorted(df.columns)}, {sorted(types)}")
    if got != want:
        found.append(f"{len(got)} rows, {len(want)} in SQL")
        found += [f"only Spark: {r}" for r in got if r not in set(want)][:2]
        found += [f"only SQL: {r}" for r in want if r not in set(got)][:2]
    return len(got), found


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    from checks.catalog import ORACLES, QUERIES

    con = connect(sf)
    spark = build_session(
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="linkloom-checks-"),
        }
    )
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in args[1:] or QUERIES:
        begin = time.time()
        try:
            n, found = differences(spark, con, sf, name)
        except Exception:
            n, found = 0, [traceback.format_exc()[-1500:]]
        clean_up(spark)
        bad += bool(found)
        kind = "DIFF" if found else "ok" if name in ORACLES else "rows"
        print(f"{kind:5} {name} {n} rows {time.time() - begin:.1f}s", *found, sep="\n      " if found else "", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
