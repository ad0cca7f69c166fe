"""Run queries against their DuckDB SQL: ``python tools/check.py [ID …]`` (env CHECK_SF)."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def normal(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6)
    return str(value) if not isinstance(value, (int, bool, str)) else value


def rows(frame) -> list:
    names = sorted(frame.columns)
    return sorted(
        (tuple(normal(v) for v in row) for row in frame[names].itertuples(index=False, name=None)),
        key=lambda r: [(v is not None, str(v)) for v in r],
    )


def main() -> int:
    from sightings.catalog import ORACLES, QUERIES

    sf_dir = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:] or list(QUERIES)
    wanted = [k for w in wanted for k in QUERIES if k == w or (w.endswith("*") and k.startswith(w[:-1]))]
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = 0
    for key in wanted:
        start = time.time()
        try:
            mine = QUERIES[key](spark, sf_dir).toPandas()
            took = time.time() - start
            if key not in ORACLES:
                print(f"{key:6} rows-only {len(mine):7} {took:5.1f}s", flush=True)
                continue
            start = time.time()
            theirs = db.execute(ORACLES[key]).df()
            duck_took = time.time() - start
            a, b = rows(mine), rows(theirs) if set(mine.columns) == set(theirs.columns) else None
            if b is None:
                bad += 1
                print(f"{key:6} COLUMNS {sorted(mine.columns)} vs {sorted(theirs.columns)}", flush=True)
            elif a != b:
                bad += 1
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                print(f"{key:6} DIFF rows {len(a)} vs {len(b)} {took:4.1f}s {sorted(mine.columns)}", *diff, sep="\n    ", flush=True)
            else:
                kinds = [(c, str(mine[c].dtype), str(theirs[c].dtype)) for c in mine.columns if str(mine[c].dtype).replace("str", "object") != str(theirs[c].dtype).replace("str", "object")]
                print(f"{key:6} ok {len(a):7} {took:5.1f}s duck {duck_took:4.1f}s {kinds or ''}", flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{key:6} ERROR {type(error).__name__} {str(error)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed", bad, "of", len(wanted))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
