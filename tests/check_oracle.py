"""Compare queries with their oracle SQL: ``python tests/check_oracle.py [sf] [names..]``."""

from __future__ import annotations

import datetime
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sievework import catalog  # noqa: E402
from sievework.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> DuckDB type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def duck_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)


def _plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def compare(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when names, types and rows agree, else what differs."""
    names = sorted(df.columns)
    result = db.execute(sql)
    duck_names = [d[0] for d in result.description]
    if sorted(duck_names) != names:
        return f"columns {names} != {sorted(duck_names)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    wrong = {
        f.name: (f.dataType.simpleString(), kinds[f.name])
        for f in df.schema.fields
        if TYPES.get(f.dataType.simpleString()) != kinds[f.name]
    }
    place = [duck_names.index(n) for n in names]
    theirs = sorted((tuple(_plain(r[i]) for i in place) for r in result.fetchall()), key=_key)
    ours = sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, first {names}: {bad[0][0]} != {bad[0][1]}"
    return f"types differ: {wrong}" if wrong else None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = [a for a in sys.argv[2:] if a != "-v"] or list(catalog.QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(8)
    db = duck_tables(sf_dir)
    failed = []
    for name in wanted:
        start = time.perf_counter()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            if name in catalog.ORACLE:
                problem = compare(df, db, catalog.ORACLE[name])
                note = problem or "equal"
            else:
                problem = None if (n := df.count()) else "no rows"
                note = problem or f"{n} rows"
        except Exception as error:  # noqa: BLE001
            problem = note = str(error).strip().split("JVM stacktrace")[0][:600]
            if "-v" in sys.argv:
                traceback.print_exc()
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name:26} {time.perf_counter() - start:7.2f}s {note}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
