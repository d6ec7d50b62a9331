"""Compare registered queries with their SQL, and time both.

    python tests/check.py [sf folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value):
    """Scalars in a form that both engines share."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, db, sql: str) -> tuple[bool, str]:
    got = rows_of(df.columns, df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows"
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} / {len(want)} rows\n   spark only {str(extra)[:700]}\n   sql only   {str(missing)[:700]}"


def main() -> None:
    import __spark_entry__ as contract
    from storyspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, db, oracle = local_session(8), connect(sf_dir), contract.oracle_sql()
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name, build in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                ok, note = compare(df, db, oracle[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
