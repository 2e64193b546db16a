"""Compares queries with their SQL over one folder of test tables: python tests/compare.py FOLDER [QUERY...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connection(folder: str):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(folder).iterdir():
        where = f"{p}/*.parquet" if p.is_dir() else p
        c.sql(f"CREATE VIEW {p.name.partition('.')[0]} AS SELECT * FROM read_parquet('{where}')")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> str:
    """Nothing if the rows are the same, else what differs."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a)[:3]}, only in SQL {sorted(b)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e

    from ledgerline.session import build

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = build(8), connection(folder)
    sql = e.oracle_sql()
    for name, q in e.queries().items():
        if names and not any(name == n or n.endswith("*") and name.startswith(n[:-1]) for n in names):
            continue
        t = time.time()
        try:
            df = q(spark, folder)
            said = differences(df, sql[name], con) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:900]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
