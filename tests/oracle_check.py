"""Compare registered queries with their DuckDB SQL: python tests/oracle_check.py [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return (1, float(v))
    if isinstance(v, (list, tuple)):
        return (1, tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return (1, tuple(_norm(x) for x in v.values()))
    return (1, str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """Returns (message or '', number of rows); every value must be equal."""
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    dcols, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(spark_df.columns) != sorted(dcols):
        return f"columns {sorted(spark_df.columns)} vs {sorted(dcols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    a, b = _rows(spark_df.columns, got), _rows(dcols, want)
    names = sorted(dcols)
    for x, y in zip(a, b):
        if x != y:
            diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
            return f"values {diff[:4]} in row {x[:6]}", len(got)
    return "", len(got)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    import __spark_entry__ as entry
    from tillwatch.session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    con, bad = connect(sf_dir), 0
    for n in names:
        start = time.time()
        try:
            if n in oracle:
                message, rows = compare(queries[n](spark, sf_dir), con, oracle[n])
            else:
                rows, message = len(queries[n](spark, sf_dir).collect()), ""
        except Exception as exc:  # report and go on to the next query
            message, rows = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        bad += bool(message)
        kind = "sql" if n in oracle else "rows"
        print(f"{'FAIL' if message else 'ok  '} {n:32s} {kind:4s} rows={rows:<7d} {time.time() - start:6.2f}s {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
