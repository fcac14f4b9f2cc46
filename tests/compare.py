"""Runs a query beside its SQL and compares the rows. python tests/compare.py SF_DIR [NAME...]"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return [plain(i) for i in x] if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def differences(spark_df, con, sql):
    """What differs: an empty list if nothing does."""
    there = con.sql(sql)
    a, b = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]), rows_of(there.columns, there.fetchall())
    out = []
    if sorted(spark_df.columns) != sorted(there.columns):
        out.append(f"columns {sorted(spark_df.columns)} and {sorted(there.columns)}")
    if len(a) != len(b):
        out.append(f"rows {len(a)} and {len(b)}")
    if a != b:
        out += [f"only in Spark {x}" for x in [x for x in a if x not in b][:2]] if len(a) < 5000 else []
        pair = next(((x, y) for x, y in zip(a, b) if x != y), None)
        out.append(f"first difference {pair}")
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry
    from sedimenta.session import local_session

    spark, con = local_session(), connect(sys.argv[1])
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in sys.argv[2:])]
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sys.argv[1])
            if name in oracle:
                bad = differences(df, con, oracle[name])
                print(f"{name}: {'DIFFERS ' + str(bad)[:900] if bad else 'same'} {time.time() - began:.1f} s", flush=True)
            else:
                print(f"{name}: {len(df.collect())} rows, no SQL, {time.time() - began:.1f} s", flush=True)
        except Exception as e:
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:900]}", flush=True)
