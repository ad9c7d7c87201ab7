"""Run registered queries next to their SQL: python tests/check.py <sf_dir> [name prefix ...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.9g}" if v else "0"
        if isinstance(v, bool):
            return str(int(v))
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, run, sql):
    """(rows, message or None)."""
    df = run(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got[1]), None
    rel = con.execute(sql)
    want = canonical([c[0] for c in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return len(got[1]), f"{len(got[1])} / {len(want[1])} rows, {len(a)} / {len(b)} differ: {sorted(a)[:2]} {sorted(b)[:2]}"
    return len(got[1]), None


def session(cores=8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as E

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark, con, sqls = session(), connect(sf), E.oracle_sql()
    bad = 0
    for name, run in E.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            n, error = compare(spark, con, sf, run, sqls.get(name))
        except Exception as e:
            n, error = 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += error is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if error else 'ok'} {name} [{kind}] {n} rows {time.time() - t:.1f}s {error or ''}", flush=True)
    print("failures:", bad)
