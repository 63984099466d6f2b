"""Spark queries against their SQL on DuckDB: python tests/compare.py [sf_dir] [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canon, value)) + "]"
    return str(value)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def differ(frame, con, sql):
    """None if both give the same columns and rows, else what differs."""
    rows = frame.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    want = result.fetchall()
    order = sorted(names)
    mine = sorted([canon(r[c]) for c in order] for r in rows)
    theirs = sorted([canon(r[names.index(c)]) for c in order] for r in want)
    if mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"{len(mine)} rows against {len(theirs)}; first: {str(odd)[:700]}"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master(os.environ.get("COMPARE_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = duck(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in argv[1:] or sorted(oracles):
        start = time.time()
        try:
            found = differ(queries[name](spark, sf_dir), con, oracles[name])
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:600]}"
            con = duck(sf_dir)  # a fatal error ends a connection
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f} s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
