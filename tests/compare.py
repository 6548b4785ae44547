"""Run a query beside its SQL in DuckDB: python tests/compare.py SF_DIR NAME..."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        files = [p] if os.path.isfile(p) else sorted(glob.glob(f"{p}/**/*.parquet", recursive=True))
        if files:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return con


def rows_of(columns, rows):
    def norm(v):
        if isinstance(v, float):
            return round(v, 9)
        if hasattr(v, "asDict"):
            return str(v.asDict())
        return tuple(v) if isinstance(v, list) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir, names):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names or sorted(queries):
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
        except Exception as e:  # report and go on
            print(name, "ERROR", str(e)[:1500])
            bad += 1
            continue
        took = time.time() - t
        if name not in oracles:
            print(f"{name}: {len(got)} rows in {took:.1f} s, no SQL")
            continue
        t = time.time()
        cur = con.execute(oracles[name])
        cols = [c[0] for c in cur.description]
        want = rows_of(cols, cur.fetchall())
        same = sorted(cols) == sorted(df.columns) and got == want
        types = dict(df.dtypes)
        bad += not same
        print(f"{name}: {'same' if same else 'DIFFERENT'} {len(got)} / {len(want)} rows, {took:.1f} s, SQL {time.time() - t:.1f} s", "" if same else (sorted(cols), types, [x for x in zip(got, want) if x[0] != x[1]][:3]))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
