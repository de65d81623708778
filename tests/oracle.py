"""Compare registered queries with their SQL twins: python tests/oracle.py <sf_dir> [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.seconds = time.time() - t
    if sql is None:
        return len(sr), None
    rel = con.sql(sql)
    dc, dr = rows_of(rel.columns, rel.fetchall())
    problems = []
    if sc != dc:
        problems.append(f"columns {sc} != {dc}")
    if len(sr) != len(dr):
        problems.append(f"rows {len(sr)} != {len(dr)}")
    if not problems and sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    elif sr != dr:
        a, b = set(sr) - set(dr), set(dr) - set(sr)
        problems.append(f"only spark {list(a)[:2]} only sql {list(b)[:2]}")
    return len(sr), problems


compare.seconds = 0.0


if __name__ == "__main__":
    from figcorpus.plans.catalog import ORACLES, QUERIES
    from figcorpus.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            n, problems = compare(spark, con, sf_dir, name, fn, ORACLES.get(name))
        except Exception as e:
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        state = "rows" if problems is None else "ok" if not problems else "FAIL"
        print(f"{state:5s} {name} n={n} {compare.seconds:.1f}s of {time.time() - t:.1f}s", flush=True)
        if problems:
            failed.append(name)
            print("     ", "\n      ".join(p[:700] for p in problems), flush=True)
    print("failed:", failed)
