"""Compare named queries with their SQL on DuckDB.  usage: check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from dripline.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
    "FLOAT": "float",
}


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c] + 0.0
        elif df[c].dtype == object or str(df[c].dtype).startswith(("datetime", "str")):
            df[c] = df[c].where(df[c].notna(), None)
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "", regex=False)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(spark, con, name, plan, sql, base) -> str:
    t = time.time()
    sdf = plan(spark, base)
    got = sdf.toPandas()
    spent = time.time() - t
    if sql is None:
        return f"rows {len(got)} {spent:.1f}s" if len(got) else f"EMPTY {spent:.1f}s"
    cur = con.execute(sql)
    types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    want = cur.df()
    problems = []
    if types != dict(sdf.dtypes):
        problems.append(f"types {sorted(set(types.items()) ^ set(dict(sdf.dtypes).items()))}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    elif sorted(got.columns) == sorted(want.columns):
        a, b = canonical(got), canonical(want)
        for c in a.columns:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
            if bad.any():
                i = bad.idxmax()
                problems.append(f"{c}: {int(bad.sum())} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}")
    line = ("OK " if not problems else "BAD ") + f"{len(got)} rows {spent:.1f}s"
    return " ".join([line, *problems] + ([] if len(got) else ["empty"]))


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
    return con


def main() -> int:
    from dripline.plans import registry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    base = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(registry.QUERIES)
    names = [n for want in names for n in registry.QUERIES if n == want or (want.endswith("*") and n.startswith(want[:-1]))]
    spark = build_session(**{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                             "spark.ui.showConsoleProgress": "false"})
    con = connect(base)
    bad = 0
    for name in names:
        try:
            line = compare(spark, con, name, registry.QUERIES[name], registry.SQL.get(name), base)
        except Exception as e:  # report and go on with the next query
            line = f"BAD {type(e).__name__}: {str(e)[:600]}"
        bad += line.startswith(("BAD", "EMPTY"))
        print(f"{name}: {line}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main())
