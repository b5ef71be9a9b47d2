"""Run registered queries beside their SQL and compare columns, counts and values.

    python tests/check_oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import importlib
import os
import sys
import time

import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    duckdb = importlib.import_module("duckdb")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return db


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype(str)
        elif pd.api.types.is_numeric_dtype(frame[c]):
            frame[c] = frame[c].astype(float)
        else:
            frame[c] = frame[c].astype(str)
    return frame.sort_values(list(frame.columns), ignore_index=True)


def kind(type_name: str) -> str:
    """Integer, float, text, boolean or the name itself, for Spark and SQL type names alike."""
    name = type_name.lower().split("(")[0]
    groups = {
        "integer": ("bigint", "int", "integer", "smallint", "tinyint", "hugeint"),
        "float": ("double", "float", "real"),
        "text": ("string", "varchar"),
    }
    return next((k for k, names in groups.items() if name in names), name)


def differences(spark_df, relation) -> str | None:
    """None when equal, else a description of the first difference."""
    given = {c: kind(t) for c, t in spark_df.dtypes}
    asked = {c: kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    if given != asked:
        return f"types {sorted(set(given.items()) ^ set(asked.items()))}"
    wide = [c for c, t in zip(relation.columns, relation.types) if str(t) == "HUGEINT"]
    if wide:
        return f"wide integers in SQL: {wide}"
    found, wanted = canonical(spark_df.toPandas()), canonical(relation.df())
    if list(found.columns) != list(wanted.columns):
        return f"columns {list(found.columns)} != {list(wanted.columns)}"
    if len(found) != len(wanted):
        return f"rows {len(found)} != {len(wanted)}"
    unequal = ((found != wanted) & ~(found.isna() & wanted.isna())).any(axis=1)
    if unequal.any():
        at = unequal.idxmax()
        return f"{int(unequal.sum())} rows differ, first:\n{found.loc[at].to_dict()}\n{wanted.loc[at].to_dict()}"
    return None


def main() -> int:
    from tidewatch.plans.oracle import oracle
    from tidewatch.plans.queries import QUERIES
    from tidewatch.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, db, sql = local_session(), connect(sf_dir), oracle()
    failed = []
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = differences(df, db.sql(sql[name])) if name in sql else None
            note = "" if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # report and go on with the others
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        print(f"{'FAIL' if problem else 'ok':5}{name:24}{time.time() - start:7.1f}s {note}{problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
