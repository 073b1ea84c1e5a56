"""Compare a query with its SQL in DuckDB, order aside."""

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = pd.to_numeric(df[c]).astype("float64").round(6)
    return df.astype(str).replace({"<NA>": "None", "nan": "None"}).sort_values(sorted(df.columns)).reset_index(drop=True)


def assert_same(query, sql: str, spark, sf: str) -> None:
    ours, theirs = normal(query(spark, sf).toPandas()), normal(connection(sf).sql(sql).df())
    pd.testing.assert_frame_equal(ours, theirs)
