"""Compares a query with its SQL on another engine, whatever the order of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    def text(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    mine, other = spark_df.toPandas(), con.execute(sql).fetch_df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert canonical(mine) == canonical(other)
