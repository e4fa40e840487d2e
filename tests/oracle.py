"""Comparison of a query with its DuckDB SQL over the same files."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _rows(frame):
    def one(v):
        if v is None or str(v) in ("<NA>", "NaT") or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in "if" and hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False, name=None))


def same(spark, query, sql):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = query(spark, SF)
    columns = sorted(got.columns)
    want = con.execute(sql).df()
    assert sorted(want.columns) == columns
    return _rows(got.select(*columns).toPandas()) == _rows(want[columns])
