"""Order-free comparison of a DataFrame's rows with DuckDB's."""

from __future__ import annotations

import math


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v + 0.0 if v else 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v if isinstance(v, int) else str(v)


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(r[i]) for i in order) for r in cursor.fetchall()]
    return sorted(names), sorted(rows, key=repr)
