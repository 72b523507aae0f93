"""Where queries and their SQL are kept."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Registers a query; its doubles are rounded like those of the SQL."""
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = half_up(sql)


def half_up(sql: str) -> str:
    """The SQL with each round(x, n) done on decimals: halves then go away from zero, as they do in Spark."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        out.append(sql[at : m.start()])
        out.append("round_(")
        at = m.end()
    text = "".join(out) + sql[at:]
    while (start := text.rfind("round_(")) >= 0:  # the last call holds no other
        depth, comma, k = 1, -1, start + len("round_(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if text[k] == "," and depth == 1:
                comma = k
            k += 1
        x, n = text[start + len("round_(") : comma], text[comma + 1 : k - 1]
        text = f"{text[:start]}CAST(ROUND(CAST({x} AS DECIMAL(38, 10)),{n}) AS DOUBLE){text[k:]}"
    return text


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    # halves of exact ratios come out as 0.4999.. or 0.5: ten decimals settle them before the last ones are cut
    cut = lambda x: F.coalesce(F.round(x.try_cast("decimal(38, 10)"), digits).cast("double"), x)
    return df.select(*[cut(F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])
