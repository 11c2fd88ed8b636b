"""Query registration: one Spark callable and, where SQL can express it, one DuckDB text over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import cut, plain_unions

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}
VIEWS: dict[str, tuple[str, str]] = {}        # name -> (Spark SQL, DuckDB SQL)
STORED: set[str] = set()                      # views that are written once per query, as maps and tracks are in practice


def view(name: str, sql: str, duck: str | None = None, stored: bool = False) -> None:
    """Input view derived from the given tables; other tables and views are written {name} in the text."""
    VIEWS[name] = (sql, duck or sql)
    if stored:
        STORED.add(name)


class Inputs:
    """Tables and views of one data folder as DataFrames, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = plain_unions(spark), folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name][0]
                deps = {d: self(d) for d in set(re.findall(r"\{(\w+)\}", text))}
                made = self.spark.sql(text, **deps)
                self._made[name] = cut(made) if name in STORED else made
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the common table expressions of the views it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(VIEWS[name][1])
                if name not in order:
                    order.append(name)

    need(sql)
    text = sql.strip()
    if not order:
        return text
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({re.sub(r'[{}]', '', VIEWS[n][1])})" for n in order)
    head = re.match(r"with\s+(recursive\s+)?", text, re.I)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{text[head.end():]}"
    return f"WITH {ctes}\n{text}"


def rounded(c: Column | str) -> Column:
    """round(c, 6) without negative zero. Spark rounds a double through its decimal text; where the sixth place is far from a
    tie, the nearest integer to c * 10^6 gives the same double for a fraction of the time."""
    c = F.col(c) if isinstance(c, str) else c
    y = F.abs(c) * 1e6
    clear = (y < 1e11) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(clear, F.signum(c) * F.floor(y + 0.5) / 1e6).otherwise(F.round(c, 6)) + 0.0


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(inputs) -> DataFrame` under `name`; `covers` lists the inventory ids it exercises."""
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def oracles() -> dict[str, str]:
    return {k: with_views(v) for k, v in ORACLES.items()}
