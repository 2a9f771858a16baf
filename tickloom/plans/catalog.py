"""The catalogue of named queries: a DataFrame plan plus the SQL it must agree with.

Both sides are projected through one column list, so names, types and rounding match:
``name`` text, ``name:i`` integer, ``name:f`` double rounded to 6 places (``:f4`` to 4),
``name:d`` date and ``name:t`` timestamp written as text. Rounding is floor(x * 10^n + HALF)
with HALF just above one half: both engines then do the same arithmetic, and exact decimal
ties, which summation order may push to either side, all round up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.plans.adapters import Tables


HALF = 0.5004


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return project(self.plan(Tables(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else project_sql(self.sql, self.columns)


CATALOG: dict[str, Query] = {}


def parse_columns(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, k or "s") for n, _, k in (c.partition(":") for c in text.split()))


def project(df: DataFrame, columns) -> DataFrame:
    out = []
    for n, k in columns:
        c = F.col(n)
        if k == "i":
            c = c.cast("bigint")
        elif k[0] == "f":
            d, unit = c.cast("double"), 10.0 ** int(k[1:] or 6)
            c = F.when(~F.isnan(d), F.floor(d * F.lit(unit) + F.lit(HALF)) / F.lit(unit))
        elif k == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif k == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            c = c.cast("string")
        out.append(c.alias(n))
    return df.select(*out)


def project_sql(sql: str, columns) -> str:
    out = []
    for n, k in columns:
        if k == "i":
            e = f"CAST({n} AS BIGINT)"
        elif k[0] == "f":
            d, unit = f"CAST({n} AS DOUBLE)", f"1e{int(k[1:] or 6)}"
            e = f"CASE WHEN NOT isnan({d}) THEN floor({d} * {unit} + {HALF}::DOUBLE) / {unit} END"
        elif k == "d":
            e = f"strftime({n}, '%Y-%m-%d')"
        elif k == "t":
            e = f"strftime({n}, '%Y-%m-%d %H:%M:%S')"
        else:
            e = f"CAST({n} AS VARCHAR)"
        out.append(f"{e} AS {n}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS q"


def query(name: str, columns: str, sql: str | None = None):
    """Register the decorated ``Tables -> DataFrame`` function under ``name``."""
    def add(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, parse_columns(columns), fn, sql)
        return fn
    return add
