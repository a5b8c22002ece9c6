"""Registered queries: a Spark plan and, where SQL can express it, the checking SQL.

A column list such as ``"signal:s tp:i f1:d"`` fixes names and types of both sides:
s string, i bigint, d double rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, with_fixtures

DIGITS = 6
TIE_DIGITS = 9  # first rounding, so that a last-bit difference cannot split a tie


@dataclass(frozen=True)
class Check:
    name: str
    columns: tuple[tuple[str, str], ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(Tables(spark, folder))
        cols = []
        for name, kind in self.columns:
            c = F.col(f"`{name}`")
            if kind == "i":
                c = c.cast("bigint")
            elif kind == "d":
                c = F.round(F.round(c.cast("double"), TIE_DIGITS), DIGITS) + F.lit(0.0)
            else:
                c = c.cast("string")
            cols.append(c.alias(name))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = {
            "i": 'CAST("{0}" AS BIGINT) AS "{0}"',
            "d": 'round(round(CAST("{0}" AS DOUBLE), 9), 6) + CAST(0 AS DOUBLE) AS "{0}"',
            "s": 'CAST("{0}" AS VARCHAR) AS "{0}"',
        }
        cols = ", ".join(casts[k].format(n) for n, k in self.columns)
        body = with_fixtures(self.sql, lambda t: t)
        return f"SELECT {cols} FROM (\n{body}\n) AS result"


REGISTRY: dict[str, Check] = {}


def check(name: str, columns: str, sql: str | None = None):
    """Register ``plan(tables) -> DataFrame`` under ``name``."""
    parsed = tuple(tuple(c.rsplit(":", 1)) for c in columns.split())

    def wrap(plan):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Check(name, parsed, plan, sql)
        return plan

    return wrap


# --- SQL fragments of the checking side --------------------------------------------


def sql_confusion(pred: str, gold: str) -> str:
    p, g = f"coalesce({pred}, FALSE)", f"coalesce({gold}, FALSE)"
    return (
        f"count(*) FILTER (WHERE {p} AND {g}) AS tp, count(*) FILTER (WHERE {p} AND NOT {g}) AS fp, "
        f"count(*) FILTER (WHERE NOT {p} AND {g}) AS fn, count(*) FILTER (WHERE NOT {p} AND NOT {g}) AS tn"
    )


def sql_div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END"


F1_SQL = sql_div("2 * tp", "2 * tp + fp + fn")
RATIOS_SQL = (
    f"{sql_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {sql_div('tp', 'tp + fp')} AS precision, "
    f"{sql_div('tp', 'tp + fn')} AS recall, {F1_SQL} AS f1"
)
METRIC_COLUMNS = "tp:i fp:i fn:i tn:i accuracy:d precision:d recall:d f1:d"
