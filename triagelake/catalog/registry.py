"""Registration of a query together with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from triagelake.sources import driver_views


def plain_counts(sql: str) -> str:
    """Conditional counts as 64-bit integers; the checking engine widens them otherwise."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if depth == 0:
                break
        out += [sql[at:start], "CAST(", sql[start:end], " AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.checks: dict[str, str] = {}

    def add(self, name: str, views: tuple[str, ...] = (), sql: str | None = None):
        """Register ``fn(load)``, where ``load(view)`` gives a domain or base table."""

        def register(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                def load(view: str) -> DataFrame:
                    if view in driver_views.VIEWS:
                        return driver_views.load(spark, sf_dir, view)
                    return driver_views.table(spark, sf_dir, view)

                load.spark, load.sf_dir = spark, sf_dir
                return fn(load)

            run.__name__, run.__doc__ = name, fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.checks[name] = plain_counts(driver_views.check_sql(views, sql) if views else sql)
            return fn

        return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed precision, so two engines' sums compare equal."""
    return df.select(*[
        F.round(F.col(n), places).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes
    ])


def joined(array):
    return F.array_join(array, ",")
