"""Named jobs and lazy table lookup.

A job is a pure function whose positional parameter names are the tables it
reads and whose keyword-only ``as_of`` is the evaluation date.
"""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

JOBS: dict[str, Callable[..., DataFrame]] = {}

ORDER_AS_OF = dt.date(2001, 12, 31)
#: What most dashboards start from, in the order of their dependencies.
SHARED = ("opportunities", "deal_health", "activities", "sales_reps", "build_metrics", "pipeline_events", "agent_decisions", "win_probability_scores")
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def job(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    JOBS[fn.__name__] = fn
    return fn


class Tables(Mapping[str, DataFrame]):
    """Tables by name: given DataFrames, parquet inputs, or jobs over them."""

    def __init__(self, spark: SparkSession, root: str | None = None, as_of: dt.date = ORDER_AS_OF, given: Mapping[str, DataFrame] = ()):
        self.spark, self.root, self.as_of = spark, root, as_of
        self._known: dict[str, DataFrame] = dict(given)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE_TABLES and self.root:
                self._known[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            else:
                self._known[name] = self.run(JOBS[name])
        return self._known[name]

    def run(self, fn: Callable[..., DataFrame]) -> DataFrame:
        args = {}
        for p in inspect.signature(fn).parameters.values():
            if p.name == "spark":
                args["spark"] = self.spark
            elif p.name == "tables":
                args["tables"] = self
            elif p.name == "as_of":
                args["as_of"] = self.as_of
            elif p.default is inspect.Parameter.empty:
                args[p.name] = self[p.name]
        return fn(**args)

    def materialise(self, path: str, names: tuple[str, ...] = SHARED) -> None:
        """Write the named tables once, in this order, and read them from there on; later ones build on earlier ones.

        ``path`` is a folder that all executors share.
        """
        for name in names:
            df = self[name]
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            self._known[name] = self.spark.read.schema(df.schema).parquet(f"{path}/{name}")

    @classmethod
    def stored(cls, spark: SparkSession, path: str, root: str | None = None, as_of: dt.date = ORDER_AS_OF, names: tuple[str, ...] = SHARED) -> Tables:
        """Tables that start from what ``materialise`` wrote."""
        return cls(spark, root, as_of, {name: spark.read.parquet(f"{path}/{name}") for name in names})

    def __iter__(self):
        return iter({**JOBS, **self._known})

    def __len__(self):
        return len({**JOBS, **self._known})
