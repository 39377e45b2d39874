"""Counts of a run's steps, gathered while the run writes its result: no pass of their own over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class RunMetrics:
    """observe() marks a step; after one action over the last of them, table() has a row for each metric of each step."""

    def __init__(self, run: str = ""):
        self.run, self.held = run, {}

    def observe(self, df: DataFrame, step: str, **metrics: Column) -> DataFrame:
        """df, with metrics (aggregates) taken as its rows go by; a count where none is named."""
        self.held[step] = Observation(f"{self.run}|{step}")
        named = metrics or {"n": F.count(F.lit(1))}
        return df.observe(self.held[step], *[c.alias(n) for n, c in named.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.run, step, name, float(v) if v is not None else None) for step, o in self.held.items() for name, v in o.get.items()]
        return spark.createDataFrame(rows, "run string, step string, metric string, value double")


def bucket_counts(value: Column, bounds: list[float]) -> dict[str, Column]:
    """The cumulative counters of a histogram as metrics of a step: le_<bound> and le_inf."""
    return {f"le_{b}": F.count_if(value <= F.lit(b)) for b in bounds} | {"le_inf": F.count(value)}


class StreamMetrics(StreamingQueryListener):
    """The observed metrics of each batch of the streams that run while it is registered: (run id, batch, step, metric, value)."""

    def __init__(self):
        self.rows: list[tuple[str, int, str, str, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for step, row in p.observedMetrics.items():
            self.rows += [(str(p.runId), p.batchId, step, k, float(v)) for k, v in row.asDict().items() if v is not None]

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run string, batch long, step string, metric string, value double")
