"""The same counts over a stream of events, an extension: all of them are sums, so they need no state but Spark's own.

``counts`` keeps them by window of event time; ``refit`` is for ``foreachBatch``
and fits the features whose counts changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fit


def counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """``window, sample, feature, c`` of ``ts, sample, feature``; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "sample", "feature").agg(F.count("*").alias("c"))


def refit(pmfs: DataFrame, n: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch`` in complete mode: rates of all features that the batch has."""

    def run(batch: DataFrame, number: int) -> None:
        whole = batch.groupBy("sample", "feature").agg(F.sum("c").alias("c"))
        sink(fit.fit_rates(fit.with_pmfs(fit.histogram(whole, F.lit(n)), pmfs)), number)

    return run
