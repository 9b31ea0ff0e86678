"""Stability over a stream: windowed cubes against stored benchmark shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.binning import BinRule, index_columns
from ..operators.stability import bin_distribution, psi_from_shares


def windowed_cube(stream: DataFrame, rules: dict[str, BinRule], ts: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by window, feature and bin; late rows count until the watermark passes."""
    rows = index_columns(stream.withWatermark(ts, delay), rules, [F.col(ts)])
    return rows.groupBy(F.window(ts, window).alias("window"), "feature", "bin_idx").agg(F.count(F.lit(1)).cast("double").alias("w"))


def drift(cube: DataFrame, benchmark: DataFrame) -> DataFrame:
    """feature, group (window start), psi of a batch of windowed counts."""
    shares = bin_distribution(cube.withColumn("group", F.col("window.start")), ["feature", "group"])
    return psi_from_shares(bin_distribution(benchmark, ["feature"]), shares, ["feature", "group"])


def watch(stream: DataFrame, rules: dict[str, BinRule], ts: str, benchmark: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **how) -> StreamingQuery:
    """Starts a query that hands the drift of each finished window to sink(df, epoch)."""
    return windowed_cube(stream, rules, ts, **how).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: sink(drift(df, benchmark), k)).start()
