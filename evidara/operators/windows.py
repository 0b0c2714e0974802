"""Windows over samples: tumbling spans, even frame choice, segments and residual statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.quantiles import grouped_quantiles, with_quantiles
from evidara.sources.tables import durable


def tumbling(rows: DataFrame, key: str, index: str, width: int, least: int, value: str) -> DataFrame:
    """Mean of each run of ``width`` consecutive samples; a last run of under ``least`` samples is dropped."""
    w = rows.groupBy(key, F.floor(F.col(index) / width).cast("long").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("score"))
    return w.filter(F.col("n") >= least)


def segments(windows: DataFrame, width: int, rate: int, above: float = 0.65) -> DataFrame:
    """Windows that score over ``above`` as start and end in milliseconds."""
    ms = lambda k: (k * width * 1000 / rate).cast("long")
    return windows.filter(F.col("score") > above).withColumn("start_ms", ms(F.col("win"))).withColumn("end_ms", ms(F.col("win") + 1))


def even_frames(n_frames: Column, take: int = 16) -> Column:
    """Array of ``take`` frame numbers spread evenly; a shorter clip repeats its last frame."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(take - 1)), lambda i: F.floor(i * (n_frames - 1) / (take - 1)).cast("int"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(take - 1)), lambda i: F.least(i, n_frames - 1).cast("int"))
    return F.when(n_frames >= take, spread).when(n_frames > 0, padded)


def fitted(samples: Column, length: int) -> Column:
    """Array cut to ``length`` or repeated up to it; an empty one stays."""
    times = F.ceil(F.lit(length) / F.greatest(F.size(samples), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(samples, times)), 1, length)


def residual_outliers(rows: DataFrame, key: str, x: str, y: str, z: float = 3.5) -> DataFrame:
    """Per key a line fitted by least squares, its fit, the tiles whose residual is an outlier by the median deviation, and p99.

    ``mad`` is the median absolute deviation of the residuals from their median, ``p99`` the 99th percentile of the residuals'
    size.  Medians and percentiles are exact and no task gets a key's rows.
    """
    line = rows.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    left = durable(with_quantiles(rows.select(key, x, y), [key], durable(line)).withColumn("_r", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).withColumn("_size", F.abs("_r")))
    mid = durable(grouped_quantiles(left, [key], "_r", {"_m": 0.5}))
    off = durable(with_quantiles(left, [key], mid).withColumn("_d", F.abs(F.col("_r") - F.col("_m"))))
    spread = durable(grouped_quantiles(off, [key], "_d", {"mad": 0.5}).join(grouped_quantiles(off, [key], "_size", {"p99": 0.99}), key))
    far = F.count_if((F.col("mad") > 0) & (0.6745 * F.col("_d") / F.col("mad") > z))
    first = [F.first(c).alias(c) for c in ("slope", "intercept", "r2", "mad", "p99")]
    return with_quantiles(off, [key], spread).groupBy(key).agg(*first, far.alias("n_outliers"), F.count(F.lit(1)).alias("n_tiles"))


def grid_phase(rows: DataFrame, key: str, column: str, energy: str, period: int = 8) -> DataFrame:
    """Energy by position modulo ``period``, the strongest phase and its ratio to the mean of all."""
    phase = rows.groupBy(key, F.pmod(F.col(column), F.lit(period)).alias("phase")).agg(F.sum(energy).alias("e"))
    return phase.groupBy(key).agg(F.max_by("phase", F.struct("e", (-F.col("phase")).alias("p"))).alias("phase"), (F.max("e") / F.avg("e")).alias("ratio"))


def forward_filled(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Missing values take the last one seen before."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
