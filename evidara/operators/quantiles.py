"""Exact quantiles of very many groups or very large ones, by histograms that are refined where the quantiles lie.

No key's rows meet in one task.  Rows are counted by bins that don't depend on the data (32 a power of two of the size), the
bins that hold the wanted ranks are counted again in 4,096 parts, and only the distinct values of those parts are put in
order.  Every step is a sum by key and bin, so tasks sum what they have first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.skew import salted_join
from evidara.sources.tables import durable

PER_POWER, PARTS = 32, 4096
#: Bins of -inf, inf and NaN lie beyond all others.
_FAR = 1 << 20
#: A list of wanted bins up to this many rows is broadcast; a longer one is joined by key.
BROADCAST_ROWS = 100_000


def _position(value: Column) -> Column:
    """Of a finite number other than 0 its place on the scale, growing with the size."""
    return F.log2(F.abs(value)) * PER_POWER + 2 * 1100 * PER_POWER


def _bin(value: Column) -> Column:
    size = F.floor(_position(value)).cast("int")
    far = F.abs(value) == float("inf")
    return F.when(F.isnan(value), 2 * _FAR).when(value == 0, 0).when(far, F.signum(value).cast("int") * _FAR).when(value > 0, size).otherwise(-size)


def _part(value: Column) -> Column:
    """Which of PARTS parts of its bin a value lies in, growing with the value."""
    within = F.floor((_position(value) - F.floor(_position(value))) * PARTS).cast("int")
    plain = F.isnan(value) | (value == 0) | (F.abs(value) == float("inf"))
    return F.when(plain, 0).when(value > 0, within).otherwise(PARTS - within)


def _chosen(counts: DataFrame, keys: list[str], wanted: DataFrame, by: str) -> DataFrame:
    """keys, q, rank, by: where each wanted rank lies; rank becomes the one within it."""
    upto = F.sum("n").over(Window.partitionBy(*keys, "q").orderBy(by))
    placed = counts.join(wanted, keys).withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("n"))
    inside = placed.filter((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_to")))
    return inside.select(*keys, "q", (F.col("rank") - F.col("_from")).alias("rank"), by)


def _within(rows: DataFrame, wanted: DataFrame, keys: list[str], short: bool) -> DataFrame:
    """The rows whose keys are wanted; a short list is broadcast."""
    few = wanted.select(*keys).distinct()
    if short:
        return rows.join(F.broadcast(few), keys, "left_semi")
    return salted_join(rows, few, keys, F.col("_v"), "left_semi")


def grouped_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """keys and, for each name in ``wanted``, the quantile of ``value`` interpolated between the two nearest ranks.

    NULL values don't count, NaN is the largest; a key without values is left out.  Keys may be NULL; no keys: one row.
    """
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.struct(F.col(k).alias("v")).alias(n) for k, n in zip(keys, names, strict=False)] or [F.lit(0).alias("_k0")]  # a struct is never NULL, so that NULL keys join
    base = rows.select(*named, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    binned = base.withColumn("_bin", _bin(F.col("_v")))
    counts = durable(binned.groupBy(*names, "_bin").agg(F.count(F.lit(1)).alias("n")))
    asked = [F.struct(F.lit(name).alias("name"), (p * (F.col("total") - 1)).alias("at")) for name, p in wanted.items()]
    total = counts.groupBy(*names).agg(F.sum("n").alias("total")).select(*names, F.explode(F.array(*asked)).alias("x"))
    ends = [F.struct(F.floor("x.at").alias("low"), F.lit(False).alias("upper")), F.struct(F.ceil("x.at").alias("low"), F.lit(True).alias("upper"))]
    each = total.select(*names, "x.name", "x.at", F.explode(F.array(*ends)).alias("e"))
    # q: which quantile and which of its two ranks; ranks count from 1
    ranks = each.select(*names, F.struct("name", "at", "e.upper").alias("q"), (F.col("e.low") + 1).alias("rank"))
    in_bin = durable(_chosen(counts, names, ranks, "_bin"))
    short = in_bin.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # as many rows as all lists after it
    parts = _within(binned, in_bin, [*names, "_bin"], short).withColumn("_part", _part(F.col("_v")))
    part_counts = parts.groupBy(*names, "_bin", "_part").agg(F.count(F.lit(1)).alias("n"))
    in_part = durable(_chosen(part_counts, [*names, "_bin"], in_bin, "_part"))
    values = _within(parts, in_part, [*names, "_bin", "_part"], short).groupBy(*names, "_bin", "_part", "_v").agg(F.count(F.lit(1)).alias("n"))
    found = _chosen(values, [*names, "_bin", "_part"], in_part, "_v")
    low, high = F.max(F.when(~F.col("q.upper"), F.col("_v"))), F.max(F.when(F.col("q.upper"), F.col("_v")))
    share = F.col("at") - F.floor("at")
    pairs = found.groupBy(*names, F.col("q.name").alias("name"), F.col("q.at").alias("at")).agg(low.alias("low"), high.alias("high"))
    between = pairs.withColumn("_v", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + share * (F.col("high") - F.col("low"))))
    wide = between.groupBy(*names).pivot("name", list(wanted)).agg(F.max("_v"))
    return wide.select(*[F.col(f"{n}.v").alias(k) for k, n in zip(keys, names, strict=False)], *wanted)


def with_quantiles(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``rows`` with a row a key of ``found``; broadcast where that is short, else joined with hot keys dealt out."""
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), keys)
    return salted_join(rows, found, keys, F.monotonically_increasing_id())
