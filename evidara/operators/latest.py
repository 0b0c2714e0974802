"""Newest rows of append-only tables, pivots of them, trails and first-seen rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.operators.skew import salted_join


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` (NULL lowest) of each key; name a unique column last to make it exact.

    max_by over a struct aggregates in each task first, so that a key with very many rows costs no sort.
    """
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    newest = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("row"))
    return newest.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rows.columns if c not in keys])


def stage_pivot(rows: DataFrame, key: str, kind: str, kinds: list[str], value: str, order: list[str]) -> DataFrame:
    """One row a key with the newest value of each kind; NULL: never run."""
    return latest_per_key(rows, [key, kind], order).groupBy(key).pivot(kind, kinds).agg(F.first(value))


def trail(rows: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The last n rows of each key, oldest first by position, and whether older ones were left out."""
    newest = Window.partitionBy(key).orderBy(F.col(seq).desc())
    last = rows.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n + 1)
    cut = Window.partitionBy(key)
    flagged = last.withColumn("truncated", F.max("back").over(cut) > n).filter(F.col("back") <= n)
    return flagged.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(seq))).drop("back")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Ordered dedup: the first row of each key wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def earliest_with_ties(rows: DataFrame, group: str, ts: str, generation: str, item: str, unit: str = "second") -> DataFrame:
    """Per group all instances of its earliest time (cut to ``unit``), one row each: group, item, earliest, n_tied, is_tied.

    ``earliest`` is the first of them by (generation or 99, id).  A group may have any number of ties.
    """
    dated = rows.filter(F.col(ts).isNotNull()).select(group, item, F.date_trunc(unit, ts).alias("_at"), F.coalesce(generation, F.lit(99)).alias("_g"))
    at = dated.groupBy(group, "_at").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_g", F.col(item).alias("i"))).alias("first"))
    first = at.groupBy(group).agg(F.min(F.struct("_at", "n", "first")).alias("x")).select(group, F.col("x._at").alias("_first_at"), F.col("x.first.i").alias("earliest"), F.col("x.n").alias("n_tied"))
    tied = salted_join(dated, first, [group], F.col(item)).filter(F.col("_at") == F.col("_first_at"))
    return tied.select(group, item, "earliest", F.col("_at").alias("earliest_at"), "n_tied", (F.col("n_tied") > 1).alias("is_tied"))
