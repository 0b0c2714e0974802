"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are salted, the proven bound of what is broadcast, each of over so many rows, over so many tasks.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 1000, 32


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of most rows; any other key holds under a thousandth of all rows."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    return counts.orderBy(F.col("_n").desc(), *keys).limit(HOT_KEYS).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique; left's rows of hot keys are dealt over SALTS tasks by ``by``."""
    hot = hot_keys(left, keys)
    marked = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot")))

    def mark(rows: DataFrame) -> DataFrame:
        return rows.join(marked, [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left").drop(*[f"_hot_{k}" for k in keys])

    one = mark(left).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one.join(mark(right).withColumn("_salt", F.explode(every)).drop("_hot"), [*keys, "_salt"], how).drop("_salt")
