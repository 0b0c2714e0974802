"""Counts and breakdowns for dashboards; a value that was not measured stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def literal_keys(spark: SparkSession, name: str, values: list) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def breakdown(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count of each listed value, 0 for those that don't occur; others are left out."""
    found = rows.filter(F.col(column).isin(values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return literal_keys(rows.sparkSession, column, values).join(F.broadcast(found), column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def verdict_counts(rows: DataFrame, item: str, verdict: str, order: list[str], mode: str = "current") -> DataFrame:
    """Distinct items by verdict; history counts every verdict that an item ever had, current only its newest row's."""
    from evidara.operators.latest import latest_per_key

    if mode == "current":
        rows = latest_per_key(rows.select(item, verdict, *[c for c in order if c not in (item, verdict)]), [item], order)
    return rows.filter(F.col(verdict).isNotNull()).groupBy(verdict).agg(F.countDistinct(item).alias("n_items"))


def json_average(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Mean and number of a JSON field's numbers; no samples give NULL and 0."""
    value = F.get_json_object(column, path).try_cast("double")
    return rows.agg(F.avg(value).alias("average"), F.count(value).alias("n_samples"))


def delete_impact(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Rows of each child table that go when the parents go, as kind, n_rows."""
    out = None
    keys = parent.select(key).distinct()
    for name, child in children.items():
        n = child.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("kind"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def next_sequence(*numbers: DataFrame, least: int = 1000) -> DataFrame:
    """One more than the largest number of the one-column tables, starting after ``least``."""
    out = numbers[0]
    for more in numbers[1:]:
        out = out.union(more)
    return out.toDF("n").agg((F.greatest(F.coalesce(F.max("n"), F.lit(least)), F.lit(least)) + 1).alias("next"))


def flagged_and_analysed(rows: DataFrame, item: str, verdict: str, order: list[str], flags: list[str]) -> DataFrame:
    """n_flagged: items whose newest verdict is among ``flags``; n_analysed: items with any."""
    from evidara.operators.latest import latest_per_key

    newest = latest_per_key(rows.select(item, verdict, *[c for c in order if c not in (item, verdict)]), [item], order)
    return newest.agg(F.count_if(F.col(verdict).isin(flags)).alias("n_flagged"), F.count(verdict).alias("n_analysed"))


def previews(rows: DataFrame, verdict: str, order: list[Column], flags: list[str], recent: int = 5, flagged: int = 10) -> DataFrame:
    """The newest rows and the newest flagged rows, as kind and position before the rows' own columns."""
    def top(some: DataFrame, kind: str, n: int) -> DataFrame:
        few = some.orderBy(*order).limit(n)  # so the window sees n rows
        return few.withColumn("kind", F.lit(kind)).withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(*order)))

    return top(rows, "recent", recent).unionByName(top(rows.filter(F.col(verdict).isin(flags)), "flagged", flagged))
