"""Occurrences on the web: domains, ordered dedup by address and ranks of match types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.files import domain
from evidara.operators.latest import first_per_key

#: Order of match types in a listing, and of categories when one address comes up twice.  Fixed values.
TYPES = ("EXACT", "NEAR", "SIMILAR", "PAGE_ONLY")
CATEGORIES = ("full", "partial", "page", "similar")


def match_type(distance: Column, cosine: Column) -> Column:
    """EXACT at 0 bits, or within 2 if the vectors agree; NEAR, SIMILAR, else PAGE_ONLY."""
    return F.when((distance == 0) | ((distance <= 2) & (cosine >= 0.98)), "EXACT").when((distance <= 12) | (cosine >= 0.85), "NEAR").when((cosine >= 0.70) | (distance <= 20), "SIMILAR").otherwise("PAGE_ONLY")


def fallback_type(category: Column) -> Column:
    """What an occurrence is taken for while nothing was measured."""
    return F.when(category == "full", "NEAR").when(category.isin("partial", "similar"), "SIMILAR").otherwise("PAGE_ONLY")


def occurrences(rows: DataFrame) -> DataFrame:
    """url, category, position and measures of hits: one row an address, the first category and position winning."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return first_per_key(rows.withColumn("domain", domain(F.col("url"))), ["url"], [rank, F.col("position")])


def ordered(rows: DataFrame) -> DataFrame:
    """By type, similarity (best first), date (undated last), address."""
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("match_type"))
    return rows.orderBy(rank, F.col("similarity").desc_nulls_last(), F.coalesce("published", F.lit("9999-99-99")), "url")


def replayed(events: DataFrame, ttl_seconds: float, cacheable: tuple[str, ...] = ("SUCCESS", "NO_RESULTS")) -> DataFrame:
    """Of each request the result that a cache with expiry had for it: key, id, hit, result_id.

    ``events`` has key, id, at, kind (REQUEST or RESULT) and status.  The newest result of a finished search before a request (of the
    same moment counts, ties by id) is a hit if it isn't older than ``ttl_seconds`` (0: never too old).
    """
    events = events.withColumn("at", F.col("at").cast("timestamp"))
    good = (F.col("kind") == "RESULT") & F.col("status").isin(*cacheable)
    before = Window.partitionBy("key").orderBy("at", F.when(F.col("kind") == "RESULT", 0).otherwise(1), "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(good, F.struct("at", "id")), ignorenulls=True).over(before)
    asked = events.withColumn("_last", last).filter("kind = 'REQUEST'")
    age = F.unix_micros("at") - F.unix_micros("_last.at")
    hit = F.col("_last").isNotNull() & (F.lit(ttl_seconds <= 0) | (age <= int(ttl_seconds * 1_000_000)))
    return asked.select("key", "id", hit.alias("hit"), F.when(hit, F.col("_last.id")).alias("result_id"))
