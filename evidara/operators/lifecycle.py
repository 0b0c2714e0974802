"""Changes to stored tables: ingestion, updates, deletion, integrity gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(files: DataFrame, stored: DataFrame, scope: list[str], order: str = "path") -> DataFrame:
    """Files whose digest is not stored in the scope yet, one of each digest; scope [] compares with everything."""
    from evidara.operators.latest import first_per_key

    keys = [*scope, "sha256"]
    return first_per_key(files, keys, [order]).join(stored.select(*keys).distinct(), keys, "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with every non-NULL change put in, and ``changed``, the names of fields that got another value."""
    fields = [c for c in changes.columns if c != key]
    both = rows.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    names = F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)), c) for c in fields]))
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns], names.alias("changed"))


def deleted(tables: dict[str, DataFrame], keys: DataFrame, key: str, kept: tuple[str, ...] = ("audit_log",)) -> dict[str, DataFrame]:
    """All tables without the rows of the keys; kept ones stay whole."""
    return {name: rows if name in kept else rows.join(keys.select(key), key, "left_anti") for name, rows in tables.items()}


def rehashed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """id, intact: the file's digest is the stored one; NULL where there is no file."""
    return stored.select("id", "path", F.col("sha256").alias("_want")).join(files.select("path", "sha256"), "path", "left").select("id", F.when(F.col("sha256").isNotNull(), F.col("sha256") == F.col("_want")).alias("intact"))


def gated(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be analysed, rows refused because their bytes changed or are gone)."""
    return checked.filter("intact"), checked.filter("intact is null or not intact")
