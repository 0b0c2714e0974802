"""Filtered, counted and paged listings."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_VERDICTS = ("PENDING", "NONE", "UNANALYSED", "UNANALYZED")


def check_page(limit: int, offset: int) -> None:
    """Refuses a page outside 1..500 and 0..100000."""
    if not 1 <= limit <= 500 or not 0 <= offset <= 100_000:
        raise ValueError(f"limit {limit} or offset {offset} is out of range")


def moment(text: str | None) -> datetime.datetime | None:
    """A time filter; one that can't be read is an error, never ignored."""
    if text is None:
        return None
    at = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at.astimezone(datetime.UTC).replace(tzinfo=None) if at.tzinfo else at


def contains(column: Column | str, term: str) -> Column:
    """Case-insensitive substring; % and _ in the term keep their meaning."""
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{term}%")


def any_contains(columns: list[str], term: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(contains(c, term), F.lit(False))
    return out


def status_filter(column: str, wanted: str | None, closed: str = "closed") -> Column:
    """all or none: everything; active: not closed; else equal in lower case."""
    if wanted is None or wanted.lower() == "all":
        return F.lit(True)
    return F.col(column) != closed if wanted.lower() == "active" else F.col(column) == wanted.lower()


def priority_filter(column: str, wanted: str | None) -> Column:
    """None or all: everything; else one priority or several with commas between, in lower case."""
    if wanted is None or wanted.strip().lower() in ("", "all"):
        return F.lit(True)
    return F.lower(column).isin(*[w.strip().lower() for w in wanted.split(",") if w.strip()])


def verdict_filter(column: str, wanted: str | None) -> Column:
    if wanted is None:
        return F.lit(True)
    return F.col(column).isNull() if wanted.upper() in OPEN_VERDICTS else F.col(column) == wanted.upper()


def between(column: str, after: str | None, before: str | None) -> Column:
    """Inclusive on both ends; malformed bounds raise."""
    out, low, high = F.lit(True), moment(after), moment(before)
    if low is not None:
        out = out & (F.col(column) >= F.lit(low))
    if high is not None:
        out = out & (F.col(column) <= F.lit(high))
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order; the total is that of ``rows`` and is counted before paging."""
    check_page(limit, offset)
    return rows.orderBy(*order).offset(offset).limit(limit)


def counted_page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the total of all rows and whether rows remain after it."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = page(rows, order, limit, offset).crossJoin(F.broadcast(total))  # one row
    return cut.withColumn("truncated", F.least(F.lit(offset + limit), F.col("total")) < F.col("total"))


def with_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Adds a count of each child table, one aggregate and one join each; 0 where there are none."""
    for name, (child, child_key) in children.items():
        n = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
        parents = parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def matching_or_having(parents: DataFrame, key: str, columns: list[str], child: DataFrame, child_key: str, child_columns: list[str], term: str) -> DataFrame:
    """Parents that contain the term or own a child row that does."""
    owners = child.filter(any_contains(child_columns, term)).select(F.col(child_key).alias(key)).distinct().withColumn("_owns", F.lit(True))
    return parents.join(owners, key, "left").filter(any_contains(columns, term) | F.col("_owns").isNotNull()).drop("_owns")


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none: a filter that reaches the scan."""
    return rows.filter(F.col(key) == F.lit(value))


def waits_for_index(evidence: DataFrame) -> DataFrame:
    """Items with a perceptual hash that the index doesn't have yet."""
    return evidence.filter(F.col("phash").isNotNull() & ~F.coalesce("indexed", F.lit(False)))
