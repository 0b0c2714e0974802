"""Alert feeds derived from stored results, counted before they are filtered and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def _alert(rows: DataFrame, category: str, severity: Column | str, title: Column, item: str, at: str) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(category).alias("category"), severity.alias("severity"), title.alias("title"), F.col(item).alias("item"), F.col(at).alias("observed_at"))


def coverage_alerts(results: DataFrame) -> DataFrame:
    """From item, verdict, created_at: insufficient evidence as a gap in coverage of its own category, always low."""
    return _alert(results.filter("verdict = 'INSUFFICIENT_EVIDENCE'"), "coverage", "low", F.lit("Inconclusive analysis"), "item", "created_at")


def verdict_alerts(results: DataFrame) -> DataFrame:
    """From item, verdict, created_at: manipulated is high, insufficient evidence low."""
    some = results.filter(F.col("verdict").isin("MANIPULATED", "INSUFFICIENT_EVIDENCE"))
    return _alert(some, "verdict", F.when(F.col("verdict") == "MANIPULATED", "high").otherwise("low"), F.concat(F.lit("Verdict "), "verdict"), "item", "created_at")


def provenance_alerts(results: DataFrame) -> DataFrame:
    """From item, state, generative, created_at: a broken signature, or a verified one of a generator; absence never alerts."""
    some = results.filter((F.col("state") == "INVALID") | ((F.col("state") == "VERIFIED") & F.col("generative")))
    return _alert(some, "provenance", "high", F.concat(F.lit("Provenance "), "state"), "item", "created_at")


def near_duplicate_alerts(matches: DataFrame) -> DataFrame:
    """From query, distance, band, created_at: one alert a query with a strong candidate."""
    best = matches.filter("band = 'strong'").groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance"), F.max("created_at").alias("created_at"))
    return _alert(best, "near_duplicate", "medium", F.concat(F.col("n").cast("string"), F.lit(" strong candidates, nearest at "), F.col("distance").cast("string")), "query", "created_at")


def audit_alerts(log: DataFrame) -> DataFrame:
    """From seq, event, valid, created_at: the latest verification failed, or there never was one."""
    checked = F.col("event") == "CHAIN_VERIFIED"
    last = log.agg(F.count(F.lit(1)).alias("n"), F.count_if(checked).alias("n_checked"), F.max_by(F.struct("seq", "valid", "created_at"), F.when(checked, F.col("seq"))).alias("last"), F.max("created_at").alias("at"))
    some = last.filter((F.col("n") > 0) & ((F.col("n_checked") == 0) | ~F.col("last.valid")))
    rows = some.select(F.when(F.col("n_checked") == 0, F.lit("low")).otherwise("critical").alias("s"), F.col("last.seq").alias("item"), F.coalesce("last.created_at", "at").alias("created_at"))
    return _alert(rows, "audit", F.col("s"), F.when(F.col("s") == "low", "Chain never verified").otherwise("Chain verification failed"), "item", "created_at")


def capability_alerts(n_pending: DataFrame, n_indexed: DataFrame) -> DataFrame:
    """Pending index entries are medium, else an empty index is low; both inputs are one-row counts n."""
    both = n_pending.select(F.col("n").alias("pending")).join(F.broadcast(n_indexed.select(F.col("n").alias("indexed"))))
    some = both.filter("pending > 0 or indexed = 0").withColumn("item", F.lit(None).cast("long")).withColumn("created_at", F.lit(None).cast("timestamp"))
    return _alert(some, "capability", F.when(F.col("pending") > 0, "medium").otherwise("low"), F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" items wait for the index"))).otherwise("The index is empty"), "item", "created_at")


def feed(*parts: DataFrame) -> DataFrame:
    """All alerts with the rank of their severity; order by rank, then time, oldest and undated first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    return out.withColumn("rank", rank)


def ordered(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("rank", F.col("observed_at").asc_nulls_first(), "category", "item")


def counts(alerts: DataFrame) -> DataFrame:
    """kind, value, n over all alerts, with 0 for severities that don't occur."""
    from evidara.operators.kpi import literal_keys

    found = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    all_of = literal_keys(alerts.sparkSession, "severity", list(SEVERITIES)).join(found, "severity", "left")
    by_severity = all_of.select(F.lit("severity").alias("kind"), F.col("severity").alias("value"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return by_severity.unionByName(alerts.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(F.lit("category").alias("kind"), F.col("category").alias("value"), "n"))
