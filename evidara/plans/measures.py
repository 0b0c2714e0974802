"""Classifier metrics, latencies, sample windows and residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import evaluation, windows
from evidara.sources.tables import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a made-up score and abstentions."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    score = (F.col("doc_id") * 31 % 89 + F.col("quality") * 20) / 128
    return rows.select("doc_id", F.col("lang").alias("modality"), F.col("quality").alias("label"), score.alias("score"), (F.col("doc_id") % 9 == 0).alias("abstained"))


def auc_ranksum(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(_scored(spark, d)).select(F.round("auc", 9).alias("auc"))


def eer_gap(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.eer(_scored(spark, d)).select(F.round("eer_gap", 9).alias("eer_gap"), F.round("eer", 9).alias("eer"))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.confusion(_scored(spark, d), ["modality"])
    return out.select("modality", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("abstention_rate", "accuracy", "precision", "recall", "f1")])


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latency(table(spark, d, "events"), "value").select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    w = windows.tumbling(e, "event_type", "event_id", 645, 100, "value")
    return w.select("event_type", "win", "n", F.round("score", 6).alias("score"))


def suspicious_segments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    w = windows.segments(windows.tumbling(e, "event_type", "event_id", 50, 5, "v"), 50, 16000, 3000)
    return w.select("event_type", "start_ms", "end_ms", F.round("score", 4).alias("score"))


def residual_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = windows.residual_outliers(rows, "l_returnflag", "l_quantity", "l_extendedprice", 1.1)
    return out.select("l_returnflag", "n_tiles", "n_outliers", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), F.round("mad", 2).alias("mad"), F.round("p99", 2).alias("p99"))


def grid_phase(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_linestatus", F.col("l_partkey").cast("long").alias("x"), F.col("l_quantity"))
    return windows.grid_phase(rows, "l_linestatus", "x", "l_quantity").select("l_linestatus", F.col("phase").cast("long").alias("phase"), F.round("ratio", 9).alias("ratio"))


_S = "sc AS (SELECT doc_id, lang AS modality, quality AS label, CAST(doc_id * 31 % 89 + quality * 20 AS DOUBLE) / 128 AS score, doc_id % 9 = 0 AS abstained FROM labels JOIN documents USING (doc_id))"

QUERIES = {
    "auc_ranksum": (
        auc_ranksum,
        f"WITH {_S}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM sc) SELECT round((sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 9) AS auc FROM r",
    ),
    "eer_gap": (
        eer_gap,
        f"""WITH {_S}, t AS (SELECT unnest(range(0, 200)) AS i), g AS (SELECT i, avg(CASE WHEN score * 199 + 1e-9 >= i THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE label = 0) AS far, avg(CASE WHEN score * 199 + 1e-9 < i THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE label = 1) AS frr FROM sc, t GROUP BY i)
SELECT round(min(abs(far - frr)), 9) AS eer_gap, round(arg_min((far + frr) / 2, abs(far - frr) * 1000000 + i / 1000.0::DOUBLE), 9) AS eer FROM g""",
    ),
    "confusion_metrics": (
        confusion_metrics,
        f"""WITH {_S}, p AS (SELECT modality, label = 1 AS r, CASE WHEN abstained THEN 0.5::DOUBLE ELSE score END >= 0.5::DOUBLE AS u, abstained FROM sc),
c AS (SELECT modality, count(*) FILTER (WHERE u AND r) AS tp, count(*) FILTER (WHERE u AND NOT r) AS fp, count(*) FILTER (WHERE NOT u AND NOT r) AS tn, count(*) FILTER (WHERE NOT u AND r) AS fn, avg(CAST(abstained AS DOUBLE)) AS ab FROM p GROUP BY modality)
SELECT modality, tp, fp, tn, fn, round(ab, 9) AS abstention_rate, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 9) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""",
    ),
    "latency_percentiles": (latency_percentiles, "SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events"),
    "tumbling_windows": (tumbling_windows, "SELECT event_type, event_id // 645 AS win, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1, 2 HAVING count(*) >= 100"),
    "suspicious_segments": (
        suspicious_segments,
        "SELECT event_type, win * 50 * 1000 // 16000 AS start_ms, (win + 1) * 50 * 1000 // 16000 AS end_ms, round(score, 4) AS score FROM (SELECT event_type, event_id // 50 AS win, avg(CAST(round(value * 100) AS BIGINT)) AS score FROM events GROUP BY 1, 2 HAVING count(*) >= 5) WHERE score > 3000",
    ),
    "residual_outliers": (
        residual_outliers,
        """WITH l AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1),
r AS (SELECT l_returnflag, l_extendedprice - s * l_quantity - i AS r, s, r2 FROM lineitem JOIN l USING (l_returnflag)), m AS (SELECT l_returnflag, median(r) AS m FROM r GROUP BY 1),
dv AS (SELECT l_returnflag, abs(r - m) AS dev, s, r2 FROM r JOIN m USING (l_returnflag)), md AS (SELECT l_returnflag, median(dev) AS mad FROM dv GROUP BY 1),
pc AS (SELECT l_returnflag, quantile_cont(abs(r), 0.99) AS p99 FROM r GROUP BY 1)
SELECT l_returnflag, count(*) AS n_tiles, count(*) FILTER (WHERE 0.6745::DOUBLE * dev / mad > 1.1::DOUBLE) AS n_outliers, round(any_value(s), 4) AS slope, round(any_value(r2), 6) AS r2, round(any_value(mad), 2) AS mad, round(any_value(p99), 2) AS p99
FROM dv JOIN md USING (l_returnflag) JOIN pc USING (l_returnflag) GROUP BY l_returnflag""",
    ),
    "grid_phase": (
        grid_phase,
        "WITH p AS (SELECT l_linestatus, l_partkey % 8 AS ph, sum(l_quantity) AS e FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, arg_max(ph, e) AS phase, round(max(e) / avg(e), 9) AS ratio FROM p GROUP BY 1",
    ),
}
