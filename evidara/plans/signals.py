"""Signal fusion, assessment and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import alerts, fusion
from evidara.sources.tables import table


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of documents: labels measure some of them, the rest is unavailable; a few are broken on purpose."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    item = F.col("doc_id").cast("string").alias("evidence_id")
    media = F.when(F.col("doc_id") % 11 == 0, "audio").when(F.col("doc_id") % 5 == 0, "video").otherwise("image").alias("media_type")
    key = F.col("doc_id")
    ai = F.when(key % 13 == 0, F.lit(float("nan"))).otherwise((key * 37 % 101) / 100)
    c2pa = (key * 53 % 97) / 96
    parts = [
        ("ai_detection", ai, F.when(F.col("toxic").isNull(), F.when(key % 3 == 0, "INCONCLUSIVE").otherwise("UNAVAILABLE")).otherwise("OK"), F.lit("DECISIVE")),
        ("perceptual_duplication", F.least(F.col("n_chars") / 10000, F.lit(0.6)), F.lit("OK"), F.lit("DESCRIPTIVE")),
        ("metadata_integrity", F.col("quality") * 0.25, F.when(F.col("quality").isNull(), "INCONCLUSIVE").otherwise("OK"), F.lit("DESCRIPTIVE")),
        ("provenance_c2pa", c2pa, F.when(key % 4 == 0, "OK").when(key % 4 == 1, "ERROR").otherwise("INCONCLUSIVE"), F.when(key % 8 == 0, "DECISIVE").otherwise("DESCRIPTIVE")),
    ]
    out = None
    for name, score, status, role in parts:
        ran = F.when((status == "INCONCLUSIVE") & F.lit(name == "provenance_c2pa"), "UNAVAILABLE").cast("string")
        one = docs.select(item, media, F.lit(name).alias("signal_id"), F.when(status == "OK", score).alias("score"), status.alias("status"), role.alias("role"), ran.alias("execution_status"))
        out = one if out is None else out.unionByName(one)
    return fusion.build_signals(docs.select(item, media), out)


def signal_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.contributions(signals(spark, d))


def assessment_state(spark: SparkSession, d: str) -> DataFrame:
    return fusion.assess(signals(spark, d)).withColumn("score", F.round("score", 6))


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    a = fusion.assess(signals(spark, d))
    return a.groupBy("state", "verdict", "execution_status", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("coverage") < fusion.COVERAGE).alias("n_below"))


def leading_contributor(spark: SparkSession, d: str) -> DataFrame:
    return fusion.leading_contributor(fusion.contributions(signals(spark, d)))


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    verdicts = e.filter("event_type = 'error' and value > 25").select(F.col("event_id").alias("item"), F.when(F.col("value") > 50, "MANIPULATED").otherwise("INSUFFICIENT_EVIDENCE").alias("verdict"), F.col("ts").alias("created_at"))
    states = e.filter("event_type = 'signup'").select(F.col("event_id").alias("item"), F.when(F.col("event_id") % 31 == 0, "INVALID").when(F.col("event_id") % 3 == 0, "VERIFIED").otherwise("ABSENT").alias("state"), (F.col("event_id") % 29 == 0).alias("generative"), F.col("ts").alias("created_at"))
    matches = e.filter("event_type = 'view'").select(F.col("user_id").alias("query"), (F.col("event_id") % 40).cast("int").alias("distance"), F.when(F.col("event_id") % 40 <= 6, "strong").otherwise("possible").alias("band"), F.col("ts").alias("created_at"))
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "CHAIN_VERIFIED").otherwise("OTHER").alias("event"), (F.col("value") < 0).alias("valid"), F.col("ts").alias("created_at"))
    pending, indexed = e.filter("event_id % 50 = 1").agg(F.count(F.lit(1)).alias("n")), e.agg(F.count(F.lit(1)).alias("n"))
    return alerts.feed(alerts.verdict_alerts(verdicts), alerts.provenance_alerts(states), alerts.near_duplicate_alerts(matches), alerts.audit_alerts(log), alerts.capability_alerts(pending, indexed))


def alert_feed(spark: SparkSession, d: str) -> DataFrame:
    """High and medium alerts, the second hundred."""
    some = _alerts(spark, d).filter(F.col("severity").isin("critical", "high", "medium"))
    return alerts.ordered(some).offset(100).limit(100)


def alert_counts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.counts(_alerts(spark, d))


_SIGNALS_SQL = """d AS (SELECT doc_id AS k, n_chars, quality, toxic, CASE WHEN doc_id % 11 = 0 THEN 'audio' WHEN doc_id % 5 = 0 THEN 'video' ELSE 'image' END AS media FROM documents LEFT JOIN labels USING (doc_id)),
w(signal_id, weight, video, audio) AS (VALUES ('ai_detection', 0.35::DOUBLE, true, true), ('perceptual_duplication', 0.20::DOUBLE, false, false), ('metadata_integrity', 0.20::DOUBLE, true, false), ('provenance_c2pa', 0.15::DOUBLE, true, false), ('compression_forensics', 0.10::DOUBLE, false, false)),
raw AS (SELECT k, w.signal_id, weight,
  CASE signal_id WHEN 'ai_detection' THEN CASE WHEN toxic IS NOT NULL THEN 'OK' WHEN k % 3 = 0 THEN 'INCONCLUSIVE' ELSE 'UNAVAILABLE' END WHEN 'perceptual_duplication' THEN 'OK'
    WHEN 'metadata_integrity' THEN CASE WHEN quality IS NULL THEN 'INCONCLUSIVE' ELSE 'OK' END WHEN 'provenance_c2pa' THEN CASE k % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'ERROR' ELSE 'INCONCLUSIVE' END ELSE 'UNAVAILABLE' END AS status,
  CASE signal_id WHEN 'ai_detection' THEN CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k * 37 % 101 AS DOUBLE) / 100 END WHEN 'perceptual_duplication' THEN least(CAST(n_chars AS DOUBLE) / 10000, 0.6::DOUBLE)
    WHEN 'metadata_integrity' THEN quality * 0.25::DOUBLE WHEN 'provenance_c2pa' THEN CAST(k * 53 % 97 AS DOUBLE) / 96 END AS s,
  signal_id = 'ai_detection' OR (signal_id = 'provenance_c2pa' AND k % 8 = 0) AS decisive
  FROM d JOIN w ON media = 'image' OR (media = 'video' AND video) OR (media = 'audio' AND audio)),
sig AS (SELECT *, CASE WHEN status = 'OK' AND s BETWEEN 0 AND 1 THEN s END AS u, signal_id IN ('ai_detection', 'provenance_c2pa') AS eligible,
  CASE WHEN signal_id = 'provenance_c2pa' AND status = 'INCONCLUSIVE' THEN 'UNAVAILABLE' WHEN status = 'OK' THEN 'COMPLETED' WHEN status = 'INCONCLUSIVE' THEN 'ABSTAINED' WHEN status = 'ERROR' THEN 'FAILED' ELSE 'UNAVAILABLE' END AS ran FROM raw),
m AS (SELECT *, status = 'OK' AND u IS NOT NULL AS measured, eligible AND decisive AND ran = 'COMPLETED' AND u IS NOT NULL AS c FROM sig),
sums AS (SELECT k, sum(weight) FILTER (WHERE eligible) AS ew, coalesce(sum(weight) FILTER (WHERE c), 0) AS cw, sum(weight * u) FILTER (WHERE c) AS ws, sum(weight) AS dw, coalesce(sum(weight) FILTER (WHERE measured), 0) AS mw,
  count(*) FILTER (WHERE c) AS n_c, count(*) FILTER (WHERE measured) AS n_m, count(*) FILTER (WHERE status <> 'UNAVAILABLE') AS n_e, count(*) AS n,
  count(*) FILTER (WHERE c AND u >= 0.65) AS up, count(*) FILTER (WHERE c AND u <= 0.35) AS down, count(*) FILTER (WHERE ran = 'FAILED') AS failed,
  count(*) FILTER (WHERE eligible AND NOT c AND (decisive OR ran <> 'COMPLETED') AND ran = 'ABSTAINED') AS ab, count(*) FILTER (WHERE eligible AND NOT c AND (decisive OR ran <> 'COMPLETED') AND ran = 'FAILED') AS fe,
  count(*) FILTER (WHERE eligible AND NOT c AND (decisive OR ran <> 'COMPLETED') AND ran NOT IN ('ABSTAINED', 'FAILED')) AS mi FROM m GROUP BY k),
cov AS (SELECT *, round(cw / ew, 6) AS coverage FROM sums),
st AS (SELECT *, CASE WHEN n_c = 0 THEN CASE WHEN ab > 0 THEN 'INCONCLUSIVE' ELSE 'NOT_ASSESSED' END WHEN coverage < 0.30 THEN 'NOT_ASSESSED' WHEN up > 0 AND down > 0 THEN 'INCONCLUSIVE'
  WHEN up > 0 THEN 'INDICATORS_DETECTED' WHEN down > 0 THEN 'NO_INDICATORS_DETECTED' ELSE 'INCONCLUSIVE' END AS state, CASE WHEN n_c > 0 AND coverage >= 0.30 THEN ws / cw END AS score,
  concat_ws(',', CASE WHEN ab > 0 THEN 'DETECTOR_ABSTAINED' END, CASE WHEN fe > 0 THEN 'PROCESSING_FAILURE' END, CASE WHEN mi > 0 THEN 'DETECTOR_UNAVAILABLE' END) AS lack FROM cov),
a AS (SELECT CAST(k AS VARCHAR) AS evidence_id, coverage, round(mw / dw, 6) AS signal_coverage, state, score,
  CASE WHEN n_c = 0 AND ab > 0 THEN lack WHEN n_c = 0 OR coverage < 0.30 THEN concat_ws(',', nullif(lack, ''), 'INSUFFICIENT_ELIGIBLE_EVIDENCE')
    ELSE concat_ws(',', CASE WHEN up > 0 AND down > 0 THEN 'CONFLICTING_RESULTS' WHEN up > 0 THEN 'ABOVE_THRESHOLD' WHEN down > 0 THEN 'BELOW_THRESHOLD' ELSE 'INTERMEDIATE_SCORE' END, nullif(lack, '')) END AS reasons,
  CASE state WHEN 'INDICATORS_DETECTED' THEN 'MANIPULATED' WHEN 'NO_INDICATORS_DETECTED' THEN 'AUTHENTIC' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict,
  CASE WHEN failed = 0 THEN 'COMPLETED' WHEN failed = n THEN 'FAILED' ELSE 'PARTIAL' END AS execution_status,
  CASE WHEN state NOT IN ('INDICATORS_DETECTED', 'NO_INDICATORS_DETECTED') THEN 'none' WHEN coverage >= 0.70 AND least(abs(score - 0.65::DOUBLE), abs(score - 0.35::DOUBLE)) >= 0.15::DOUBLE THEN 'moderate' ELSE 'low' END AS confidence,
  n AS signals_total, n_c AS signals_available, n_m AS signals_measured, n_e AS signals_evaluated FROM st),
share AS (SELECT CAST(k AS VARCHAR) AS evidence_id, signal_id, weight, measured, c AS included, CASE WHEN c THEN round(weight / sum(weight) FILTER (WHERE c) OVER (PARTITION BY k), 6) ELSE 0 END AS effective_weight, u FROM m)"""

_ALERTS_SQL = """al AS (
SELECT 'verdict' AS category, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity, CASE WHEN value > 50 THEN 'Verdict MANIPULATED' ELSE 'Verdict INSUFFICIENT_EVIDENCE' END AS title, event_id AS item, ts AS observed_at FROM events WHERE event_type = 'error' AND value > 25
UNION ALL SELECT 'provenance', 'high', CASE WHEN event_id % 31 = 0 THEN 'Provenance INVALID' ELSE 'Provenance VERIFIED' END, event_id, ts FROM events WHERE event_type = 'signup' AND (event_id % 31 = 0 OR (event_id % 3 = 0 AND event_id % 29 = 0))
UNION ALL SELECT 'near_duplicate', 'medium', count(*) || ' strong candidates, nearest at ' || min(event_id % 40), user_id, max(ts) FROM events WHERE event_type = 'view' AND event_id % 40 <= 6 GROUP BY user_id
UNION ALL SELECT 'audit', 'critical', 'Chain verification failed', max(event_id), arg_max(ts, event_id) FROM events WHERE event_type = 'purchase' HAVING arg_max(value, event_id) >= 0
UNION ALL SELECT 'capability', 'medium', count(*) || ' items wait for the index', NULL, NULL FROM events WHERE event_id % 50 = 1 HAVING count(*) > 0),
ranked AS (SELECT *, CAST(list_position(['critical', 'high', 'medium', 'low'], severity) AS INTEGER) AS rank FROM al)"""

QUERIES = {
    "signal_fusion": (signal_fusion, f"WITH {_SIGNALS_SQL} SELECT evidence_id, signal_id, weight, measured, included, CAST(effective_weight AS DOUBLE) AS effective_weight, CASE WHEN included THEN round(u * effective_weight, 6) END AS contribution FROM share"),
    "assessment_state": (assessment_state, f"WITH {_SIGNALS_SQL} SELECT * REPLACE (round(score, 6) AS score) FROM a"),
    "coverage_gate": (coverage_gate, f"WITH {_SIGNALS_SQL} SELECT state, verdict, execution_status, confidence, count(*) AS n, count(*) FILTER (WHERE coverage < 0.30) AS n_below FROM a GROUP BY ALL"),
    "leading_contributor": (
        leading_contributor,
        f"WITH {_SIGNALS_SQL}, l AS (SELECT evidence_id, signal_id, round(u * effective_weight, 6) AS contribution FROM share WHERE included) SELECT evidence_id, signal_id, contribution FROM l QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY contribution DESC, signal_id) = 1",
    ),
    "alert_feed": (alert_feed, f"WITH {_ALERTS_SQL} SELECT * FROM ranked WHERE severity IN ('critical', 'high', 'medium') ORDER BY rank, observed_at NULLS FIRST, category, item LIMIT 100 OFFSET 100"),
    "alert_counts": (
        alert_counts,
        f"WITH {_ALERTS_SQL} SELECT 'severity' AS kind, k.s AS value, count(al.severity) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS s) k LEFT JOIN al ON al.severity = k.s GROUP BY k.s UNION ALL SELECT 'category', category, count(*) FROM al GROUP BY category",
    ),
}
