"""Composite reads: the case list, the dashboard, pending results and the reconstruction of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import kpi, latest, lineage, listing
from evidara.plans.graphs import _M, _N, _matches, _nodes
from evidara.sources.tables import table

FLAGS = ["error"]


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The newest result of each owner's case as its verdict, and when it came."""
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.upper("event_type").alias("verdict"), "ts", "event_id")
    return latest.latest_per_key(e, ["id"], ["ts", "event_id"]).select("id", "verdict")


def _case_list(spark: SparkSession, d: str, verdict: str | None, q: str) -> DataFrame:
    """Cases with their verdict and counts, filtered by verdict and by a term in the case or its evidence."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    rows = listing.matching_or_having(cases, "id", ["c_name", "c_mktsegment"], orders, "o_custkey", ["o_orderpriority"], q)
    rows = rows.join(_verdicts(spark, d), "id", "left").filter(listing.verdict_filter("verdict", verdict))
    rows = listing.with_counts(rows, "id", {"n_evidence": (orders, "o_custkey"), "n_open": (orders.filter("o_orderstatus <> 'F'"), "o_custkey")})
    return listing.counted_page(rows, [F.col("id").desc()], 40, 10).select("id", "c_name", "verdict", "n_evidence", "n_open", "total", "truncated")


def case_list_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _case_list(spark, d, "view", "urgent")


def case_list_pending(spark: SparkSession, d: str) -> DataFrame:
    """Cases without any result."""
    return _case_list(spark, d, "PENDING", "e")


def pending_results(spark: SparkSession, d: str) -> DataFrame:
    """All cases with their stored result, and those that wait for one."""
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return cases.join(_verdicts(spark, d), "id", "left").withColumn("pending", F.col("verdict").isNull())


def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return kpi.flagged_and_analysed(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], FLAGS)


def dashboard_previews(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return kpi.previews(e, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], FLAGS).select("kind", "position", "event_id", "user_id", "event_type")


def _dated(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return n.withColumn("timestamp", F.when(F.col("id") % 5 > 0, F.timestamp_seconds(1704067200 + F.expr("id div 3"))))


def case_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """The spread of one case: the fifth conversation."""
    n = _dated(spark, d)
    case = n.filter("id div 1000 = 4").select("id", (F.col("id") % 2 == 0).alias("hashed"))
    return lineage.reconstruct(case, _matches(spark, d), n)


def origin_distances(spark: SparkSession, d: str) -> DataFrame:
    """Eligible origins of all conversations' first turns taken as one case, with their distance and similarity."""
    n, m = _dated(spark, d), _matches(spark, d)
    own = n.filter("generation = 0").select("id", (F.col("id") % 2000 == 0).alias("hashed"))
    return lineage.eligible(lineage.with_distances(n, own, m)).select("id", F.col("distance").cast("string").alias("distance"), "similarity")


_V = "v AS (SELECT user_id AS id, upper(arg_max(event_type, (ts, event_id))) AS verdict FROM events GROUP BY user_id)"
_LIST = """WITH {v}, n AS (SELECT o_custkey AS id, count(*) AS n_evidence, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_open FROM orders GROUP BY o_custkey),
r AS (SELECT c_custkey AS id, c_name, verdict, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_open, 0) AS n_open FROM customer LEFT JOIN v ON v.id = c_custkey LEFT JOIN n ON n.id = c_custkey
  WHERE {where} AND (c_name ILIKE '%{q}%' OR c_mktsegment ILIKE '%{q}%' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority ILIKE '%{q}%')))
SELECT *, (SELECT count(*) FROM r) AS total, least(50, (SELECT count(*) FROM r)) < (SELECT count(*) FROM r) AS truncated FROM r ORDER BY id DESC LIMIT 40 OFFSET 10"""
_T = "t AS (SELECT id, CASE WHEN id % 5 > 0 THEN 1704067200 + id // 3 END AS tm FROM n)"

QUERIES = {
    "case_list_by_verdict": (case_list_by_verdict, _LIST.format(v=_V, where="verdict = 'VIEW'", q="urgent")),
    "case_list_pending": (case_list_pending, _LIST.format(v=_V, where="verdict IS NULL", q="e")),
    "pending_results": (pending_results, f"WITH {_V} SELECT c_custkey AS id, verdict, verdict IS NULL AS pending FROM customer LEFT JOIN v ON v.id = c_custkey"),
    "dashboard_counts": (dashboard_counts, f"WITH {_V} SELECT count(*) FILTER (WHERE verdict = 'ERROR') AS n_flagged, count(verdict) AS n_analysed FROM v"),
    "dashboard_previews": (
        dashboard_previews,
        """SELECT * FROM (SELECT 'recent' AS kind, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position, event_id, user_id, event_type FROM events QUALIFY position <= 5)
UNION ALL SELECT * FROM (SELECT 'flagged', CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position, event_id, user_id, event_type FROM events WHERE event_type = 'error' QUALIFY position <= 10)""",
    ),
    "case_reconstruction": (
        case_reconstruction,
        f"""WITH RECURSIVE {_N}, {_M}, {_T}, own AS (SELECT id, id % 2 = 0 AS hashed FROM n WHERE id // 1000 = 4), hits AS (SELECT * FROM mt WHERE query IN (SELECT id FROM own)), hit AS (SELECT DISTINCT candidate AS id FROM hits),
g AS (SELECT DISTINCT source_id FROM n WHERE id IN (SELECT id FROM hit) AND id NOT IN (SELECT id FROM own) AND source_id IS NOT NULL),
known AS (SELECT id, 0 AS r FROM own UNION ALL SELECT id, 1 FROM hit UNION ALL SELECT id, 2 FROM n WHERE source_id IN (SELECT source_id FROM g) OR id IN (SELECT source_id FROM g)),
up(id) AS (SELECT id FROM known UNION SELECT n.parent_id FROM up JOIN n ON n.id = up.id WHERE n.parent_id IS NOT NULL),
al AS (SELECT id, min(r) AS r FROM (SELECT * FROM known UNION ALL SELECT id, 2 FROM up WHERE id IN (SELECT id FROM n)) GROUP BY id),
p AS (SELECT conv_id * 1000 + turn AS id, min(role) AS platform FROM conversations GROUP BY conv_id, turn),
held AS (SELECT n.*, platform, tm, CASE WHEN own.hashed THEN 0 ELSE (SELECT min(distance) FROM hits WHERE candidate = n.id) END AS distance
  FROM (SELECT * FROM al ORDER BY r, id LIMIT 250) al JOIN n ON n.id = al.id JOIN p ON p.id = n.id JOIN t ON t.id = n.id LEFT JOIN own ON own.id = n.id),
kept AS (SELECT * FROM held WHERE tm IS NOT NULL AND (distance IS NOT NULL OR parent_id IS NOT NULL OR generation IS NOT NULL)),
e AS (SELECT (SELECT count(*) FROM held WHERE parent_id IN (SELECT id FROM held)) + (SELECT count(*) FROM mt WHERE query IN (SELECT id FROM held) AND candidate IN (SELECT id FROM held)) AS n_edges)
SELECT count(*) AS n_nodes, coalesce(string_agg(DISTINCT platform, ',' ORDER BY platform), '') AS platforms, coalesce(string_agg(DISTINCT CAST(generation AS VARCHAR), ',' ORDER BY CAST(generation AS VARCHAR)), '') AS generations,
  (SELECT count(*) FROM al) > 250 AS truncated, any_value(n_edges) AS n_edges, (SELECT arg_min(id, (tm, coalesce(generation, 99), id)) FROM kept) AS earliest, (SELECT count(*) FROM kept WHERE tm = (SELECT min(tm) FROM kept)) AS n_tied,
  CASE WHEN count(*) = 0 THEN 'NO_EVIDENCE' WHEN any_value(n_edges) > 0 THEN 'TRACED' ELSE 'ISOLATED' END AS status FROM held, e""",
    ),
    "origin_distances": (
        origin_distances,
        f"""WITH {_N}, {_M}, {_T}, m AS (SELECT candidate AS id, min(distance) AS near FROM mt GROUP BY candidate), x AS (SELECT n.*, tm, CASE WHEN generation = 0 AND n.id % 2000 = 0 THEN 0 ELSE near END AS distance FROM n JOIN t ON t.id = n.id LEFT JOIN m ON m.id = n.id)
SELECT id, CAST(distance AS VARCHAR) AS distance, coalesce(1 - distance / 64.0::DOUBLE, 0) AS similarity FROM x WHERE tm IS NOT NULL AND (distance IS NOT NULL OR parent_id IS NOT NULL OR generation IS NOT NULL)""",
    ),
}
