"""Reports, status pages and the impact of a deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import files, scores
from evidara.operators import chain, evaluation, latest, listing, reports
from evidara.plans.cases import _LOG_SQL, EVENT_KINDS, _log
from evidara.plans.graphs import _M, _N, _matches, _nodes
from evidara.plans.measures import _S, _scored
from evidara.sources.tables import table

TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")


def report_first_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return reports.first_rows(e, "user_id", "event_type", [F.col("event_id")])


def report_readiness(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return reports.readiness(cases, "id", table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")))


def report_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of all cases and of one."""
    rows = table(spark, d, "orders")
    whole = reports.count_reports(rows, "o_custkey").withColumn("scope", F.lit("all"))
    return whole.unionByName(reports.count_reports(rows, "o_custkey", 1).withColumn("scope", F.lit("case 1")))


def report_library(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    found = reports.library(rows, ["c_name", "o_orderpriority"], "HIGH", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 60, 20)
    return found.select("o_orderkey", "c_name", "o_orderpriority", "total", "truncated")


def contribution_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return reports.by_contribution(rows, "l_orderkey", "l_extendedprice", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("position").cast("long").alias("position"))


def generation_lanes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select(F.expr("id div 1000").alias("conv_id"), "generation")
    return reports.lanes(n, "conv_id", "generation").select("conv_id", F.array_join("lanes", ",").alias("lanes"))


def activation_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") * 10).cast("double").alias("activation"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("region"))
    return reports.regions(rows, "l_suppkey", "activation", "region").select("l_suppkey", "region", F.col("position").cast("long").alias("position"))


def owned_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_replace("url", "^https?:/", "").alias("path"))
    return reports.owned_files(p.withColumn("path", F.regexp_replace("path", "/[a-z]{2}/[^/]*$", "/x")), "path", "/")


def url_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate addresses of a page in order, none twice."""
    plain = F.regexp_replace("url", "[?#].*$", "")
    found = F.array_distinct(F.array("url", plain, F.regexp_replace(plain, "/$", "")))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.element_at(found, -1).alias("last"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return reports.index_status(index, table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


def system_status(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in TABLES:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("state", F.when(F.col("n_rows") > 0, "READY").otherwise("EMPTY"))


def signal_table(spark: SparkSession, d: str) -> DataFrame:
    """Each signal with how often it was measured, by whom most recently, and its range."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("value").alias("n_measured"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("user_id", F.struct("ts", "event_id")).alias("newest_user"))


def evidence_detail(spark: SparkSession, d: str) -> DataFrame:
    """Per item its newest result of each stage, the number of results and their time span."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    stages = latest.stage_pivot(e, "user_id", "event_type", EVENT_KINDS, "value", ["ts", "event_id"])
    span = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(files.iso_seconds(F.col("ts"))).alias("first_at"), F.max(files.iso_seconds(F.col("ts"))).alias("last_at"))
    return span.join(stages, "user_id").fillna(-1.0, EVENT_KINDS)


def audit_page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id")
    return listing.counted_page(e, [F.col("event_id").desc()], 25, 5)


def deletion_impact(spark: SparkSession, d: str) -> DataFrame:
    """The seven counts of what goes with the fifth conversation, among them matches of others and detached turns."""
    n = _nodes(spark, d).withColumn("case", F.expr("id div 1000"))
    gone = n.filter("case = 4")
    hits = reports.match_impact(_matches(spark, d), gone, "id")
    orders = table(spark, d, "orders").filter("o_custkey = 4")
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    lines = table(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    audit = table(spark, d, "events").filter("user_id = 4")
    detached = n.filter("case <> 4").join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return count(gone, "n_evidence").join(hits).join(count(orders, "n_reports")).join(count(lines, "n_files")).join(count(audit, "n_audit_kept")).join(count(detached, "n_detached"))


def chain_heads(spark: SparkSession, d: str) -> DataFrame:
    """Per case the number of its rows, the first invalid one and the head's hash."""
    log = _log(spark, d)
    bad = ~(F.col("content_ok") & F.col("link_ok"))
    checked = chain.link_check(log, chain="user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.when(bad, F.col("seq"))).cast("string").alias("first_invalid"))
    return checked.join(log.groupBy("user_id").agg(F.max_by("row_hash", "seq").alias("head_hash")), "user_id")


def modality_auc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve per modality; a modality of one class has none."""
    rows = _scored(spark, d)
    return evaluation.auc(rows, "modality").select("modality", scores.plain_text(F.round("auc", 9)).alias("auc"))


def modality_eer(spark: SparkSession, d: str) -> DataFrame:
    """Equal error rate per modality; a modality of one class has none."""
    return evaluation.eer(_scored(spark, d), by="modality").select("modality", scores.plain_text(F.round("eer_gap", 9)).alias("eer_gap"), scores.plain_text(F.round("eer", 9)).alias("eer"))


QUERIES = {
    "report_first_rows": (report_first_rows, "SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS position FROM events QUALIFY position <= 8"),
    "report_readiness": (
        report_readiness,
        """SELECT c_custkey AS id, coalesce(e.n, 0) AS n_evidence, coalesce(r.n, 0) AS n_examined, CASE WHEN coalesce(e.n, 0) = 0 THEN 'empty' WHEN coalesce(r.n, 0) = 0 THEN 'refused' ELSE 'ready' END AS status FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) e ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) r ON user_id = c_custkey""",
    ),
    "report_counts": (report_counts, "SELECT count(*) AS n_reports, 'all' AS scope FROM orders UNION ALL SELECT count(*), 'case 1' FROM orders WHERE o_custkey = 1"),
    "report_library": (
        report_library,
        """WITH r AS (SELECT o_orderkey, c_name, o_orderpriority, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name ILIKE '%high%' OR o_orderpriority ILIKE '%high%')
SELECT o_orderkey, c_name, o_orderpriority, (SELECT count(*) FROM r) AS total, 80 < (SELECT count(*) FROM r) AS truncated FROM r ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 60 OFFSET 20""",
    ),
    "contribution_order": (contribution_order, "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) AS position FROM lineitem"),
    "generation_lanes": (generation_lanes, "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS lanes FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id"),
    "activation_regions": (
        activation_regions,
        "SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS region, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_discount * 10 AS DOUBLE) DESC, l_orderkey * 8 + l_linenumber) AS position FROM lineitem WHERE CAST(l_discount * 10 AS DOUBLE) > 0.5 QUALIFY position <= 5",
    ),
    "owned_files": (owned_files, "SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?:/', ''), '/[a-z]{2}/[^/]*$', '/x') AS path FROM pages WHERE regexp_replace(url, '^https?:/', '') LIKE '/%' AND NOT regexp_matches(regexp_replace(regexp_replace(url, '^https?:/', ''), '/[a-z]{2}/[^/]*$', '/x'), '(^|/)[.][.](/|$)')"),
    "url_candidates": (
        url_candidates,
        "WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS b FROM pages), q AS (SELECT *, regexp_replace(b, '/$', '') AS c FROM p) SELECT page_id, 1 + CAST(b <> url AS BIGINT) + CAST(c <> url AND c <> b AS BIGINT) AS n, CASE WHEN c <> b THEN c ELSE b END AS last FROM q",
    ),
    "index_status": (index_status, "SELECT count(*) FILTER (WHERE vec_id IS NOT NULL AND doc_id IS NOT NULL) AS n_indexed, count(*) FILTER (WHERE vec_id IS NULL) AS n_pending, count(*) FILTER (WHERE doc_id IS NULL) AS n_stale FROM (SELECT DISTINCT vec_id FROM embeddings) FULL JOIN (SELECT DISTINCT doc_id FROM documents) ON vec_id = doc_id"),
    "system_status": (system_status, " UNION ALL ".join(f"SELECT '{t}' AS part, count(*) AS n_rows, CASE WHEN count(*) > 0 THEN 'READY' ELSE 'EMPTY' END AS state FROM {t}" for t in TABLES)),
    "signal_table": (signal_table, "SELECT event_type, count(value) AS n_measured, min(value) AS least, max(value) AS most, arg_max(user_id, (ts, event_id)) AS newest_user FROM events GROUP BY event_type"),
    "evidence_detail": (
        evidence_detail,
        """WITH n AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS n_results, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS first_at, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS last_at, """
        + ", ".join(f"coalesce((SELECT v FROM n WHERE n.user_id = e.user_id AND event_type = '{k}'), -1) AS {k}" for k in EVENT_KINDS)
        + " FROM events e GROUP BY user_id",
    ),
    "audit_page": (audit_page, "WITH r AS (SELECT event_id, user_id FROM events WHERE event_type = 'error') SELECT *, (SELECT count(*) FROM r) AS total, 30 < (SELECT count(*) FROM r) AS truncated FROM r ORDER BY event_id DESC LIMIT 25 OFFSET 5"),
    "deletion_impact": (
        deletion_impact,
        f"""WITH {_N}, {_M}, g AS (SELECT id FROM n WHERE id // 1000 = 4), o AS (SELECT o_orderkey FROM orders WHERE o_custkey = 4)
SELECT (SELECT count(*) FROM g) AS n_evidence, (SELECT count(*) FROM mt WHERE query IN (SELECT id FROM g)) AS n_own, (SELECT count(*) FROM mt WHERE query NOT IN (SELECT id FROM g) AND candidate IN (SELECT id FROM g)) AS n_foreign,
  (SELECT count(*) FROM o) AS n_reports, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) AS n_files, (SELECT count(*) FROM events WHERE user_id = 4) AS n_audit_kept,
  (SELECT count(*) FROM n WHERE id // 1000 <> 4 AND parent_id IN (SELECT id FROM g)) AS n_detached""",
    ),
    "chain_heads": (chain_heads, f"WITH RECURSIVE {_LOG_SQL} SELECT user_id, count(*) AS n_rows, CAST(min(seq) FILTER (WHERE NOT (link_ok AND content_ok)) AS VARCHAR) AS first_invalid, (SELECT arg_max(row_hash, seq) FROM log WHERE log.user_id = checked.user_id) AS head_hash FROM checked GROUP BY user_id"),
    "modality_eer": (
        modality_eer,
        f"""WITH {_S}, t AS (SELECT unnest(range(0, 200)) AS i), g AS (SELECT modality, i, avg(CASE WHEN score * 199 + 1e-9 >= i THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE label = 0) AS far, avg(CASE WHEN score * 199 + 1e-9 < i THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE label = 1) AS frr FROM sc, t GROUP BY modality, i)
SELECT modality, CAST(round(min(abs(far - frr)), 9) AS VARCHAR) AS eer_gap, CAST(round(arg_min((far + frr) / 2, abs(far - frr) * 1000000 + i / 1000.0::DOUBLE), 9) AS VARCHAR) AS eer FROM g GROUP BY modality""",
    ),
    "modality_auc": (
        modality_auc,
        f"""WITH {_S}, r AS (SELECT modality, label, rank() OVER (PARTITION BY modality ORDER BY score) + (count(*) OVER (PARTITION BY modality, score) - 1) / 2.0::DOUBLE AS rk FROM sc),
t AS (SELECT modality, sum(rk) FILTER (WHERE label = 1) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM r GROUP BY modality)
SELECT modality, CAST(CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2.0::DOUBLE) / (p * n), 9) END AS VARCHAR) AS auc FROM t""",
    ),
}
