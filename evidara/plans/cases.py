"""Listings, counts, newest rows, audit trails and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import files
from evidara.operators import chain, kpi, latest, listing
from evidara.sources.tables import table

EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


def case_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Open, urgent or high cases of owners in some segment, with total, second page."""
    orders = table(spark, d, "orders")
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    rows = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & listing.status_filter("o_orderstatus", "active", closed="F") & listing.between("o_orderdate", "1996-01-01", "1998-12-31T23:59:59Z")).join(owners, "o_custkey").filter(listing.contains("c_mktsegment", "build"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = listing.page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 50, 20)
    return page.join(F.broadcast(total)).select("o_orderkey", "c_name", "o_orderstatus", "o_orderpriority", "o_orderdate", "total")


def case_search(spark: SparkSession, d: str) -> DataFrame:
    """Owners that contain a term or have a case that does."""
    owners = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    found = listing.matching_or_having(owners, "c_custkey", ["c_name", "c_mktsegment"], table(spark, d, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus"], "urgent")
    return found.select("c_custkey", "c_name")


def evidence_library_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter((F.col("lang") == "en") & listing.any_contains(["text", "source"], "idiot"))
    return listing.page(docs.select("doc_id", "source", "n_chars"), [F.col("doc_id").desc()], 50)


def case_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return listing.with_counts(owners, "id", {"n_cases": (orders, "o_custkey"), "n_open": (orders.filter("o_orderstatus <> 'F'"), "o_custkey")})


def semi_pending(spark: SparkSession, d: str) -> DataFrame:
    """Cases with evidence that is not closed yet."""
    pending = table(spark, d, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(pending, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


def anti_unanalysed(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Reports with their case, if it still exists."""
    cases_ = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.join(cases_, "l_orderkey", "left").withColumn("is_orphan", F.col("o_orderdate").isNull())


def breakdown_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return kpi.breakdown(table(spark, d, "documents"), "lang", ["en", "fr", "de", "es", "it"])


def verdict_history_vs_current(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    modes = [kpi.verdict_counts(e, "user_id", "event_type", ["ts", "event_id"], m).withColumn("mode", F.lit(m)) for m in ("history", "current")]
    return modes[0].unionByName(modes[1])


def json_avg(spark: SparkSession, d: str) -> DataFrame:
    return kpi.json_average(table(spark, d, "events"), "props", "$.k").select(F.round("average", 9).alias("average"), "n_samples")


def delete_impact(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    owners = gone.select(F.col("o_custkey").alias("c_custkey")).distinct()
    touched = table(spark, d, "customer").join(owners, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("owners").alias("kind"), "n_rows")
    return kpi.delete_impact(gone, "k", {"evidence": lines, "cases": gone.select("k")}).unionByName(touched)


def next_case_number(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "customer").select(files.case_sequence(F.regexp_replace("c_name", "^Customer#", "CASE-2026-")))
    keys = table(spark, d, "orders").select(F.col("o_orderkey").cast("int"))
    return kpi.next_sequence(numbers, keys).select(F.col("next").cast("long").alias("next"))


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return latest.latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"])


def stage_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return latest.stage_pivot(e.select("user_id", "event_type", "event_id", "ts", "value"), "user_id", "event_type", EVENT_KINDS, "value", ["ts", "event_id"])


def trail_last_n(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return latest.trail(e, "user_id", "event_id", 3)


def earliest_instance_ties(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("generation", F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 4).cast("int")))
    out = latest.earliest_with_ties(e, "user_id", "ts", "generation", "event_id", unit="day")
    return out.select("user_id", "event_id", "earliest", "n_tied", "is_tied")


def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows of some actors and kinds within a time span compared as ISO strings."""
    e = table(spark, d, "events").withColumn("seen_at", files.iso_seconds(F.col("ts")))
    return e.filter(F.col("event_type").isin("error", "signup") & F.col("seen_at").between("2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z")).select("event_id", "user_id", "event_type", "seen_at")


def session_validity(spark: SparkSession, d: str) -> DataFrame:
    """Sessions (signups) within a day before a fixed moment whose user was not flagged by an error since."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    e = table(spark, d, "events")
    live = e.filter((F.col("event_type") == "signup") & (F.col("ts") <= now) & (F.col("ts") > now - F.expr("interval 24 hours")))
    revoked = e.filter((F.col("event_type") == "error") & (F.col("ts") <= now)).groupBy("user_id").agg(F.max("ts").alias("revoked_at"))
    return live.join(revoked, "user_id", "left").filter("revoked_at is null or revoked_at < ts").select("event_id", "user_id")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as one hash chain a user, then spoilt: some rows name a wrong predecessor, others were changed afterwards."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props").alias("content"))
    log = chain.relink(e, chain="user_id")
    wrong, changed = F.col("seq") % 97 == 0, F.col("seq") % 101 == 0
    log = log.withColumn("row_hash", F.when(wrong, files.row_hash(F.lit("0"), F.col("content"))).otherwise(F.col("row_hash")))
    return log.withColumn("previous_hash", F.when(wrong, "0").otherwise(F.col("previous_hash"))).withColumn("content", F.when(changed, F.concat("content", F.lit("!"))).otherwise(F.col("content")))


def chain_link_check(spark: SparkSession, d: str) -> DataFrame:
    return chain.link_check(_log(spark, d), chain="user_id")


def chain_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of each user's chain."""
    return _log(spark, d).select("seq", "previous_hash", "row_hash")


def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    return chain.summary(chain_link_check(spark, d), _log(spark, d))


def chain_forks(spark: SparkSession, d: str) -> DataFrame:
    return chain.forks(_log(spark, d)).select("seq", "n_siblings")


def chain_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """What a repair would do with each chain."""
    return chain.repair(_log(spark, d), "user_id")[1].withColumn("first_break", F.col("first_break").cast("string"))


def chain_repaired(spark: SparkSession, d: str) -> DataFrame:
    """How many rows and which head each chain has after the repair, and whether all its links hold."""
    log, found = chain.repair(_log(spark, d), "user_id", dry_run=False)
    checked = chain.link_check(log, chain="user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and("link_ok").alias("links_hold"))
    return checked.join(found.select("user_id", "status"), "user_id")


_NEWEST = "row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)"
_LOG_SQL = """base AS (SELECT user_id, event_id AS seq, event_id || '|' || event_type || '|' || props AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
h(user_id, k, seq, content, previous_hash, row_hash) AS (
  SELECT user_id, k, seq, content, repeat('0', 64), sha256(repeat('0', 64) || content) FROM base WHERE k = 1
  UNION ALL SELECT b.user_id, b.k, b.seq, b.content, h.row_hash, sha256(h.row_hash || b.content) FROM h JOIN base b ON b.user_id = h.user_id AND b.k = h.k + 1),
log AS (SELECT user_id, k, seq, CASE WHEN seq % 101 = 0 THEN content || '!' ELSE content END AS content, CASE WHEN seq % 97 = 0 THEN '0' ELSE previous_hash END AS previous_hash,
  CASE WHEN seq % 97 = 0 THEN sha256('0' || content) ELSE row_hash END AS row_hash FROM h),
checked AS (SELECT user_id, k, seq, previous_hash = coalesce(lag(row_hash) OVER (PARTITION BY user_id ORDER BY seq), repeat('0', 64)) AS link_ok, sha256(previous_hash || content) = row_hash AS content_ok FROM log),
found AS (SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE NOT content_ok) AS n_modified, min(seq) FILTER (WHERE NOT link_ok) AS first_break, max(k) - min(k) FILTER (WHERE NOT link_ok) + 1 AS later FROM checked GROUP BY user_id),
judged AS (SELECT *, CASE WHEN n_modified > 0 THEN 'refused' WHEN first_break IS NOT NULL THEN 'repairable' ELSE 'clean' END AS status FROM found)"""

QUERIES = {
    "case_list_filtered": (
        case_list_filtered,
        """WITH r AS (SELECT o_orderkey, c_name, o_orderstatus, o_orderpriority, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31 23:59:59' AND c_mktsegment ILIKE '%build%')
SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20""",
    ),
    "case_search": (case_search, "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%urgent%' OR c_mktsegment ILIKE '%urgent%' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%')"),
    "evidence_library_search": (evidence_library_search, "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND (text ILIKE '%idiot%' OR source ILIKE '%idiot%') ORDER BY doc_id DESC LIMIT 50"),
    "case_counts": (case_counts, "SELECT c_custkey AS id, count(o_orderkey) AS n_cases, count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS n_open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "semi_pending": (semi_pending, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')"),
    "anti_unanalysed": (anti_unanalysed, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)"),
    "report_rows": (report_rows, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderdate, o_orderdate IS NULL AS is_orphan FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_orderkey = l_orderkey"),
    "breakdown_zero_filled": (breakdown_zero_filled, "SELECT k.lang, count(d.lang) AS n FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS lang) k LEFT JOIN documents d ON d.lang = k.lang GROUP BY k.lang"),
    "verdict_history_vs_current": (
        verdict_history_vs_current,
        """SELECT event_type, count(DISTINCT user_id) AS n_items, 'history' AS mode FROM events GROUP BY event_type
UNION ALL SELECT event_type, count(DISTINCT user_id), 'current' FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type""",
    ),
    "json_avg": (json_avg, "SELECT round(avg(CAST(props ->> '$.k' AS DOUBLE)), 9) AS average, count(props ->> '$.k') AS n_samples FROM events"),
    "delete_impact": (
        delete_impact,
        """WITH g AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'evidence' AS kind, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM g)
UNION ALL SELECT 'cases', count(*) FROM g UNION ALL SELECT 'owners', count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM g)""",
    ),
    "next_case_number": (next_case_number, "SELECT greatest((SELECT max(CAST(substr(c_name, 10) AS BIGINT)) FROM customer), (SELECT max(o_orderkey) FROM orders), 1000) + 1 AS next"),
    "latest_per_key": (latest_per_key, f"SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, {_NEWEST} AS r FROM events) WHERE r = 1"),
    "stage_pivot": (
        stage_pivot,
        f"SELECT user_id, {', '.join(f'max(value) FILTER (WHERE event_type = {k!r}) AS {k}' for k in EVENT_KINDS)} FROM (SELECT *, {_NEWEST} AS r FROM events) WHERE r = 1 GROUP BY user_id",
    ),
    "trail_last_n": (
        trail_last_n,
        """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b, count(*) OVER (PARTITION BY user_id) > 3 AS truncated FROM events)
SELECT user_id, event_id, event_type, truncated, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS position FROM r WHERE b <= 3""",
    ),
    "earliest_instance_ties": (
        earliest_instance_ties,
        """WITH e AS (SELECT user_id, event_id, date_trunc('day', ts) AS dy, CASE WHEN event_id % 4 > 0 THEN event_id % 4 ELSE 99 END AS g FROM events),
f AS (SELECT *, min(dy) OVER (PARTITION BY user_id) AS first_dy FROM e)
SELECT user_id, event_id, arg_min(event_id, g * 1000000000 + event_id) OVER w AS earliest, count(*) OVER w AS n_tied, count(*) OVER w > 1 AS is_tied FROM f WHERE dy = first_dy WINDOW w AS (PARTITION BY user_id)""",
    ),
    "audit_filter": (audit_filter, "SELECT event_id, user_id, event_type, iso AS seen_at FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events) WHERE event_type IN ('error', 'signup') AND iso BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-06T00:00:00Z'"),
    "session_validity": (
        session_validity,
        """SELECT s.event_id, s.user_id FROM events s LEFT JOIN (SELECT user_id, max(ts) AS r FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-15' GROUP BY user_id) x ON x.user_id = s.user_id
WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-15' AND ts > TIMESTAMP '2024-01-14' AND (r IS NULL OR r < ts)""",
    ),
    "chain_link_check": (chain_link_check, f"WITH RECURSIVE {_LOG_SQL} SELECT user_id, seq, link_ok, content_ok FROM checked"),
    "chain_content_hash": (chain_content_hash, f"WITH RECURSIVE {_LOG_SQL} SELECT seq, previous_hash, row_hash FROM log"),
    "chain_summary": (
        chain_summary,
        f"WITH RECURSIVE {_LOG_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (link_ok AND content_ok)) AS n_invalid, min(seq) FILTER (WHERE NOT (link_ok AND content_ok)) AS first_invalid, (SELECT arg_max(row_hash, seq) FROM log) AS head_hash, count(*) FILTER (WHERE NOT (link_ok AND content_ok)) = 0 AS valid FROM checked",
    ),
    "chain_forks": (chain_forks, f"WITH RECURSIVE {_LOG_SQL} SELECT seq, n_siblings FROM (SELECT seq, count(*) OVER (PARTITION BY previous_hash) AS n_siblings FROM log) WHERE n_siblings > 1"),
    "chain_diagnosis": (chain_diagnosis, f"WITH RECURSIVE {_LOG_SQL} SELECT user_id, n_rows, n_modified, CAST(first_break AS VARCHAR) AS first_break, CASE WHEN status = 'repairable' THEN later ELSE 0 END AS n_to_relink, status FROM judged"),
    "chain_repaired": (
        chain_repaired,
        f"""WITH RECURSIVE {_LOG_SQL} SELECT user_id, n_rows + CASE WHEN status = 'repairable' THEN 1 ELSE 0 END AS n_rows, status = 'repairable' OR first_break IS NULL AS links_hold, status FROM judged""",
    ),
}
