"""The composite reads of cases, items, matches, provenance, the web cache, the dashboard and the system."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara import schema
from evidara.functions import files, hashing, nested
from evidara.media import containers
from evidara.operators import alerts, casework, chain, fusion, intake, latest, lineage, listing, neighbours, sessions, skew, web
from evidara.plans.cases import _LOG_SQL, EVENT_KINDS, _log
from evidara.plans.graphs import _M, _N, _matches, _nodes
from evidara.plans.reads import _V, _dated, _verdicts
from evidara.plans.retrieval import _C, _H, _hashes, _verified
from evidara.plans.signals import _SIGNALS_SQL, signals
from evidara.sources.commits import Store
from evidara.sources.tables import durable, shared_folder, table

#: When the query's own case work takes place.
NOW = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
STAGES = ", ".join(f"'{k}'" for k in EVENT_KINDS)


def case_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every case with its number of items and reports and its latest verdict."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    rows = listing.with_counts(cases, "id", {"n_evidence": (orders, "o_custkey"), "n_reports": (orders.filter("o_orderstatus = 'F'"), "o_custkey")})
    return rows.join(_verdicts(spark, d).withColumnRenamed("verdict", "latest_verdict"), "id", "left")


def case_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every case's items, newest first, with their number."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("at"))
    n = orders.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_items"))
    newest = Window.partitionBy("case_id").orderBy(F.col("at").desc(), F.col("item").desc())
    return skew.salted_join(orders.withColumn("position", F.row_number().over(newest)), n, ["case_id"], F.col("item")).select("case_id", "item", F.col("position").cast("long").alias("position"), "n_items")


_FIELDS = {"title": r"<title>([^<]+)</title>", "lang": r'<html lang="([^"]+)"', "charset": r'<meta charset="([^"]+)"', "canonical": r'<link rel="canonical" href="([^"]+)"', "heading": r"<h1>([^<]+)</h1>"}


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Which declared fields every page has and lacks, and the share of those it has."""
    found = {name: F.nullif(F.regexp_extract("html", pattern, 1), F.lit("")) for name, pattern in _FIELDS.items()}
    rows = table(spark, d, "pages").select("page_id", containers.completeness(found).alias("c"))
    return rows.select("page_id", F.array_join("c.present", ",").alias("present"), F.array_join("c.missing", ",").alias("missing"), F.round("c.ratio", 6).alias("ratio"))


def page_provenance(spark: SparkSession, d: str) -> DataFrame:
    """State of content credentials of every page's bytes, and what it declares."""
    content = F.encode("html", "UTF-8")
    rows = table(spark, d, "pages").select("page_id", "html", containers.credentials(content).alias("has"), containers.declared(content, r"track\(([0-9]+)\)").alias("said"))
    state = containers.provenance_state(F.col("html").isNotNull(), F.col("has"), F.lit(None).cast("boolean"))
    return rows.withColumn("s", state).select("page_id", "s.status", "s.state", "s.manifest_present", F.array_join("said", ",").alias("declared"))


def stored_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every item's verified candidates with rank, band and what the match rests on; an item without any has one row."""
    none = F.lit(None).cast("int")
    basis = hashing.match_basis(F.col("same_bytes"), F.col("distance"), F.col("distance"), none, none, F.col("cosine"))
    found = _verified(spark, d).select("query", F.col("candidate").cast("string").alias("candidate"), F.col("rank").cast("string").alias("rank"), "band", basis.alias("basis"))
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("query"))
    return items.join(found, "query", "left").withColumn("matched", F.col("candidate").isNotNull())


def match_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by distance, ties by the distance of a second hash, then id."""
    h = _hashes(spark, d)
    second = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), hashing.gradient_hash(F.col("embedding")).alias("g"))
    pool = neighbours.hamming_top_k(h, h, 15).join(second.toDF("query", "gq"), "query").join(second.toDF("candidate", "gc"), "candidate")
    pool = pool.select("query", "candidate", "distance", "rank", F.lit(False).alias("same_bytes"), hashing.hamming(F.col("gq"), F.col("gc")).alias("dhash_distance"))
    none = spark.createDataFrame([], "query long, candidate long, similarity double, rank int")
    return neighbours.ranked_candidates(pool, none, 15, 5, 64).select("query", "candidate", "rank", "dhash_distance")


def case_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and timeline of one case, the fifth conversation, in one result."""
    n, m = _dated(spark, d), _matches(spark, d)
    case = n.filter("id div 1000 = 4")
    hit = m.join(case.select(F.col("id").alias("query")), "query", "left_semi")
    nodes = durable(lineage.collect_nodes(case, hit.select(F.col("candidate").alias("id")).distinct(), n))
    held = n.join(F.broadcast(nodes), "id")
    part = lambda rows, name, a, b, text: rows.select(F.lit(name).alias("part"), a.cast("long").alias("a"), b.cast("long").alias("b"), text.cast("string").alias("info"))
    edges = lineage.edges(held, m)
    order = Window.partitionBy().orderBy(F.col("timestamp").asc_nulls_last(), F.coalesce("generation", F.lit(99)), "id")  # at most MOST_NODES rows
    timeline = held.withColumn("position", F.row_number().over(order))
    return part(nodes, "node", F.col("id"), F.lit(0), F.col("discovered_by")).unionByName(part(edges, "edge", F.col("source"), F.col("target"), F.col("relation"))).unionByName(part(timeline, "event", F.col("id"), F.col("position"), F.coalesce(files.iso_seconds(F.col("timestamp")), F.lit("undated"))))


def evidence_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Every item's stored and missing stages and its verdict, without running any."""
    found = latest.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])
    stages = found.groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("held"))
    kinds, held = F.array(*map(F.lit, EVENT_KINDS)), F.coalesce("held", F.array().cast("array<string>"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(stages, "id", "left").join(_verdicts(spark, d), "id", "left")
    return items.select("id", F.array_join(F.array_intersect(kinds, held), ",").alias("stored"), F.array_join(F.array_except(kinds, held), ",").alias("missing"), "verdict")


def web_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Views and clicks as requests, purchases and signups as finished searches, errors as failed ones: hits within a day."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "REQUEST").otherwise("RESULT")
    status = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "signup", "NO_RESULTS").when(F.col("event_type") == "error", "ERROR")
    found = web.replayed(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"), status.alias("status")), 86_400)
    return found.withColumn("result_id", F.col("result_id").cast("string"))


def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    """All figures of the dashboard as one row."""
    orders = table(spark, d, "orders")
    one = orders.agg(F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("o_custkey").alias("n_cases_with_evidence"), F.count_if((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")).alias("n_urgent"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending_review"))
    newest = _verdicts(spark, d)
    done = newest.agg(F.count_if(F.col("verdict") == "ERROR").alias("n_flagged"), F.count("verdict").alias("n_analysed"))
    waiting = orders.select(F.col("o_custkey").alias("id")).distinct().join(newest, "id", "left_anti").agg(F.count(F.lit(1)).alias("n_unanalysed"))
    shares = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat("o_orderstatus", F.lit("="), F.col("n").cast("string")))), ",").alias("breakdown"))  # a row a status
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("indexed"))
    held = table(spark, d, "documents").select("doc_id").join(index, "doc_id", "left").agg(F.count_if(F.col("indexed").isNull()).alias("n_not_indexed"), F.count("indexed").alias("n_indexed"))
    label = F.when(F.col("n_indexed") == 0, "EMPTY").when(F.col("n_not_indexed") > 0, "STALE").otherwise("ONLINE")
    return one.join(done).join(waiting).join(shares).join(held).withColumn("index_label", label)


def capability_states(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all parts of the system and the state of what it can do."""
    count = lambda name, rows, key=None: rows.agg((F.count(F.lit(1)) if key is None else F.countDistinct(key)).alias("n")).select(F.lit(name).alias("part"), "n")
    e, docs = table(spark, d, "events"), table(spark, d, "documents")
    hashed = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("h").alias("phash"), (F.col("label") != 0).alias("indexed"))
    parts = [
        count("cases", table(spark, d, "customer")), count("evidence", docs), count("analysis_results", e), count("fused_evidence", e, "user_id"), count("reports", table(spark, d, "orders")),
        count("audit_entries", e), count("hashable", hashed), count("waiting_for_index", listing.waits_for_index(hashed)), count("detector", table(spark, d, "labels").filter("toxic is not null")), count("verified", e.filter("event_type = 'purchase'")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    state = F.when(F.col("part") == "waiting_for_index", F.when(F.col("n") > 0, "STALE").otherwise("ONLINE")).when(F.col("part") == "detector", F.when(F.col("n") > 0, "ONLINE").otherwise("UNAVAILABLE")).when(F.col("part") == "verified", F.when(F.col("n") > 0, "CHECKED").otherwise("NEVER_CHECKED")).otherwise("COUNTED")
    return out.withColumn("state", state)


def signal_registry(spark: SparkSession, d: str) -> DataFrame:
    """Which signal applies to which media type, with its weight, whether it may decide, and how many items it measured."""
    rows = fusion.applicable(spark).withColumn("eligible", F.col("signal_id").isin(*fusion.ELIGIBLE))
    found = fusion.marked(signals(spark, d)).groupBy("media_type", "signal_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("measured").alias("n_measured"))
    both = rows.join(found, ["media_type", "signal_id"], "left").fillna(0, ["n_items", "n_measured"])
    return both.withColumn("state", F.when(F.col("n_measured") > 0, "AVAILABLE").otherwise("UNAVAILABLE"))


def case_audit(spark: SparkSession, d: str) -> DataFrame:
    """The last five log rows of every case, with the head's hash and whether the whole chain holds."""
    log = _log(spark, d)
    bad = ~(F.col("content_ok") & F.col("link_ok"))
    whole = chain.link_check(log, chain="user_id").groupBy("user_id").agg((F.count_if(bad) == 0).alias("chain_valid"))
    heads = log.groupBy("user_id").agg(F.max_by("row_hash", "seq").alias("head_hash"))
    rows = latest.trail(log.select("user_id", "seq"), "user_id", "seq", 5)
    return rows.join(whole.join(heads, "user_id"), "user_id").select("user_id", "seq", "truncated", F.col("position").cast("long").alias("position"), "chain_valid", "head_hash")


def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every source's items as a case: how many, how many with each verdict, and the one with the highest score."""
    source = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), "source")
    a = fusion.assess(signals(spark, d)).join(source, "evidence_id")
    lead = F.max_by("evidence_id", F.when(F.col("score").isNotNull(), F.struct(F.round("score", 9).alias("s"), (-F.col("evidence_id").cast("long")).alias("k"))))
    return a.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("verdict") == "MANIPULATED").alias("n_manipulated"), F.count_if(F.col("verdict") == "AUTHENTIC").alias("n_authentic"), F.count_if(F.col("score").isNull()).alias("n_unscored"), lead.alias("leading"))


def cleaned_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Every document's fields held to bounds: the length of its text and the digest of all."""
    row = table(spark, d, "documents").select("doc_id", nested.cleaned_fields({"text": F.col("text"), "source": F.col("source"), "lang": F.col("lang")}).alias("c"))
    return row.select("doc_id", F.length("c.text").cast("long").alias("n_text"), F.md5(F.concat_ws("|", "c.lang", "c.source", "c.text").cast("binary")).alias("digest"))


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """One low alert for every item whose evidence was not enough."""
    found = fusion.assess(signals(spark, d)).select(F.col("evidence_id").cast("long").alias("item"), "verdict", F.lit(None).cast("timestamp").alias("created_at"))
    return alerts.coverage_alerts(found).select("category", "severity", "title", "item")


def sessions_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Signups as sessions of a day that an error of the same user revokes, presented at a fixed moment."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    e = table(spark, d, "events")
    revoked = e.filter((F.col("event_type") == "error") & (F.col("ts") <= now)).groupBy("user_id").agg(F.max("ts").alias("at"))
    token = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    signups = e.filter((F.col("event_type") == "signup") & (F.col("ts") <= now)).join(revoked, "user_id", "left")
    held = signups.select(F.sha2(token, 256).alias("token_hash"), "user_id", (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"), F.when(F.col("at") >= F.col("ts"), F.col("at")).alias("revoked_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return sessions.resolved(e.select(token.alias("token")), held, users, now)


def case_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken in as files of their source's case and analysed end to end in a store of their own.

    Labels stand for what a detector says, embeddings give the hashes; one row an item with its verdict, stored stages,
    candidates and what the first of them rests on.
    """
    hashed = _hashes(spark, d).select(F.col("id").alias("doc_id"), hashing.hash_to_hex(F.col("value")).alias("phash"))
    name, none = F.col("doc_id").cast("string"), F.lit(None).cast("string")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("case_id"), name.alias("path"), F.col("text").cast("binary").alias("content"))
    # digests and lengths join the hashes, bytes don't
    known = docs.select("doc_id", "case_id", "path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("length")).join(hashed, "doc_id", "left")
    files_ = known.select(F.col("path").alias("id"), "case_id", "path", F.col("path").alias("filename"), "sha256", "length", F.lit("image/png").alias("mime"), F.lit("image").alias("media_type"), "phash", none.alias("dhash"), none.alias("ahash"))
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    intake.take_in(store, files_, "intake", "query", NOW)
    said = table(spark, d, "labels").filter("toxic is not null").select(F.col("doc_id").cast("string").alias("evidence_id"), F.when(F.col("toxic") == 1, 0.9).otherwise(0.1).alias("score"), F.lit("OK").alias("status"), F.lit(False).alias("abstained"))
    decoded = spark.createDataFrame([], "origin string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    casework.analyse(store, docs.select("case_id").distinct(), docs.select("path", "content"), decoded, "run", "query", NOW, said)
    results = store.read("analysis_results", schema.ANALYSIS)
    stages = results.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_stages"), F.max(F.when(F.col("kind") == casework.FUSION, F.col("verdict"))).alias("verdict"))
    best = store.read("matches", schema.MATCHES).groupBy(F.col("query_evidence_id").alias("evidence_id")).agg(F.count(F.lit(1)).alias("n_candidates"), F.min_by("method", "rank").alias("basis"))
    return stages.join(best, "evidence_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


_MATCHED = f"""WITH {_H}, {_C.format(floor=0.3)},
both_ AS (SELECT coalesce(r.query, c.query) AS query, coalesce(r.candidate, c.candidate) AS candidate, r.distance, r.same AS same_bytes, c.s
  FROM (SELECT ranked.*, q.label = c.label AS same FROM ranked JOIN embeddings q ON q.vec_id = query JOIN embeddings c ON c.vec_id = candidate WHERE rank <= 15) r
  FULL JOIN (SELECT * FROM cosr WHERE rank <= 3) c ON r.query = c.query AND r.candidate = c.candidate),
kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coalesce(same_bytes, false) DESC, coalesce(distance, 999), greatest(1 - distance / 64.0::DOUBLE, s) DESC, candidate) AS r
  FROM both_ WHERE coalesce(same_bytes, false) OR distance <= 20 OR s IS NOT NULL)"""
_CASE = f"""{_N}, {_M}, own AS (SELECT id FROM n WHERE id // 1000 = 4), hit AS (SELECT DISTINCT candidate AS id FROM mt WHERE query IN (SELECT id FROM own)),
g AS (SELECT DISTINCT source_id FROM n WHERE id IN (SELECT id FROM hit) AND id NOT IN (SELECT id FROM own) AND source_id IS NOT NULL),
known AS (SELECT id, 0 AS r FROM own UNION ALL SELECT id, 1 FROM hit UNION ALL SELECT id, 2 FROM n WHERE source_id IN (SELECT source_id FROM g) OR id IN (SELECT source_id FROM g)),
up(id) AS (SELECT id FROM known UNION SELECT n.parent_id FROM up JOIN n ON n.id = up.id WHERE n.parent_id IS NOT NULL),
al AS (SELECT id, min(r) AS r FROM (SELECT * FROM known UNION ALL SELECT id, 2 FROM up WHERE id IN (SELECT id FROM n)) GROUP BY id),
nd AS (SELECT al.id, r, parent_id, generation, CASE WHEN al.id % 5 > 0 THEN 1704067200 + al.id // 3 END AS tm FROM (SELECT * FROM al ORDER BY r, id LIMIT 250) al JOIN n USING (id))"""
_G = "g AS (SELECT vec_id AS id, CAST(array_to_string([CASE WHEN embedding[i + 1] < embedding[i // 8 * 8 + (i + 1) % 8 + 1] THEN '1' ELSE '0' END for i in range(0, 64)], '') AS BIT) AS g FROM embeddings)"

QUERIES = {
    "case_analysis": (
        case_analysis,
        f"""WITH {_H}, kept AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY CAST(doc_id AS VARCHAR)) = 1),
x AS (SELECT k.*, h.v FROM kept k JOIN h ON h.id = k.doc_id), near2 AS (SELECT a.id AS q, b.id AS c, CAST(bit_count(xor(a.v, b.v)) AS INTEGER) AS dist, a.text = b.text AS same FROM x a JOIN x b ON a.id <> b.id),
cand AS (SELECT q, c, CASE WHEN same THEN 0 WHEN dist <= 12 THEN dist END AS eff, dist, same FROM near2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY same DESC, eff, c) AS r FROM cand WHERE eff IS NOT NULL),
best AS (SELECT q, count(*) AS n_candidates, arg_min(CASE WHEN same AND eff = 0 THEN 'Exact SHA-256 byte match' ELSE 'Multi-hash verified (pHash dist ' || dist || ')' END, r) AS basis FROM r WHERE r <= 10 GROUP BY q)
SELECT id AS evidence_id, 5::BIGINT AS n_stages, CASE toxic WHEN 1 THEN 'MANIPULATED' WHEN 0 THEN 'AUTHENTIC' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict, coalesce(n_candidates, 0) AS n_candidates, basis
FROM kept LEFT JOIN labels USING (doc_id) LEFT JOIN best ON q = id""",
    ),
    "case_detail": (
        case_detail,
        f"""WITH {_V}, n AS (SELECT o_custkey, count(*) AS n_evidence, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_reports FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_name, c_mktsegment, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_reports, 0) AS n_reports, verdict AS latest_verdict FROM customer LEFT JOIN n ON o_custkey = c_custkey LEFT JOIN v ON v.id = c_custkey""",
    ),
    "case_evidence": (case_evidence, "SELECT o_custkey AS case_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position, count(*) OVER (PARTITION BY o_custkey) AS n_items FROM orders"),
    "page_metadata": (
        page_metadata,
        "WITH f AS (SELECT page_id, " + ", ".join(f"nullif(regexp_extract(html, '{p}', 1), '') AS {n}" for n, p in _FIELDS.items()) + " FROM pages) SELECT page_id, " + "concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n in _FIELDS) + ") AS present, concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in _FIELDS) + ") AS missing, round((" + " + ".join(f"CAST({n} IS NOT NULL AS DOUBLE)" for n in _FIELDS) + f") / {len(_FIELDS)}, 6) AS ratio FROM f",
    ),
    "page_provenance": (
        page_provenance,
        r"""WITH p AS (SELECT page_id, html IS NOT NULL AS there, coalesce(contains(html, 'jumb') AND (contains(html, 'c2pa') OR contains(html, 'c2ma')), false) AS has, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'track\(([0-9]+)\)', 1))), ',') AS declared FROM pages)
SELECT page_id, CASE WHEN there THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN there AND has THEN 'UNVERIFIED' ELSE 'ABSENT' END AS state, there AND has AS manifest_present, declared FROM p""",
    ),
    "stored_matches": (
        stored_matches,
        f"""{_MATCHED}, m AS (SELECT query, CAST(candidate AS VARCHAR) AS candidate, CAST(r AS VARCHAR) AS rank, CASE WHEN coalesce(distance, 999) <= 6 OR coalesce(s >= 0.85, false) THEN 'strong' ELSE 'possible' END AS band,
  CASE WHEN same_bytes AND distance = 0 THEN 'Exact SHA-256 byte match' ELSE 'Multi-hash verified (' || concat_ws(', ', 'pHash dist ' || distance, 'embedding sim ' || printf('%.2f', s)) || ')' END AS basis FROM kept WHERE r <= 5)
SELECT vec_id AS query, candidate, rank, band, basis, candidate IS NOT NULL AS matched FROM embeddings LEFT JOIN m ON query = vec_id""",
    ),
    "match_order": (
        match_order,
        f"""WITH {_H}, {_G}, p AS (SELECT ranked.*, CAST(bit_count(xor(a.g, b.g)) AS INTEGER) AS dhash_distance FROM ranked JOIN g a ON a.id = query JOIN g b ON b.id = candidate WHERE rank <= 15)
SELECT * FROM (SELECT query, candidate, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, dhash_distance, candidate) AS INTEGER) AS rank, dhash_distance FROM p) WHERE rank <= 5""",
    ),
    "case_propagation": (
        case_propagation,
        f"""WITH RECURSIVE {_CASE} SELECT 'node' AS part, id AS a, 0::BIGINT AS b, ['case_evidence', 'perceptual_match', 'recorded_lineage'][r + 1] AS info FROM nd
UNION ALL SELECT 'edge', parent_id, id, 'recorded_parent' FROM nd WHERE parent_id IN (SELECT id FROM nd) UNION ALL SELECT 'edge', query, candidate, 'near_duplicate_candidate' FROM mt WHERE query IN (SELECT id FROM nd) AND candidate IN (SELECT id FROM nd)
UNION ALL SELECT 'event', id, row_number() OVER (ORDER BY tm NULLS LAST, coalesce(generation, 99), id), coalesce(strftime(make_timestamp(tm * 1000000), '%Y-%m-%dT%H:%M:%SZ'), 'undated') FROM nd""",
    ),
    "evidence_analysis": (
        evidence_analysis,
        f"""WITH {_V}, h AS (SELECT user_id, list(DISTINCT event_type) AS held FROM events GROUP BY 1)
SELECT c_custkey AS id, array_to_string([k for k in [{STAGES}] if list_contains(coalesce(held, []), k)], ',') AS stored, array_to_string([k for k in [{STAGES}] if NOT list_contains(coalesce(held, []), k)], ',') AS missing, verdict FROM customer LEFT JOIN h ON user_id = c_custkey LEFT JOIN v ON v.id = c_custkey""",
    ),
    "web_cache_replay": (
        web_cache_replay,
        """WITH e AS (SELECT user_id AS key, event_id AS id, ts, event_type IN ('view', 'click') AS ask, event_type IN ('purchase', 'signup') AS good FROM events),
w AS (SELECT *, last_value(CASE WHEN good THEN id END IGNORE NULLS) OVER o AS r, last_value(CASE WHEN good THEN ts END IGNORE NULLS) OVER o AS seen FROM e WINDOW o AS (PARTITION BY key ORDER BY ts, CAST(ask AS INTEGER), id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, id, coalesce(ts - seen <= INTERVAL 24 HOURS, false) AS hit, CASE WHEN ts - seen <= INTERVAL 24 HOURS THEN CAST(r AS VARCHAR) END AS result_id FROM w WHERE ask""",
    ),
    "dashboard_summary": (
        dashboard_summary,
        f"""WITH {_V}, x AS (SELECT count(*) FILTER (WHERE vec_id IS NULL) AS n_not_indexed, count(vec_id) AS n_indexed FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT (SELECT count(*) FROM orders) AS n_evidence, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_cases_with_evidence, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS n_urgent, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n_pending_review,
  (SELECT count(*) FROM v WHERE verdict = 'ERROR') AS n_flagged, (SELECT count(verdict) FROM v) AS n_analysed, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT id FROM v)) AS n_unanalysed,
  (SELECT string_agg(o_orderstatus || '=' || n, ',' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)) AS breakdown, n_not_indexed, n_indexed, CASE WHEN n_indexed = 0 THEN 'EMPTY' WHEN n_not_indexed > 0 THEN 'STALE' ELSE 'ONLINE' END AS index_label FROM x""",
    ),
    "capability_states": (
        capability_states,
        """WITH c(part, n) AS (SELECT 'cases', count(*) FROM customer UNION ALL SELECT 'evidence', count(*) FROM documents UNION ALL SELECT 'analysis_results', count(*) FROM events UNION ALL SELECT 'fused_evidence', count(DISTINCT user_id) FROM events UNION ALL SELECT 'reports', count(*) FROM orders
UNION ALL SELECT 'audit_entries', count(*) FROM events UNION ALL SELECT 'hashable', count(*) FROM embeddings UNION ALL SELECT 'waiting_for_index', count(*) FROM embeddings WHERE label = 0 OR label IS NULL UNION ALL SELECT 'detector', count(*) FROM labels WHERE toxic IS NOT NULL UNION ALL SELECT 'verified', count(*) FROM events WHERE event_type = 'purchase')
SELECT part, n, CASE part WHEN 'waiting_for_index' THEN CASE WHEN n > 0 THEN 'STALE' ELSE 'ONLINE' END WHEN 'detector' THEN CASE WHEN n > 0 THEN 'ONLINE' ELSE 'UNAVAILABLE' END WHEN 'verified' THEN CASE WHEN n > 0 THEN 'CHECKED' ELSE 'NEVER_CHECKED' END ELSE 'COUNTED' END AS state FROM c""",
    ),
    "signal_registry": (
        signal_registry,
        f"""WITH {_SIGNALS_SQL}, types(media_type) AS (VALUES ('image'), ('video'), ('audio')), r AS (SELECT media_type, signal_id, weight FROM types, w WHERE media_type = 'image' OR (media_type = 'video' AND video) OR (media_type = 'audio' AND audio)),
f AS (SELECT media AS media_type, signal_id, count(*) AS n_items, count(*) FILTER (WHERE measured) AS n_measured FROM m JOIN d USING (k) GROUP BY 1, 2)
SELECT media_type, signal_id, weight, signal_id IN ('ai_detection', 'provenance_c2pa') AS eligible, coalesce(n_items, 0) AS n_items, coalesce(n_measured, 0) AS n_measured, CASE WHEN coalesce(n_measured, 0) > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS state FROM r LEFT JOIN f USING (media_type, signal_id)""",
    ),
    "case_audit": (
        case_audit,
        f"""WITH RECURSIVE {_LOG_SQL}, v AS (SELECT user_id, count(*) FILTER (WHERE NOT (link_ok AND content_ok)) = 0 AS chain_valid FROM checked GROUP BY 1), heads AS (SELECT user_id, arg_max(row_hash, seq) AS head_hash FROM log GROUP BY 1),
r AS (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS b, count(*) OVER (PARTITION BY user_id) > 5 AS truncated FROM log)
SELECT user_id, seq, truncated, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position, chain_valid, head_hash FROM r JOIN v USING (user_id) JOIN heads USING (user_id) WHERE b <= 5""",
    ),
    "case_verdicts": (
        case_verdicts,
        f"""WITH {_SIGNALS_SQL} SELECT source, count(*) AS n_items, count(*) FILTER (WHERE verdict = 'MANIPULATED') AS n_manipulated, count(*) FILTER (WHERE verdict = 'AUTHENTIC') AS n_authentic, count(*) FILTER (WHERE score IS NULL) AS n_unscored,
  arg_max(evidence_id, (round(score, 9), -CAST(evidence_id AS BIGINT))) FILTER (WHERE score IS NOT NULL) AS leading FROM a JOIN documents ON CAST(doc_id AS VARCHAR) = evidence_id GROUP BY source""",
    ),
    "cleaned_metadata": (
        cleaned_metadata,
        r"""WITH c AS (SELECT doc_id, """ + ", ".join(f"substr(regexp_replace(regexp_replace({c}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '^$', ''), 1, 512) AS {c}" for c in ("lang", "source", "text")) + " FROM documents) SELECT doc_id, CAST(length(text) AS BIGINT) AS n_text, md5(concat_ws('|', lang, source, text)) AS digest FROM c",
    ),
    "coverage_gaps": (coverage_gaps, f"WITH {_SIGNALS_SQL} SELECT 'coverage' AS category, 'low' AS severity, 'Inconclusive analysis' AS title, CAST(evidence_id AS BIGINT) AS item FROM a WHERE verdict = 'INSUFFICIENT_EVIDENCE'"),
    "sessions_resolved": (
        sessions_resolved,
        """SELECT 't' || s.event_id AS token, s.user_id FROM events s JOIN customer ON c_custkey = s.user_id AND c_acctbal > 0 LEFT JOIN (SELECT user_id, max(ts) AS r FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-15' GROUP BY user_id) x ON x.user_id = s.user_id
WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-15' AND ts > TIMESTAMP '2024-01-14' AND (r IS NULL OR r < ts)""",
    ),
}
