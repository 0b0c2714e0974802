"""Lineage and occurrences on the web."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import files
from evidara.operators import lineage, web
from evidara.sources.tables import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Turns as instances: the turn before is the parent, the conversation's first turn the source."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("platform"))
    node = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(node.alias("id"), F.when(F.col("turn") > 0, node - 1).alias("parent_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("source_id"), F.col("turn").cast("int").alias("generation"), "platform")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Some first answers near the second turn of the conversation before."""
    n = _nodes(spark, d)
    a = n.filter("generation = 1").select(F.col("id").alias("query"), F.expr("id div 1000 - 1").alias("conversation"))
    b = n.filter("generation = 2").select(F.col("id").alias("candidate"), F.expr("id div 1000").alias("conversation"))
    return a.join(b, "conversation").select("query", "candidate", ((F.col("query") + F.col("candidate")) % 13).cast("int").alias("distance")).filter("distance <= 3")


def lineage_recursive(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return lineage.climb(n, n).select("id", "ancestor", F.col("depth").cast("long").alias("depth"))


def lineage_positions(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every turn."""
    return lineage.positions(_nodes(spark, d))


def event_positions(spark: SparkSession, d: str) -> DataFrame:
    """Of every event its user's first one and how many lie between: chains as long as a user has events."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    chain = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lag("event_id").over(own).alias("parent_id"))
    return lineage.positions(chain).select("id", "root", "depth")


def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return lineage.edges(n, _matches(spark, d)).withColumn("distance", F.col("distance").cast("string")).drop("similarity")


def lineage_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a case: its items, their matches, the matches' lineage groups and ancestors."""
    n = _nodes(spark, d)
    case = n.filter("id div 1000 = 4")
    hit = _matches(spark, d).join(case.select(F.col("id").alias("query")), "query", "left_semi").select(F.col("candidate").alias("id")).distinct()
    return lineage.collect_nodes(case, hit, n).select("id", "discovered_by", "truncated")


def propagation_timeline(spark: SparkSession, d: str) -> DataFrame:
    dated = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("observed_at"), F.when(F.col("event_id") % 25 > 0, F.col("ts")).alias("ingested_at"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("platform"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 4).cast("int")).alias("generation"))
    return lineage.timeline(lineage.timestamps(dated)).select("id", "timestamp", "timestamp_source", "dated", "description")


def url_domains(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    return p.withColumn("domain", files.domain(F.col("url"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"), F.count_if(files.is_public_url(F.col("url"))).alias("n_public"))


def occurrence_rank(spark: SparkSession, d: str) -> DataFrame:
    """Hits by site (the url without its last step), first category winning, then ranked by match type."""
    p = table(spark, d, "pages")
    hits = p.select(F.regexp_extract("url", "^(https?://[^/]+/[a-z]+)/", 1).alias("url"), F.element_at(F.array(*map(F.lit, web.CATEGORIES)), (F.col("page_id") % 4 + 1).cast("int")).alias("category"), F.col("page_id").alias("position"), F.when(F.col("page_id") % 3 > 0, (F.col("page_id") * 7 % 30).cast("int")).alias("distance"), F.when(F.col("page_id") % 5 > 0, (F.col("page_id") * 11 % 100) / 100).alias("cosine"))
    once = web.occurrences(hits)
    kind = F.when(F.col("distance").isNull() & F.col("cosine").isNull(), web.fallback_type(F.col("category"))).otherwise(web.match_type(F.col("distance"), F.col("cosine")))
    return once.withColumn("match_type", kind).select("url", "domain", "category", "position", "match_type")


_N = "n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS source_id, turn AS generation FROM conversations GROUP BY conv_id, turn)"
_M = "mt AS (SELECT a.id AS query, b.id AS candidate, CAST((a.id + b.id) % 13 AS INTEGER) AS distance FROM n a JOIN n b ON a.generation = 1 AND b.generation = 2 AND a.id // 1000 - 1 = b.id // 1000 WHERE (a.id + b.id) % 13 <= 3)"

QUERIES = {
    "lineage_recursive": (
        lineage_recursive,
        f"WITH RECURSIVE {_N}, r(id, ancestor, depth) AS (SELECT id, id, 0::BIGINT FROM n UNION ALL SELECT r.id, n.parent_id, depth + 1 FROM r JOIN n ON n.id = r.ancestor WHERE n.parent_id IS NOT NULL AND depth < 32) SELECT * FROM r",
    ),
    "lineage_positions": (
        lineage_positions,
        f"WITH RECURSIVE {_N}, r(id, spot, root, depth) AS (SELECT id, id, id, 0::BIGINT FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n) UNION ALL SELECT n.id, n.id, r.root, depth + 1 FROM r JOIN n ON n.parent_id = r.spot), x AS (SELECT r.id, CASE WHEN p.parent_id IS NOT NULL THEN p.parent_id ELSE root END AS root, depth + CASE WHEN p.parent_id IS NOT NULL THEN 1 ELSE 0 END AS depth FROM r JOIN n p ON p.id = r.root) SELECT id, root, depth, false AS on_cycle FROM x",
    ),
    "event_positions": (event_positions, "SELECT event_id AS id, first_value(event_id) OVER w AS root, row_number() OVER w - 1 AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "lineage_edges": (
        lineage_edges,
        f"""WITH {_N}, {_M}, s AS (SELECT * FROM n)
SELECT parent_id AS source, id AS target, 'recorded_parent' AS relation, NULL::VARCHAR AS distance, false AS verified FROM s WHERE parent_id IN (SELECT id FROM s)
UNION ALL SELECT query, candidate, 'near_duplicate_candidate', CAST(distance AS VARCHAR), true FROM mt WHERE query IN (SELECT id FROM s) AND candidate IN (SELECT id FROM s)""",
    ),
    "lineage_nodes": (
        lineage_nodes,
        f"""WITH RECURSIVE {_N}, {_M}, own AS (SELECT id FROM n WHERE id // 1000 = 4), hit AS (SELECT DISTINCT candidate AS id FROM mt WHERE query IN (SELECT id FROM own)),
g AS (SELECT DISTINCT source_id FROM n WHERE id IN (SELECT id FROM hit) AND id NOT IN (SELECT id FROM own) AND source_id IS NOT NULL),
known AS (SELECT id, 0 AS r FROM own UNION ALL SELECT id, 1 FROM hit UNION ALL SELECT id, 2 FROM n WHERE source_id IN (SELECT source_id FROM g) OR id IN (SELECT source_id FROM g)),
up(id) AS (SELECT id FROM known UNION SELECT n.parent_id FROM up JOIN n ON n.id = up.id WHERE n.parent_id IS NOT NULL),
al AS (SELECT id, min(r) AS r FROM (SELECT * FROM known UNION ALL SELECT id, 2 FROM up WHERE id IN (SELECT id FROM n)) GROUP BY id)
SELECT id, ['case_evidence', 'perceptual_match', 'recorded_lineage'][r + 1] AS discovered_by, (SELECT count(*) FROM al) > 250 AS truncated FROM al ORDER BY r, id LIMIT 250""",
    ),
    "propagation_timeline": (
        propagation_timeline,
        """SELECT id, timestamp, timestamp_source, timestamp IS NOT NULL AS dated, concat_ws(' ', 'Instance', id, CASE WHEN user_id % 3 > 0 THEN 'on p' || user_id END, CASE WHEN id % 4 > 0 THEN '(generation ' || id % 4 || ')' END) AS description
FROM (SELECT event_id AS id, user_id, CASE WHEN event_id % 25 > 0 THEN ts END AS timestamp, CASE WHEN event_id % 5 > 0 THEN 'recorded_observation' ELSE 'local_ingestion' END AS timestamp_source FROM events)""",
    ),
    "url_domains": (url_domains, "SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^www\\.', '') AS domain, count(*) AS n_pages, min(page_id) AS first_page, count(*) FILTER (WHERE regexp_matches(url, '^https?://[^/?#]')) AS n_public FROM pages GROUP BY 1"),
    "occurrence_rank": (
        occurrence_rank,
        """WITH h AS (SELECT regexp_extract(url, '^(https?://[^/]+/[a-z]+)/', 1) AS url, page_id % 4 AS c, page_id AS position, CASE WHEN page_id % 3 > 0 THEN page_id * 7 % 30 END AS di, CASE WHEN page_id % 5 > 0 THEN CAST(page_id * 11 % 100 AS DOUBLE) / 100 END AS co FROM pages),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY c, position) = 1)
SELECT url, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^www\\.', '') AS domain, ['full', 'partial', 'page', 'similar'][c + 1] AS category, position,
  CASE WHEN di IS NULL AND co IS NULL THEN ['NEAR', 'SIMILAR', 'PAGE_ONLY', 'SIMILAR'][c + 1] WHEN di = 0 OR (di <= 2 AND co >= 0.98) THEN 'EXACT' WHEN di <= 12 OR co >= 0.85 THEN 'NEAR' WHEN co >= 0.70 OR di <= 20 THEN 'SIMILAR' ELSE 'PAGE_ONLY' END AS match_type FROM f""",
    ),
}
