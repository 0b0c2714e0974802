"""Signals, kinds and shares derived row by row or per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import files, hashing, scores
from evidara.operators import fusion, web
from evidara.sources.tables import table


def perceptual_signal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n, same, distance = F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 3), F.col("event_id") % 11 == 0, (F.col("event_id") % 20).cast("double")
    score, status = fusion.perceptual(n, same, distance)
    return e.select("event_id", F.round(score, 6).alias("score"), status.alias("status"))


def metadata_signal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bit = lambda k: F.when(F.col("event_id") % 5 != k % 5, F.expr(f"shiftright(event_id, {k}) % 2 = 1"))
    status = F.when(F.col("event_id") % 13 > 0, F.when(F.col("event_id") % 17 == 0, "ERROR").otherwise("OK"))
    score, out = fusion.metadata(status, bit(0), bit(1), bit(2), bit(3), bit(4))
    return e.select("event_id", score.alias("score"), out.alias("status"))


def provenance_signal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    state = F.element_at(F.array(*map(F.lit, ("VERIFIED", "INVALID", "UNVERIFIED", "ABSENT", "ERROR"))), (F.col("event_id") % 5 + 1).cast("int"))
    score, status, role, run = fusion.provenance(state, F.col("event_id") % 3 == 0)
    return e.select("event_id", score.alias("score"), status.alias("status"), role.alias("role"), run.alias("execution_status")).groupBy("score", "status", "role", "execution_status").agg(F.count(F.lit(1)).alias("n"))


def case_leading_item(spark: SparkSession, d: str) -> DataFrame:
    """Item with the highest score of each case; missing scores last, the first item of equals."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("score"))
    best = F.min_by(F.struct("l_linenumber", "score"), F.struct(F.col("score").isNull(), -F.col("score"), F.col("l_linenumber")))
    return lines.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_linenumber", "b.score")


def transformation_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What tells consecutive parts apart, taken as image sizes."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 16).cast("double").alias("w"), (F.lit(800) - F.col("p_size")).cast("double").alias("h"), (F.col("p_retailprice") * 10).alias("bytes"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("w2"), F.col("h").alias("h2"), F.col("bytes").alias("b2"))
    kinds = hashing.transformation(F.col("w"), F.col("h"), F.col("bytes"), F.col("w2"), F.col("h2"), F.col("b2"))
    related = hashing.relationship((F.col("p_partkey") % 20).cast("int"), (F.col("p_partkey") % 10) / 10)
    return p.join(q, "p_partkey").select("p_partkey", F.array_join(kinds, ",").alias("kinds"), related.alias("relationship"))


def web_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by category, and how many were verified."""
    p = table(spark, d, "pages").withColumn("category", F.element_at(F.array(*map(F.lit, web.CATEGORIES)), (F.col("page_id") % 4 + 1).cast("int")))
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").startswith("https:")).alias("n_verified"))


def media_routing(spark: SparkSession, d: str) -> DataFrame:
    """Media type from the last step of a url, from an alias or a mime type."""
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("page_id").cast("string"), F.lit(".MP4"))).when(F.col("page_id") % 3 == 1, "Image/png").otherwise(F.lit(" voice "))
    return table(spark, d, "pages").select("page_id", F.coalesce(files.media_of(F.col("url")), files.media_of(name)).alias("media_type"))


def json_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k").startswith("7")).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def usable_scores(spark: SparkSession, d: str) -> DataFrame:
    """Values over a hundred as scores: those over 1 are dropped, not clamped; and a ramp of what is left."""
    s = scores.usable(F.col("value") / 100)
    ramp = scores.ramp(s, [(0.1, 0.0), (0.3, 0.3), (0.8, 0.9)], 0.6)
    return table(spark, d, "events").select("event_id", F.round(s, 6).alias("score"), F.round(ramp, 5).alias("ramp"), F.coalesce(scores.abstains(s), F.lit(True)).alias("abstains"))


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as evidence: digest, size, first line bounded, iso time of ingestion."""
    docs = table(spark, d, "documents")
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") * 3601)
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes"), files.bounded(F.substring_index("text", "\n", 1), 64).alias("title"), files.iso_seconds(at).alias("ingested_at"))


def match_basis(spark: SparkSession, d: str) -> DataFrame:
    """Why a candidate counts as a match, and whether it does."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 21 == 0).alias("same"), (F.col("event_id") * 5 % 33).cast("int").alias("p"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") * 3 % 29).cast("int")).alias("dh"), F.when(F.col("event_id") % 6 > 0, (F.col("event_id") * 7 % 31).cast("int")).alias("ah"))
    distance = hashing.effective_distance(F.col("same"), F.col("p"), F.col("dh"), F.col("ah"))
    basis = F.concat_ws("+", F.when(F.col("same"), "bytes"), F.when(F.col("p") <= 12, "phash"), F.when(F.col("dh") <= 12, "dhash"), F.when(F.col("ah") <= 12, "ahash"))
    return e.select("event_id", distance.alias("distance"), hashing.band(distance).alias("band"), basis.alias("basis")).filter("distance is not null")


def examination_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of an examination's fixed fields, one of them missing now and then."""
    e = table(spark, d, "events")
    fields = {"user_id": F.col("user_id"), "event_type": F.col("event_type"), "event_id": F.when(F.col("event_id") % 5 > 0, F.col("event_id"))}
    return e.select("event_id", files.digest_of(fields).alias("digest"))


_B = "CASE WHEN event_id % 5 <> {0} THEN (event_id >> {0}) % 2 = 1 END"
QUERIES = {
    "perceptual_signal": (
        perceptual_signal,
        """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id % 3 END AS n, event_id % 11 = 0 AS same, event_id % 20 AS di FROM events),
s AS (SELECT *, CASE WHEN same THEN 0.15::DOUBLE WHEN n > 0 THEN least(0.15::DOUBLE + 0.04::DOUBLE * di, 0.60::DOUBLE) END AS sc FROM e)
SELECT event_id, round(sc, 6) AS score, CASE WHEN n IS NULL THEN 'UNAVAILABLE' WHEN sc IS NOT NULL THEN 'OK' ELSE 'INCONCLUSIVE' END AS status FROM s""",
    ),
    "metadata_signal": (
        metadata_signal,
        f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN CASE WHEN event_id % 17 = 0 THEN 'ERROR' ELSE 'OK' END END AS st, {", ".join(f"{_B.format(k)} AS b{k}" for k in range(5))} FROM events),
s AS (SELECT *, coalesce(greatest(CASE WHEN b0 THEN 0.85::DOUBLE END, CASE WHEN b1 THEN 0.55::DOUBLE END, CASE WHEN b2 THEN 0.60::DOUBLE END), CASE WHEN b3 AND b4 THEN 0.25::DOUBLE END) AS sc, coalesce(st, '') NOT IN ('OK', '') AS bad FROM e)
SELECT event_id, CASE WHEN NOT bad THEN sc END AS score, CASE WHEN st IS NULL THEN 'UNAVAILABLE' WHEN bad THEN 'ERROR' WHEN sc IS NOT NULL THEN 'OK' ELSE 'INCONCLUSIVE' END AS status FROM s""",
    ),
    "provenance_signal": (
        provenance_signal,
        """WITH e AS (SELECT ['VERIFIED', 'INVALID', 'UNVERIFIED', 'ABSENT', 'ERROR'][event_id % 5 + 1] AS state, event_id % 3 = 0 AS gen FROM events)
SELECT CASE WHEN state = 'VERIFIED' THEN CASE WHEN gen THEN 0.85::DOUBLE ELSE 0.15 END WHEN state = 'INVALID' THEN 0.70 WHEN state = 'UNVERIFIED' AND gen THEN 0.60 END AS score,
  CASE WHEN state IN ('VERIFIED', 'INVALID') OR (state = 'UNVERIFIED' AND gen) THEN 'OK' WHEN state = 'ERROR' THEN 'ERROR' ELSE 'INCONCLUSIVE' END AS status, CASE WHEN state = 'VERIFIED' THEN 'DECISIVE' ELSE 'DESCRIPTIVE' END AS role,
  CASE WHEN state = 'ABSENT' OR (state = 'UNVERIFIED' AND NOT gen) THEN 'UNAVAILABLE' END AS execution_status, count(*) AS n FROM e GROUP BY ALL""",
    ),
    "case_leading_item": (case_leading_item, "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.02 THEN l_discount END AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_discount > 0.02 THEN l_discount END DESC NULLS LAST, l_linenumber) = 1"),
    "transformation_kinds": (
        transformation_kinds,
        """WITH p AS (SELECT p_partkey AS k, p_size * 16::DOUBLE AS w, 800::DOUBLE - p_size AS h, p_retailprice * 10 AS b FROM part)
SELECT a.k AS p_partkey, concat_ws(',', CASE WHEN abs(a.w / a.h - c.w / c.h) > 0.05 THEN 'crop' WHEN a.w <> c.w OR a.h <> c.h THEN 'resize' END, CASE WHEN (c.b / a.b < 0.8 OR c.b / a.b > 1.2) AND abs(a.b - c.b) > 1024 THEN 'recompression' END) AS kinds,
  CASE WHEN a.k % 20 = 0 THEN 'identical' WHEN a.k % 20 <= 6 THEN 'near_identical' WHEN a.k % 20 <= 12 THEN 'similar' WHEN a.k % 10 >= 7.5 THEN 'semantically_similar' ELSE 'unrelated' END AS relationship FROM p a JOIN p c ON c.k = a.k + 1""",
    ),
    "web_counts": (web_counts, "SELECT ['full', 'partial', 'page', 'similar'][page_id % 4 + 1] AS category, count(*) AS n, count(*) FILTER (WHERE url LIKE 'https:%') AS n_verified FROM pages GROUP BY 1"),
    "media_routing": (media_routing, "SELECT page_id, ['video', 'image', 'audio'][page_id % 3 + 1] AS media_type FROM pages"),
    "json_prefix_filter": (json_prefix_filter, "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE props ->> '$.k' LIKE '7%'"),
    "usable_scores": (
        usable_scores,
        """WITH s AS (SELECT event_id, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 END AS s FROM events)
SELECT event_id, round(s, 6) AS score, round(CASE WHEN s IS NOT NULL THEN least(0.6::DOUBLE, CASE WHEN s <= 0.1::DOUBLE THEN 0::DOUBLE WHEN s <= 0.3::DOUBLE THEN (s - 0.1::DOUBLE) * 1.5 WHEN s <= 0.8::DOUBLE THEN 0.3::DOUBLE + (s - 0.3::DOUBLE) * 1.2 ELSE 0.9::DOUBLE END) END, 5) AS ramp, coalesce(abs(s - 0.5::DOUBLE) < 0.15::DOUBLE, true) AS abstains FROM s""",
    ),
    "evidence_rows": (evidence_rows, "SELECT doc_id, sha256(text) AS sha256, n_chars AS size_bytes, substr(split_part(text, chr(10), 1), 1, 64) AS title, strftime(make_timestamp((1767225600 + doc_id * 3601) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ingested_at FROM documents"),
    "match_basis": (
        match_basis,
        """WITH e AS (SELECT event_id, event_id % 21 = 0 AS same, CAST(event_id * 5 % 33 AS INTEGER) AS p, CASE WHEN event_id % 4 > 0 THEN CAST(event_id * 3 % 29 AS INTEGER) END AS dh, CASE WHEN event_id % 6 > 0 THEN CAST(event_id * 7 % 31 AS INTEGER) END AS ah FROM events),
s AS (SELECT *, CASE WHEN same THEN 0 WHEN p <= 12 THEN p WHEN least(p, dh, ah) <= 12 THEN least(p, dh, ah) END AS distance FROM e)
SELECT event_id, distance, CASE WHEN distance <= 6 THEN 'strong' ELSE 'possible' END AS band, concat_ws('+', CASE WHEN same THEN 'bytes' END, CASE WHEN p <= 12 THEN 'phash' END, CASE WHEN dh <= 12 THEN 'dhash' END, CASE WHEN ah <= 12 THEN 'ahash' END) AS basis FROM s WHERE distance IS NOT NULL""",
    ),
    "examination_digest": (examination_digest, """SELECT event_id, sha256('{"event_id":' || CASE WHEN event_id % 5 > 0 THEN CAST(event_id AS VARCHAR) ELSE 'null' END || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events"""),
}
