"""Similarity search, exact duplicates and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import hashing
from evidara.operators import evaluation, latest, neighbours
from evidara.operators.skew import salted_join
from evidara.sources.tables import table


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), hashing.mean_hash(F.col("embedding")).alias("value"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("value"))


def hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    found = neighbours.hamming_top_k(h, h, 5)
    return found.withColumn("similarity", hashing.similarity(F.col("distance"))).withColumn("band", hashing.band(F.col("distance"), strong=16))


def hamming_bands(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    return neighbours.hamming_within(h, h, 17, 9).withColumn("band", hashing.band(F.col("distance"), strong=16))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return neighbours.cosine_top_k(v, v, 5, 0.2).select("query", "candidate", "rank", F.round("similarity", 5).alias("similarity"))


def _verified(spark: SparkSession, d: str) -> DataFrame:
    h, v = _hashes(spark, d), _vectors(spark, d)
    owner = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("digest"))  # equal labels stand for equal bytes
    pool = neighbours.hamming_top_k(h, h, 15).join(owner.toDF("query", "q"), "query").join(owner.toDF("candidate", "c"), "candidate")
    pool = pool.withColumn("same_bytes", F.col("q") == F.col("c")).drop("q", "c")
    return neighbours.ranked_candidates(pool, neighbours.cosine_top_k(v, v, 3, 0.3), 15, 5, 20)


def multi_signal_verify(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select("query", "candidate", F.col("distance").cast("string").alias("distance"), "rank", "band")


def stored_match_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per query its candidates by band, the nearest and the most similar one."""
    out = neighbours.match_summary(_verified(spark, d))
    return out.withColumn("least_distance", F.col("least_distance").cast("string")).withColumn("most_similarity", F.round("most_similarity", 5))


def min_distance(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    found = neighbours.hamming_top_k(h, h, 1)
    return found.select("query", F.col("candidate").alias("nearest"), "distance")


def recall_at_k_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    h = _hashes(spark, d)
    found = neighbours.hamming_top_k(h, h, 10).join(e.toDF("query", "label"), "query").join(e.toDF("candidate", "other"), "candidate")
    ranked = found.select(F.col("label").cast("string").alias("category"), "query", "rank", (F.col("label") == F.col("other")).alias("relevant"))
    out = evaluation.recall_at(evaluation.first_hit(ranked))
    return out.select("category", "n_queries", *[F.round(c, 9).alias(c) for c in out.columns if c.startswith("recall")])


def false_match_rate(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    pairs = evaluation.distractor_pairs(h.select("id", F.col("id").alias("pos")))
    both = pairs.join(h.toDF("a", "va"), "a").join(h.toDF("b", "vb"), "b")
    return both.withColumn("distance", hashing.hamming(F.col("va"), F.col("vb"))).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("distance") <= 28).alias("n_matched"))


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    groups = docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")
    return salted_join(docs, groups, ["sha256"], F.col("doc_id"))  # the members as rows: a group may hold any number


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return latest.first_per_key(docs, ["source", "sha256"], ["doc_id"])


def contamination_exact(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items whose text is a whole document."""
    key = lambda c: F.sha2(F.lower(F.trim(c)), 256)
    items = table(spark, d, "benchmark").select("item_id", key(F.col("text")).alias("k"))
    return table(spark, d, "documents").select("doc_id", key(F.col("text")).alias("k")).join(items, "k").select("item_id", "doc_id")


_H = """h AS (SELECT vec_id AS id, CAST(array_to_string([CASE WHEN CAST(x AS DOUBLE) > m THEN '1' ELSE '0' END for x in embedding], '') AS BIT) AS v
  FROM (SELECT vec_id, embedding, list_sum([CAST(x AS DOUBLE) for x in embedding]) / len(embedding) AS m FROM embeddings)),
near AS (SELECT a.id AS query, b.id AS candidate, CAST(bit_count(xor(a.v, b.v)) AS INTEGER) AS distance FROM h a JOIN h b ON a.id <> b.id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, candidate) AS INTEGER) AS rank FROM near)"""
_C = """cosv AS (SELECT a.vec_id AS query, b.vec_id AS candidate, list_sum([CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE) for x in list_zip(a.embedding, b.embedding)]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
cosr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, candidate) AS INTEGER) AS rank FROM cosv WHERE s >= {floor})"""

_VERIFIED = f"""WITH {_H}, {_C.format(floor=0.3)},
both_ AS (SELECT coalesce(r.query, c.query) AS query, coalesce(r.candidate, c.candidate) AS candidate, r.distance, r.same AS same_bytes, c.s
  FROM (SELECT ranked.*, q.label = c.label AS same FROM ranked JOIN embeddings q ON q.vec_id = query JOIN embeddings c ON c.vec_id = candidate WHERE rank <= 15) r
  FULL JOIN (SELECT * FROM cosr WHERE rank <= 3) c ON r.query = c.query AND r.candidate = c.candidate),
kept AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coalesce(same_bytes, false) DESC, coalesce(distance, 999), greatest(1 - distance / 64.0::DOUBLE, s) DESC, candidate) AS r
  FROM both_ WHERE coalesce(same_bytes, false) OR distance <= 20 OR s IS NOT NULL),
verified AS (SELECT query, candidate, distance, s, CAST(r AS INTEGER) AS rank, CASE WHEN coalesce(distance, 999) <= 6 OR coalesce(s >= 0.85, false) THEN 'strong' ELSE 'possible' END AS band FROM kept WHERE r <= 5)"""

QUERIES = {
    "hamming_topk": (hamming_topk, f"WITH {_H} SELECT query, candidate, distance, rank, 1 - distance / 64.0::DOUBLE AS similarity, CASE WHEN distance <= 16 THEN 'strong' ELSE 'possible' END AS band FROM ranked WHERE rank <= 5"),
    "hamming_bands": (hamming_bands, f"WITH {_H} SELECT query AS a, candidate AS b, distance, CASE WHEN distance <= 16 THEN 'strong' ELSE 'possible' END AS band FROM near WHERE distance <= 17"),
    "cosine_topk": (cosine_topk, f"WITH {_C.format(floor=0.2)} SELECT query, candidate, rank, round(s, 5) AS similarity FROM cosr WHERE rank <= 5"),
    "multi_signal_verify": (multi_signal_verify, f"{_VERIFIED} SELECT query, candidate, CAST(distance AS VARCHAR) AS distance, rank, band FROM verified"),
    "stored_match_summary": (
        stored_match_summary,
        f"""{_VERIFIED} SELECT query, count(*) FILTER (WHERE band = 'strong') AS n_strong, count(*) FILTER (WHERE band = 'possible') AS n_possible, count(*) AS n_candidates,
  CAST(min(distance) AS VARCHAR) AS least_distance, round(max(greatest(1 - distance / 64.0::DOUBLE, s)), 5) AS most_similarity FROM verified GROUP BY query""",
    ),
    "min_distance": (min_distance, f"WITH {_H} SELECT query, arg_min(candidate, CAST(distance AS BIGINT) * 1000000000 + candidate) AS nearest, min(distance) AS distance FROM near GROUP BY query"),
    "recall_at_k_rollup": (
        recall_at_k_rollup,
        f"""WITH {_H}, hit AS (SELECT CAST(q.label AS VARCHAR) AS category, r.query, min(CASE WHEN q.label = c.label THEN rank END) AS hit
  FROM ranked r JOIN embeddings q ON q.vec_id = r.query JOIN embeddings c ON c.vec_id = r.candidate WHERE rank <= 10 GROUP BY 1, 2)
SELECT coalesce(category, 'overall') AS category, count(*) AS n_queries, {", ".join(f"round(avg(CASE WHEN coalesce(hit <= {k}, false) THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_{k}" for k in (1, 3, 5, 10))}
FROM hit GROUP BY ROLLUP (category)""",
    ),
    "false_match_rate": (false_match_rate, f"WITH {_H} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE distance <= 28) AS n_matched FROM near WHERE candidate - query BETWEEN 1 AND 3"),
    "exact_dup_groups": (exact_dup_groups, "SELECT * FROM (SELECT doc_id, sha256(text) AS sha256, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE n > 1"),
    "dedup_first_wins": (dedup_first_wins, "SELECT min(doc_id) AS doc_id, source, sha256(text) AS sha256 FROM documents GROUP BY source, text"),
    "contamination_exact": (contamination_exact, "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON lower(trim(d.text)) = lower(trim(b.text))"),
}
