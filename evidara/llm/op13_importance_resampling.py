"""Target-distribution importance resampling with features from word-id suffix arrays.

A text's features are its runs of 1 to ``most`` consecutive words, each hashed to a bucket.  Per batch of texts the words become
numbers and the suffixes of the number sequence are sorted by their first ``most`` words.  Neighbours' common-prefix
lengths cut that order into runs: a run of neighbours that share k words is one distinct k-gram, which is hashed once, and
its bucket is scattered to all places of the run.  So frequent n-grams cost one hash a batch.

* Census: bucket counts of the corpus and of the target texts, summed in each task and then over tasks; BUCKETS numbers
  reach the driver, whatever the number of texts.
* Weight: floored mean over a text's features of its buckets' gains, the logarithm of the target's smoothed share over the
  corpus's.  Score: weight plus a Gumbel variate from a hash of doc_id, so that the highest scores are a draw without replacement in
  proportion to the weights.
* Draw: scores are whole numbers of a bounded range, so a histogram gives the last score that is drawn.  Rows from that
  score on are put in order by ranges of (score, doc_id, row), and a row's rank is its place in its range after the sizes
  of the ranges before.  Nothing passes through one task.

Nulls and edges: a NULL or blank text has no features and weight 0; a NULL doc_id has the variate of the empty id and comes
after all other ids of its score; repeated rows count and are drawn one by one; an empty target gives all buckets the
same smoothed share; an empty table gives an empty result.  Extra columns are ignored (``resampled`` keeps them).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evidara.llm.common import durable, in_pieces, one_chunk, table, texts, window_starts

BUCKETS, MOST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Rows of a range whose order one task makes.
RANGE_ROWS = 2_000_000
#: A-Z lower-cased, 0-9, a-z and all bytes of other characters kept, the rest blanks.
_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[48:58], _FOLDED[97:123], _FOLDED[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLDED[65:91] = np.arange(97, 123)


def words_of(column) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's words begin (one more entry than texts)."""
    text = pc.fill_null(one_chunk(column).cast(pa.large_binary()), b"")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    folded = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(_FOLDED[data]))
    lists = pc.ascii_split_whitespace(folded)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words.filter(real), before[offsets]


def suffix_order(ids: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by the ``depth`` words from each on, and the words that each shares with the one before it."""
    end = np.repeat(offsets[1:], np.diff(offsets))
    ahead = np.full((depth, len(ids)), -1, np.int32)  # -1: past the text's end
    for k in range(depth):
        inside = np.flatnonzero(np.arange(len(ids)) + k < end)
        ahead[k, inside] = ids[inside + k]
    order = np.lexsort(ahead[::-1]) if depth > 1 else np.argsort(ahead[0], kind="stable")
    common, alike = np.zeros(len(ids), np.int64), np.ones(max(0, len(ids) - 1), bool)
    for k in range(depth):
        here = ahead[k, order]
        alike &= (here[1:] == here[:-1]) & (here[1:] >= 0)
        common[1:] += alike
    return order, common


def features(column, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the number of words of each text."""
    words, offsets = words_of(column)
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    order, common = suffix_order(ids, offsets, most)
    found, texts_ = [], []
    for k in range(1, most + 1):
        starts = window_starts(offsets, k)
        holds = np.zeros(len(ids), bool)
        holds[starts] = True
        inside = np.flatnonzero(holds[order])  # in suffix order; a k-gram's places are neighbours
        place, new = order[inside], common[inside] < k
        first = place[new]
        hashed = np.fromiter((zlib.crc32(" ".join([names[i] for i in ids[p : p + k]]).encode("utf-8", "surrogatepass")) % buckets for p in first), np.int64, len(first))
        scattered = np.empty(len(ids), np.int64)
        scattered[place] = hashed[np.cumsum(new) - 1]
        found.append(scattered[starts])
        texts_.append(np.searchsorted(offsets, starts, "right") - 1)
    return np.concatenate(found), np.concatenate(texts_), np.diff(offsets)


def census(rows: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in in_pieces(batches):
            total += np.bincount(features(batch["text"], most, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio)) of each bucket."""
    all_s, all_t, n = float(corpus.sum() + len(corpus)), float(target.sum() + len(target)), len(corpus)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * all_s / ((float(corpus[b]) + 1) * all_t))) for b in range(n)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int = MOST) -> DataFrame:
    """docs, all columns as they are, with __n_words, __n_features and __weight."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            bucket, text, n_words = features(batch["text"].cast(pa.string()), most, buckets)
            n = np.bincount(text, minlength=len(n_words))
            total = np.zeros(len(n_words), np.int64)
            np.add.at(total, text, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n), pa.array(weight)], names=[*batch.schema.names, "__n_words", "__n_features", "__weight"])

    more = [StructField(name, LongType()) for name in ("__n_words", "__n_features", "__weight")]
    return docs.mapInArrow(weigh, StructType([*docs.schema.fields, *more]))


def gumbel(doc_id, seed: str = SEED):
    """floor(1000 * a Gumbel variate) from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """__row and rank of the drawn rows of a written table with doc_id, __row, __n_words and __score."""
    fit = scored.filter(F.col("__n_words") >= least_words)
    levels = fit.groupBy("__score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("__score", ascending=False)  # a bounded range
    wanted = percent * int(levels["n"].sum()) // 100
    reached = levels["n"].cumsum() >= wanted
    if not wanted:
        return scored.limit(0).select("__row", F.lit(0).cast("long").alias("rank"))
    last, upto = int(levels["__score"][reached].iloc[0]), int(levels["n"].cumsum()[reached].iloc[0])
    keys = [F.col("__score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row").asc()]
    spread = max(1, -(-upto // RANGE_ROWS), min(upto // 10_000, scored.sparkSession.sparkContext.defaultParallelism))
    ordered = fit.filter(F.col("__score") >= last).select("__row", "__score", "doc_id").repartitionByRange(spread, *keys).sortWithinPartitions(*keys)
    # the number is range << 33 | place within the range
    placed = durable(ordered.select("__row", F.monotonically_increasing_id().alias("at")))
    sizes = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # one row a range
    start, before = {}, 0
    for r in sizes:
        start[r["range"]] = before
        before += r["n"]
    offsets = scored.sparkSession.createDataFrame(list(start.items()), "range long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(offsets), "range").select("__row", rank.alias("rank")).filter(F.col("rank") <= wanted)


def _scored(docs: DataFrame, target: DataFrame, most: int, buckets: int, seed: str) -> DataFrame:
    gain = gains(census(docs, most, buckets), census(target, most, buckets))
    found = weighed(docs, gain, most)
    return found.withColumn("__score", F.col("__weight") + gumbel(F.col("doc_id").cast("long"), seed)).withColumn("__row", F.monotonically_increasing_id())


def importance(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL if not drawn) of every row."""
    scored = durable(_scored(texts(docs), target, most, buckets, seed).drop("text"))
    drawn = ranked(scored, percent, least_words)
    return scored.join(drawn, "__row", "left").select("doc_id", F.col("__n_features").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score"), "rank")


def resampled(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The drawn rows, all columns as they are."""
    scored = durable(_scored(docs, target, most, buckets, seed))
    return scored.join(ranked(scored, percent, least_words).select("__row"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 of a distinct word from a table of 256 values that its own rule makes.  The rank is a DOUBLE because a column of
#: whole numbers and NULLs becomes one in pandas, where the results meet.
SQL = f"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8
), w AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), flat AS (SELECT side, doc_id, unnest(words) AS word FROM w
), counted AS (SELECT side, doc_id, word, count(*) AS n FROM flat GROUP BY ALL
), kinds AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)
), hashed AS (
  SELECT word, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(('0x' || substr(h, 2 * i - 1, 2)) AS BIGINT) for i in range(1, len(h) // 2 + 1)],
                               lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM kinds, crc
), by_bucket AS (
  SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM by_bucket) + {BUCKETS} AS DOUBLE)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM by_bucket) + {BUCKETS} AS DOUBLE)))) AS g
  FROM by_bucket
), weight AS (
  SELECT doc_id, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weight USING (doc_id) WHERE side = 'd'
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT scored.*, CAST(CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS DOUBLE) AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
