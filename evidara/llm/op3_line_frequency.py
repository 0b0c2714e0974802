"""Quality rules: base counts of a text and cross-document line frequency, in DataFrame functions only.

Lines are normalised (white space runs become one blank, trimmed, lower case) and hashed.  Per host (``source``) the
number of distinct documents that hold a line is counted; documents of equal text count once, so that exact copies,
which a dedup stage owns, don't condemn each other.  A line is above the limit if more than
max(``least``, ``share`` of the host's distinct documents) hold it.  ``without_frequent_lines`` removes such lines from
the texts; ``quality_rules`` rejects a document that would keep under ``keep`` of its words as depleted.

Nulls and edges: a NULL text has no words and fails the base rule; a NULL source is a host of its own; rows are judged
one by one, so repeated rows and NULL doc_ids get the same answers as single ones; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import WORD_BREAK, durable, hot_keys, salted_join, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST, SHARE, KEEP = 5, 0.005, 0.5
#: The frequent lines are repeated so often, and a line's rows are dealt over as many keys.
SALTS = 16
#: So many frequent lines at most are sent to all tasks.
SENT_LINES = 200_000


def words_of(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a table with a text."""
    text = F.coalesce("text", F.lit(""))
    held = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    triples = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p"))))
    again = F.filter("sorted", lambda x, i: (F.get("sorted", i - 1)["h"] == x["h"]) | F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False)))
    step = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))))
    return (
        docs.withColumn("words", words_of(F.col("text")))
        .withColumn("held", held)
        .withColumn("sorted", F.sort_array(F.coalesce(triples, F.array().cast("array<struct<h:bigint,p:int>>"))))
        .withColumn("places", F.sort_array(F.transform(again, lambda x: x["p"])))
        .select(
            *docs.columns,
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("held") - F.size(F.array_distinct("held"))).cast("long").alias("n_dup_lines"),
            F.aggregate(step, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _host():
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _normal(line):
    return F.lower(F.trim(F.regexp_replace(line, WORD_BREAK, " ")))


def text_lines(docs: DataFrame) -> DataFrame:
    """host, content (hash of the text), line (hash), n (words), places in the text: one row for a line of a text, its words summed over the text's copies."""
    docs = docs.select(_host().alias("host"), F.xxhash64("text").alias("content"), "text").filter("text is not null")
    lines = (
        docs.select("host", "content", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .select("host", "content", "place", _normal(F.col("line")).alias("line"))
        .filter("line <> ''")
        .select("host", "content", "place", F.xxhash64("line").alias("line"), F.size(F.split("line", " ")).alias("n"))
    )
    return lines.groupBy("host", "content", "line").agg(F.sum("n").alias("n"), F.collect_set("place").alias("places"))


def frequent_lines(docs: DataFrame, once: DataFrame, least: int, share: float) -> DataFrame:
    """host, line (hash) of the lines above the limit."""
    sizes = docs.filter("text is not null").select(_host().alias("host"), F.xxhash64("text").alias("content")).groupBy("host").agg(F.countDistinct("content").alias("host_docs"))
    frequent = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > least)
    return frequent.join(sizes, "host").filter(F.col("n_docs") > F.greatest(F.lit(float(least)), share * F.col("host_docs"))).select("host", "line")


def marked_lines(docs: DataFrame, least: int, share: float) -> DataFrame:
    """``text_lines`` with above: true or NULL."""
    once = text_lines(docs)
    frequent = frequent_lines(docs, once, least, share)
    frequent = frequent.select("host", "line", F.lit(True).alias("above"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return once.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int")).join(frequent, ["host", "line", "salt"], "left")


def losses(docs: DataFrame, least: int = LEAST, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """host, content (hash of the text), n_frequent_words and depleted, of documents that lose words at all."""
    marked = marked_lines(docs, least, share)
    lost = marked.groupBy("host", "content").agg(F.sum(F.when(F.col("above"), F.col("n")).otherwise(0)).alias("lost"), F.sum("n").alias("n")).filter("lost > 0")
    copies = docs.select(_host().alias("host"), F.xxhash64("text").alias("content")).groupBy("host", "content").agg(F.count(F.lit(1)).alias("copies"))
    one = lost.join(copies, ["host", "content"])  # both have one row a text, however many copies it has
    return one.select("host", "content", F.expr("lost div copies").alias("n_frequent_words"), (F.col("n") - F.col("lost") < keep * F.col("n")).alias("depleted"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, n_frequent_words (in lines above the limit), depleted and kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    host, content = _host(), F.xxhash64("text")
    judged = base_counts(docs).withColumn("host", host).withColumn("content", content).drop("text")
    copies = docs.select(host.alias("host"), content.alias("content")).groupBy("host", "content").agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(judged, losses(docs), ["host", "content"], hot_keys(copies, ["host", "content"]), F.col("doc_id"), "left")
    out = out.withColumn("depleted", F.coalesce("depleted", F.lit(False))).withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "depleted", (~F.col("base_failed") & ~F.col("depleted")).alias("kept"))


def without_frequent_lines(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows, all columns as they are but the text, which loses its lines above the limit, and n_removed_lines.

    Up to SENT_LINES such lines go to the texts, as a list a host; of more, each text's places to cut go to the text.
    """
    frequent = durable(frequent_lines(docs, text_lines(docs), least, share))
    if frequent.limit(SENT_LINES + 1).count() > SENT_LINES:
        return _cut_by_places(docs, least, share)
    lists = frequent.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__list"))
    joined = docs.withColumn("__h", _host()).join(F.broadcast(lists), F.col("__h") == F.col("__host"), "left")
    joined = joined.withColumn("__lines", F.split("text", "\n"))
    joined = joined.withColumn("__hashes", F.when(F.col("__list").isNotNull(), F.transform("__lines", lambda x: F.when(_normal(x) != "", F.xxhash64(_normal(x))))))
    joined = joined.withColumn("__bad", F.array_compact(F.array_intersect("__hashes", "__list")))
    kept = F.filter("__lines", lambda x, i: ~F.coalesce(F.array_contains("__bad", F.get("__hashes", i)), F.lit(False)))
    joined = joined.withColumn("__kept", F.when(F.size("__bad") > 0, kept))
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    removed = F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("long")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], removed.alias("n_removed_lines"))


def _cut_by_places(docs: DataFrame, least: int, share: float) -> DataFrame:
    """The same where the frequent lines are too many to send."""
    cut = marked_lines(docs, least, share).filter("above").groupBy("host", "content").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("cut"))
    copies = docs.select(_host().alias("__h"), F.xxhash64("text").alias("__c")).groupBy("__h", "__c").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(docs.withColumn("__h", _host()).withColumn("__c", F.xxhash64("text")), cut.toDF("__h", "__c", "__cut"), ["__h", "__c"], hot_keys(copies, ["__h", "__c"]), F.spark_partition_id(), "left")
    # what lies between two places that are cut, so that the work is in proportion to the lines
    joined = joined.withColumn("__lines", F.split("text", "\n")).withColumn("__edges", F.concat(F.array(F.lit(-1)), "__cut", F.array(F.size("__lines"))))
    between = F.transform(F.sequence(F.lit(0), F.size("__edges") - 2), lambda i: F.slice("__lines", F.get("__edges", i) + 2, F.get("__edges", i + 1) - F.get("__edges", i) - 1))
    text = F.when(F.col("text").isNull() | F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    removed = F.when(F.col("text").isNull() | F.col("__cut").isNull(), 0).otherwise(F.size("__cut")).cast("long")
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], removed.alias("n_removed_lines"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, text IS NULL AS missing,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS held FROM documents
), tri AS (
  SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)
), twice AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT tri.doc_id, unnest([p, p + 1, p + 2]) AS pos FROM tri JOIN twice USING (doc_id, g)) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, host, t, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(held) - len(list_distinct(held)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), contents AS (SELECT DISTINCT host, t FROM w WHERE NOT missing
), lines AS (
  SELECT host, t, lower(trim(regexp_replace(unnest(string_split(t, chr(10))), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line FROM contents
), once AS (SELECT host, t, line, sum(len(string_split(line, ' '))) AS n FROM lines WHERE line <> '' GROUP BY ALL
), frequent AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS n_docs FROM once GROUP BY host, line)
  JOIN (SELECT host, count(*) AS host_docs FROM contents GROUP BY host) USING (host)
  WHERE n_docs > greatest({LEAST}, {SHARE} * host_docs)
), lost AS (
  SELECT o.host, o.t, sum(CASE WHEN f.line IS NULL THEN 0 ELSE n END) AS away, sum(n) AS n FROM once o LEFT JOIN frequent f ON o.host = f.host AND o.line = f.line
  GROUP BY o.host, o.t
), judged AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(coalesce(away, 0) AS BIGINT) AS n_frequent_words,
         coalesce(n - away < {KEEP} * n, FALSE) AS depleted
  FROM base LEFT JOIN lost ON lost.host = base.host AND lost.t = base.t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_words, depleted,
       NOT base_failed AND NOT depleted AS kept FROM judged
"""


def op3_line_frequency_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row how many lines are removed, and the digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return without_frequent_lines(docs).select("doc_id", "n_removed_lines", F.md5(F.col("text").cast("binary")).alias("digest"))


REMOVED_SQL = f"""
WITH contents AS (SELECT DISTINCT coalesce(source, chr(0)) AS host, text AS t FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT host, t, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS p FROM contents
), lines AS (SELECT *, lower(trim(regexp_replace(raw, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line FROM raw
), frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n_docs FROM lines WHERE line <> '' GROUP BY host, line)
  JOIN (SELECT host, count(*) AS host_docs FROM contents GROUP BY host) USING (host)
  WHERE n_docs > greatest({LEAST}, {SHARE} * host_docs)
), clean AS (
  SELECT l.host, l.t, count(f.line) AS n, coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (WHERE f.line IS NULL), '') AS clean
  FROM lines l LEFT JOIN frequent f ON l.host = f.host AND l.line = f.line GROUP BY l.host, l.t
)
SELECT doc_id, coalesce(n, 0) AS n_removed_lines, md5(clean) AS digest
FROM documents d LEFT JOIN clean c ON c.host = coalesce(d.source, chr(0)) AND c.t = d.text
"""
