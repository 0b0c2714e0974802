"""Mixing sources to target weights, in DataFrame functions only.

* Sizes and targets.  Sources in code point order, NULL last, weigh 3, 1, 2, repeating, and share 150 % of all words.
  A target stops at twice its source's size and the excess is shared by weight among the others, which is a common
  level per weight: it is read off running sums over the sources ordered by size per weight.
* Pack.  Fully equal rows (doc_id, text and source) are one unit with a number of copies.  A source's units form one token
  stream in the order of (chunk, doc_id, md5 of the text); a chunk is a hash range of doc_id and text, so a large source's
  running offsets are sums of chunk totals plus sums inside small chunks, also where one doc_id is on very many rows.
  The stream is cut into blocks of 64 words (evenly, so that the last block is not a stump).  Sizes and digests are
  written once to the shared folder, so that texts are split into words once for all that follows.
* Draw.  The mix has a slot for each block it takes.  A pseudorandom permutation deals all slots to output shards: a
  multinomial draw of source counts per shard under the condition that the totals meet the targets, without which
  small sources would miss theirs and a document could appear three times.
* Map and join.  A source's slots run through pseudorandom permutations of its block indices, keyed by the source, one a
  pass, and blocks join by index: in ``mix`` the documents' shares of the blocks, in ``mixed_blocks`` the words.

The permutations of 0..n-1 are swap-or-not shuffles: in each round x and its partner k - x modulo n change places or don't,
by a hash bit of the larger of the two, which needs no bound on n and no table.

Every number comes from the data and fixed constants, so reruns and rerun tasks agree.

Nulls and edges: a NULL or blank text has size 0 and nothing taken; all sources empty: all targets 0; a NULL doc_id is
packed like any other; repeated rows are packed each, as are rows that share a doc_id; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.llm.common import durable, hot_keys, salted_join, table
from evidara.llm.op3_line_frequency import words_of

BLOCK, SHARD, CHUNK_DOCS, PIECE = 64, 1024, 2000, 4096
#: Chunks of documents for each task that makes slots.
TASK_CHUNKS = 8
TOTAL, MOST = 1.5, 2
#: Of the permutations: rounds, their multipliers, and the prime below 2**31 that hashes stay under.
PRIME = 2147483647
ROUNDS = tuple((48271 * (r + 1) ** 5 % PRIME, 69621 * (r + 2) ** 5 % PRIME) for r in range(6))
DEAL = 20240501


def permuted(at, n, key):
    """``at`` (0..n-1) mapped through the permutation of ``key`` (a number under 2**29); all three are columns."""
    at, n, key = at.cast("long"), n.cast("long"), key.cast("long")

    def turn(x, r):
        partner = F.pmod(F.pmod(key * r["times"] + r["turn"], n) - x, n)
        bit = F.pmod(F.pmod(F.greatest(x, partner), F.lit(PRIME)) * r["turn"] + key, F.lit(PRIME)) % 2
        return F.when(bit == 1, partner).otherwise(x)

    rounds = F.array(*[F.struct(F.lit(times).cast("long").alias("times"), F.lit(turn).cast("long").alias("turn")) for times, turn in ROUNDS])
    return F.aggregate(rounds, at, turn)


def key_of(mark):
    """A number under 2**28 of a string."""
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, 7), 16, 10).cast("long")


def chunks_of(docs: DataFrame) -> int:
    return -(-docs.select("doc_id").count() // CHUNK_DOCS) or 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, mark (the source as a non-null key), digest (of the text) and unit (hash of doc_id and text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return rows.withColumn("unit", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "digest").cast("binary")))


def packed(docs: DataFrame, n_chunks: int) -> DataFrame:
    """Units: doc_id, source, mark, unit, size (of one copy), copies and offset in the source's stream."""
    sized = keyed(docs).withColumn("size", F.size(words_of(F.col("text"))).cast("long")).drop("text")
    sized = durable(sized.groupBy("mark", "source", "doc_id", "digest", "unit", "size").agg(F.count(F.lit(1)).alias("copies")))
    sized = sized.withColumn("chunk", F.conv(F.substring("unit", 1, 8), 16, 10).cast("long") % n_chunks).withColumn("n", F.col("size") * F.col("copies"))
    before = Window.partitionBy("mark").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("mark", "chunk").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("mark", "chunk").agg(F.sum("n").alias("n")).select("mark", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = sized.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["mark", "chunk"])
    return durable(placed.select("doc_id", "source", "mark", "unit", "size", "copies", (F.col("start") + F.col("within")).alias("offset")))


def rows_of(units: DataFrame) -> DataFrame:
    """Each copy of a unit as a row with its own offset; very many copies are dealt to tasks first."""
    most = units.agg(F.max("copies")).first()[0] or 1
    if most == 1:
        return units.drop("copies")
    some = units.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PIECE}"))))
    if most > PIECE:
        some = some.repartition("mark", "unit", "piece")
    each = some.withColumn("copy", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("piece") * PIECE + PIECE, F.col("copies")) - 1)))
    return each.withColumn("offset", F.col("offset") + F.col("copy") * F.col("size")).drop("copies", "piece", "copy")


def plan_of(units: DataFrame) -> DataFrame:
    return targets(units.groupBy("mark", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target, its blocks (n_blocks of base or base + 1 words, the first ``extra`` ones longer) and slots."""
    one = Window.partitionBy(F.lit(0))
    weight = F.get(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    level = one.orderBy("per_weight", "mark")
    earlier, onward = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    plan = (
        sizes.withColumn("weight", weight)
        .withColumn("most", MOST * F.col("source_size"))
        .withColumn("per_weight", F.col("most") / F.col("weight"))
        .withColumn("level", (TOTAL * F.sum("source_size").over(one) - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("per_weight"), F.struct("per_weight", "mark", "level"))).over(one)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.col("most").cast("double")))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK))
        .withColumn("base", F.when(F.col("n_blocks") > 0, F.expr("source_size div n_blocks")).otherwise(0))
        .withColumn("extra", F.when(F.col("n_blocks") > 0, F.col("source_size") % F.col("n_blocks")).otherwise(0))
        .withColumn("n_slots", F.when(F.col("n_blocks") > 0, F.least(MOST * F.col("n_blocks"), F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5))).otherwise(0))
    )
    before = one.orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    return plan.select("source", "mark", "source_size", "target", "n_blocks", "base", "extra", "n_slots", F.coalesce(F.sum("n_slots").over(before), F.lit(0)).alias("first_slot"), F.sum("n_slots").over(one).alias("all_slots"))


def slots(plan: DataFrame, n_chunks: int) -> DataFrame:
    """mark, block, shard, slot: what each place of the mix holds.

    The number of tasks is given, as the few rows that become many slots would else be put into one.
    """
    pieces = plan.filter("n_slots > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n_slots - 1) div {PIECE}"))))
    spread = pieces.repartition(-(-n_chunks // TASK_CHUNKS), "mark", "piece")
    each = spread.withColumn("j", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("piece") * PIECE + PIECE, F.col("n_slots")) - 1)))
    place = permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), F.lit(DEAL))
    block = permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), key_of(F.col("mark")) + 7919 * F.expr("j div n_blocks"))
    drawn = each.select("mark", block.alias("block"), place.alias("place"))
    return drawn.select("mark", "block", F.floor(F.col("place") / SHARD).alias("shard"), (F.col("place") % SHARD).alias("slot"))


def _block_of(x):
    """The block that word x of a stream lies in."""
    longer = F.col("extra") * (F.col("base") + 1)
    return F.when(x < longer, F.floor(x / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((x - longer) / F.col("base")))


def _begin(i):
    """The first word of block i."""
    return i * F.col("base") + F.least(i, F.col("extra"))


def _placed(stream: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with words and their source's blocks; a source of very many rows is salted."""
    cut = plan.select("mark", "base", "extra")
    return salted_join(stream.filter("size > 0"), cut, ["mark"], hot_keys(plan, ["mark"], "n_blocks"), F.col("offset"))


def pieces(stream: DataFrame, plan: DataFrame) -> DataFrame:
    """mark, block, offset (of the row in its stream) and n: a row's share of each block."""
    last = F.col("offset") + F.col("size")
    cut = _placed(stream, plan).withColumn("block", F.explode(F.sequence(_block_of(F.col("offset")), _block_of(last - 1))))
    return cut.select("mark", "block", "offset", (F.least(last, _begin(F.col("block") + 1)) - F.greatest("offset", _begin(F.col("block")))).alias("n"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard (the first output shard with its words, or -1).

    Joins of what was exploded ask for a merge join: estimates don't see the explosion and would broadcast it.
    """
    n_chunks = chunks_of(docs)
    units = packed(docs, n_chunks)
    stream, plan = rows_of(units), durable(plan_of(units))
    joined = pieces(stream, plan).join(slots(plan, n_chunks).hint("merge"), ["mark", "block"])
    taken = joined.groupBy("mark", "offset").agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"))
    nowhere = -1 - F.pmod(F.xxhash64("unit"), F.lit(1 << 40))  # blank texts have no place, and not all the same key
    keyed = stream.withColumn("offset", F.when(F.col("size") > 0, F.col("offset")).otherwise(nowhere))
    out = keyed.join(taken.hint("merge"), ["mark", "offset"], "left")
    out = salted_join(out, plan.select("mark", "source_size", "target"), ["mark"], hot_keys(plan, ["mark"], "n_blocks"), F.col("offset"))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("first_shard", F.lit(-1)).alias("first_shard"))


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, source, doc_ids, n_words and text of the block there."""
    n_chunks = chunks_of(docs)
    units = packed(docs, n_chunks)
    plan = durable(plan_of(units))
    spans = _placed(units, plan)
    text = keyed(docs).select("mark", "unit", "text")
    whole = text.join(spans.filter("copies = 1").hint("merge"), ["mark", "unit"])
    each = _copies(whole)
    repeated = durable(units.filter("copies > 1 and size > 0").select("mark", "unit", F.col("copies").alias("n")))
    if not repeated.isEmpty():
        # one text for all copies of a unit, which are dealt out before they get their words
        found = salted_join(text, repeated, ["mark", "unit"], hot_keys(repeated, ["mark", "unit"]), F.spark_partition_id())
        once = found.groupBy("mark", "unit").agg(F.max("text").alias("text"))
        many = spans.filter("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PIECE}"))))
        # the copies of a text in parts: a unit of very many parts is salted
        parts_of = repeated.select("mark", "unit", F.expr(f"(n - 1) div {PIECE} + 1").alias("n"))
        dealt = salted_join(many, once, ["mark", "unit"], hot_keys(parts_of, ["mark", "unit"]), F.col("part")).repartition(n_chunks, "mark", "unit", "part")
        each = each.unionByName(_copies(dealt, F.col("part") * PIECE, F.least((F.col("part") + 1) * PIECE, "copies") - 1).select(*each.columns))
    skip = lambda i: F.greatest(_begin(i) - F.col("offset"), F.lit(0))
    until = lambda i: F.least(_begin(i + 1) - F.col("offset"), F.col("size"))
    share = F.transform(F.sequence(_block_of(F.col("offset")), _block_of(F.col("offset") + F.col("size") - 1)), lambda i: F.struct(i.alias("block"), F.slice("words", skip(i).cast("int") + 1, (until(i) - skip(i)).cast("int")).alias("words")))
    parts = each.select("mark", "source", "doc_id", "offset", F.explode(share).alias("part")).select("mark", "source", "part.block", F.struct("offset", "doc_id", "part.words").alias("part"))
    # a block has at most BLOCK parts
    blocks = parts.groupBy("mark", "block").agg(F.first("source").alias("source"), F.sort_array(F.collect_list("part")).alias("parts"))
    blocks = blocks.select("mark", "block", "source", F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("parts", lambda x: x["words"])).alias("words"))
    out = slots(plan, n_chunks).join(blocks.hint("merge"), ["mark", "block"])
    return out.select("shard", "slot", "source", "doc_ids", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("text"))


def _copies(whole: DataFrame, first=None, last=None) -> DataFrame:
    """Each copy of a unit, or those from ``first`` to ``last``, with its offset, and the words."""
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long") if first is None else first, F.col("copies") - 1 if last is None else last)))
    return each.withColumn("offset", F.col("offset") + F.col("copy") * F.col("size")).withColumn("words", words_of(F.col("text")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _permutation(name: str, of: str, x: str, n: str) -> str:
    """CTEs that map column x of table ``of`` through the permutation of column k; the last one is ``name``."""
    steps = []
    for r, (times, turn) in enumerate(ROUNDS):
        source, target = of if r == 0 else f"{name}{r}", name if r == len(ROUNDS) - 1 else f"{name}{r + 1}"
        partner = f"(((k * {times} + {turn}) % {n} - {x}) % {n} + {n}) % {n}"
        steps.append(f"""{target} AS (SELECT * REPLACE (CASE WHEN (greatest({x}, p) % {PRIME} * {turn} + k) % {PRIME} % 2 = 1 THEN p ELSE {x} END AS {x})
  FROM (SELECT * {'EXCLUDE (p)' if r else ''}, CAST({partner} AS BIGINT) AS p FROM {source}))""")
    return ", ".join(steps)


SQL = f"""
WITH s AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / {CHUNK_DOCS}) AS BIGINT)) AS chunk
  FROM documents
), stream AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY chunk, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM s
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS sz, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s GROUP BY source
), lev AS (
  SELECT *, 2 * sz / w AS r, ({TOTAL} * sum(sz) OVER () - coalesce(sum(2 * sz) OVER (ORDER BY 2 * sz / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * sz / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM src
), plan0 AS (
  SELECT source, sz, least(CAST(2 * sz AS DOUBLE), w * (SELECT arg_min(l, r) FROM lev WHERE l <= r)) AS target,
         CAST(ceil(sz / {BLOCK}) AS BIGINT) AS n FROM lev
), plan AS (
  SELECT *, least(2 * n, CAST(floor(target * n / sz + 0.5) AS BIGINT)) AS m, sz // n AS b, sz % n AS e FROM plan0 WHERE n > 0
), slot AS (
  SELECT source, CAST(n AS BIGINT) AS n, j, f + j AS place, total, CAST({DEAL} AS BIGINT) AS k
  FROM (SELECT source, n, CAST(unnest(range(0, m)) AS BIGINT) AS j, f, total
        FROM (SELECT *, CAST(coalesce(sum(m) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f, CAST(sum(m) OVER () AS BIGINT) AS total FROM plan))
), {_permutation('drawn', 'slot', 'place', 'total')}
, source_slot AS (
  SELECT source, n, j % n AS block, place // {SHARD} AS shard, CAST('0x' || substr(md5(coalesce('=' || source, '')), 1, 7) AS BIGINT) + 7919 * (j // n) AS k FROM drawn
), {_permutation('times', 'source_slot', 'block', 'n')}
, piece AS (
  SELECT doc_id, psource AS source, o, size, b, e, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS block FROM (
    SELECT doc_id, plan.source AS psource, o, size, b, e, CASE WHEN o < e * (b + 1) THEN o // (b + 1) ELSE e + (o - e * (b + 1)) // b END AS lo,
           CASE WHEN o + size - 1 < e * (b + 1) THEN (o + size - 1) // (b + 1) ELSE e + (o + size - 1 - e * (b + 1)) // b END AS hi
    FROM stream JOIN plan ON stream.source IS NOT DISTINCT FROM plan.source WHERE size > 0)
), took AS (
  SELECT p.doc_id, p.o, sum(least(o + size, (p.block + 1) * b + least(p.block + 1, e)) - greatest(o, p.block * b + least(p.block, e))) AS taken, min(shard) AS first_shard
  FROM piece p JOIN times ON p.source IS NOT DISTINCT FROM times.source AND p.block = times.block GROUP BY p.doc_id, p.o
)
SELECT stream.doc_id, size, sz AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(first_shard, -1) AS BIGINT) AS first_shard
FROM stream JOIN plan0 ON stream.source IS NOT DISTINCT FROM plan0.source LEFT JOIN took ON took.doc_id = stream.doc_id AND size > 0
"""
