"""Near-duplicate classes by SetSketch registers.

A document's set holds its distinct shingles of ``width`` words, five by default and two in the query (with fewer words
the whole sequence).  For each of 128 registers
every shingle has an exponential variate of rate 20; the register keeps the smallest one, x, as the integer
floor(1 - log_b x) truncated to 0..65535 with b = 1.0005: exponentially spaced minima.  Equal sets have equal
registers, the union's register is the larger of two registers, and two sets agree on a register with about the
probability of their Jaccard similarity.

* Equal sets collapse first (two 64-bit sums over the set), so copies cost one representative.
* Band: 32 bands of 4 registers.  Representatives at similarity 0.8 miss all bands with probability 5e-8.
* Estimate: the joint likelihood of (larger, equal, smaller) registers and the two set sizes gives the similarity;
  a pair more than four standard errors under the threshold is not likely.  Sizes alone also rule out pairs.
* Verify: exact intersections of the full sets.

In a bucket nobody is paired with everybody.  First all members pair with the bucket's smallest id; likely pairs make
families.  A bucket that still holds several families compares its members' sketches across them inside one task and
sends on one likely pair for two families, no more.  So all pairs that share a bucket and are likely end up in one
family.  A family's full sets then meet in one task, each sent once; there each member's intersections with all others are
counted at once, and a link is sent on only if it joins what was not joined before.  Large families are cut into chunks
that all meet the first chunk; then what that has not joined into one component meets the rest, chunk by chunk, and
likewise in large buckets.  So no pair that could matter is lost, no task grows, and a huge group of near copies of one
another is sent a fixed number of times.

A representative is a set, not a doc_id, with a number that the checkpoint fixes; a component's id is the smallest doc_id of
its documents.  Keys that hold very many rows (a bucket, a set with very many copies, a large family) are salted in joins.

Nulls and edges: documents without words have n_shingles 0, link with nothing and are their own component; a NULL
doc_id takes no part, gets a NULL component and is not kept; rows that share a doc_id are judged each by its own text and
are not linked by the id; an empty table gives an empty result.  Extra columns are ignored.
``without_near_duplicates`` keeps exactly one row of each class (smallest doc_id, then hash of the row), also of fully equal
rows, and every row without words or doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import code_words, durable, hot_keys, in_pieces, rolling, row_hash, salted_join, split_words, table, texts, window_starts

REGISTERS, ROWS, BASE, RATE = 128, 4, 1.0005, 20.0
#: Members of a bucket's chunk and shingles of a family's chunk; they set the memory of one task.
BUCKET_ROWS, FAMILY_SHINGLES = 4096, 1_500_000
SAME = ["n_shingles", "sum1", "sum2"]
SIGNATURE = "doc_id long, row long, n_shingles long, sum1 long, sum2 long, registers binary"
_FACTORS = np.random.default_rng(20240229).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle codes of each text, one after the other, and where each text's begin."""
    words, offsets = split_words(column)
    index, codes, _ = code_words(words, lower=True)
    codes = codes[index]
    lengths = np.diff(offsets)
    starts = window_starts(offsets, width)
    text = np.searchsorted(offsets, starts, "right") - 1
    values = rolling(codes, width)[starts] if len(starts) else np.empty(0, np.uint64)
    for i in np.flatnonzero((lengths > 0) & (lengths < width)):  # the whole sequence is the only shingle
        n = int(lengths[i])
        own = rolling(codes[offsets[i] : offsets[i + 1]], n) ^ np.uint64(n)
        values, text = np.append(values, own), np.append(text, i)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(lengths) + 1))


def registers_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16[texts, REGISTERS].  The minimum of the hashes is that of the exponentials, which fall with them."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    least = np.empty((len(full), REGISTERS), np.uint64)
    step = 1 << 15  # a slice that stays in the processor's cache
    begin = offsets[full]
    least[:] = np.iinfo(np.uint64).max
    for a in range(0, len(values), step):
        part = values[a : a + step]
        i = np.searchsorted(begin, a, "right") - 1
        j = np.searchsorted(begin, a + len(part), "left")
        cuts = np.maximum(begin[i:j] - a, 0)
        for k in range(REGISTERS):
            np.minimum(least[i:j, k], np.minimum.reduceat(part * _FACTORS[k], cuts), out=least[i:j, k])
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def set_sums(values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """n_shingles, sum1 and sum2 of each set: equal sets have equal ones."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    mixed = np.concatenate([[np.uint64(0)], np.cumsum((values ^ (values >> np.uint64(29))) * _FACTORS[0], dtype=np.uint64)])
    return [pa.array(np.diff(offsets)), *(pa.array((x[offsets[1:]] - x[offsets[:-1]]).view(np.int64)) for x in (total, mixed))]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Of doc_id, text and row: all but the text, the size and sums of its set and the registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            values, offsets = shingle_sets(batch["text"], width)
            registers = pa.array([r.tobytes() for r in registers_of(values, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], *set_sums(values, offsets), registers], names=["doc_id", "row", *SAME, "registers"])

    return docs.mapInArrow(sign, SIGNATURE)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity J of most likelihood from the counts of larger, equal and smaller registers and the set sizes.

    For a base this close to 1 a register of A is the larger with the probability u that the union's smallest element
    is only in A, smaller with v, equal with J.  The sizes give u = p (1 + J) - J and v = (1 - p) (1 + J) - J with
    p = n_a / (n_a + n_b), so the log-likelihood is concave in J and its slope is bisected.
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - up - down
    p = n_a / np.maximum(n_a + n_b, 1)
    low, high = np.zeros(len(p)), np.minimum(p, 1 - p) / np.maximum(np.maximum(p, 1 - p), 1e-12)
    for _ in range(30):
        j = (low + high) / 2
        u, v = np.maximum(p - (1 - p) * j, 1e-12), np.maximum(1 - p - p * j, 1e-12)
        rising = equal / np.maximum(j, 1e-12) > up * (1 - p) / u + down * p / v
        low, high = np.where(rising, j, low), np.where(rising, high, j)
    return (low + high) / 2


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node it reaches) for edges a, b: labels flow along edges and are followed to their own label.

    A node with very many edges and a label that very many nodes have are dealt out in the joins.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    hot_nodes = durable(hot_keys(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["b"]))
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = salted_join(both, labels.toDF("b", "component"), ["b"], hot_nodes, F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("other"))
        hot_labels = hot_keys(labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")), ["component"])
        seen = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "other").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = durable(salted_join(seen, jump, ["component"], hot_labels, F.col("node"), "left").select("node", "old", F.coalesce("further", "component").alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels


def in_chunks(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Deals rows of (group, label, weight) to tasks (group, low, high) in which all pairs of unlike labels meet.

    A group of up to ``most`` weight is one chunk.  In a larger one the label with the most weight is cut into chunks of
    its own, which never meet one another; the other rows' chunks meet those and each other.  So a group that is nearly all
    of one label is sent once, whatever its size.  Groups of a single label are left out.
    """
    by_label = rows.groupBy(group, "label").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    total = by_label.groupBy(group).agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.max("w").alias("w_main"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    chunks = lambda w: F.greatest(F.ceil(w / most), F.lit(1))
    total = durable(total.filter("w > w_main").select(group, "main", "n", (F.col("w") <= most).alias("small"), chunks(F.col("w_main")).alias("n_main"), chunks(F.col("w") - F.col("w_main")).alias("n_rest")))
    cut, spread = salted_join(rows, total.drop("n"), [group], hot_keys(total, [group]), F.col("rep")), F.xxhash64("rep")
    is_main = F.col("label") == F.col("main")
    own = F.when(F.col("small"), 0).when(is_main, F.pmod(spread, F.col("n_main"))).otherwise(F.col("n_main") + F.pmod(spread, F.col("n_rest")))
    last = F.col("n_main") + F.col("n_rest") - 1
    other = F.when(F.col("small"), F.array(F.lit(0).cast("long"))).when(is_main, F.sequence(F.col("n_main"), last)).otherwise(F.sequence(F.lit(0).cast("long"), last))
    met = cut.withColumn("own", own.cast("long")).withColumn("_other", F.explode(other))
    return met.withColumn("low", F.least("own", "_other")).withColumn("high", F.greatest("own", "_other")).select(*rows.columns, "own", "low", "high")


def to_anchor(rows: DataFrame, total: DataFrame, group: str, most: int) -> DataFrame:
    """As ``in_chunks``, but every chunk only meets the group's first; ``total`` has each group's weight w and rows n."""
    chunks = total.select(group, F.greatest(F.ceil(F.col("w") / most), F.lit(1)).alias("chunks"))
    cut = salted_join(rows, chunks, [group], hot_keys(total, [group]), F.col("rep")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    met = cut.withColumn("high", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("own"))))
    return met.withColumn("low", F.lit(0).cast("long")).select(*rows.columns, "own", "low", "high")


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles and component_id of docs with doc_id, text and row."""
    signed = durable(signatures(docs, width))
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    # the checkpoint fixes the numbers
    reps = durable(real.groupBy(*SAME).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("registers").alias("registers")).withColumn("rep", F.monotonically_increasing_id()))
    band = F.posexplode(F.array(*[F.xxhash64(F.substring("registers", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(REGISTERS // ROWS)]))
    keyed = reps.select("rep", band.alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket"))
    shared = durable(keyed.groupBy("bucket").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hot_buckets = hot_keys(shared, ["bucket"])
    members = durable(salted_join(keyed, shared.select("bucket", "center"), ["bucket"], hot_buckets, F.col("rep")))
    sized = reps.select("rep", "n_shingles", "registers")
    floor = percent / 100 - 4 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    @F.pandas_udf("double")
    def likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        stack = lambda s: np.frombuffer(b"".join(s), np.uint16).reshape(len(s), REGISTERS)
        return pd.Series(estimate(stack(a), stack(b), n_a.to_numpy(), n_b.to_numpy()))

    stars = members.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    hot_centers = hot_keys(shared.groupBy(F.col("center").alias("a")).agg(F.sum("n").alias("n")), ["a"])
    a, b = sized.toDF("a", "n_a", "registers_a"), sized.toDF("b", "n_b", "registers_b")
    near = salted_join(stars, a, ["a"], hot_centers, F.col("b")).join(b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    edges = durable(near.filter(likely("registers_a", "registers_b", "n_a", "n_b") >= floor).select("a", "b"))

    def with_family(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.toDF("rep", "family"), "rep", "left").withColumn("family", F.coalesce("family", "rep"))

    placed = durable(with_family(members, components(edges)))
    mixed = placed.groupBy("bucket").agg(F.min("family").alias("least"), F.max("family").alias("most")).filter("least < most").select("bucket")
    between = salted_join(placed, mixed, ["bucket"], hot_buckets, F.col("rep")).join(sized, "rep").select("bucket", "rep", F.col("family").alias("label"), "n_shingles", "registers", F.lit(1).alias("weight"))
    more = in_chunks(between, "bucket", BUCKET_ROWS).groupBy("bucket", "low", "high").applyInArrow(_likely_across(percent, floor), "a long, b long").distinct()
    edges = durable(edges.union(more))

    families = components(edges).toDF("rep", "family")
    total = durable(families.join(sized, "rep").groupBy("family").agg(F.sum("n_shingles").alias("w"), F.count(F.lit(1)).alias("n")))
    # the set of a family's member comes from a document with that set; others of the same doc_id fall out in the second join
    wanted = families.join(reps.select("rep", "first_id", *SAME), "rep")
    whole = docs.join(wanted.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(width), "n_shingles long, sum1 long, sum2 long, shingles array<long>")
    held = whole.dropDuplicates(SAME).join(wanted.drop("first_id"), SAME).select("rep", "family", "shingles", F.col("n_shingles").alias("weight"))
    met = to_anchor(held.withColumn("label", F.col("rep")), total, "family", FAMILY_SHINGLES)
    links = durable(met.groupBy("family", "low", "high").applyInArrow(_linked(percent), "a long, b long"))
    if not total.filter(F.col("w") > FAMILY_SHINGLES).isEmpty():
        # in families of several chunks, what the first chunk has not joined meets the rest
        so_far = held.join(components(links).toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        links = durable(links.union(in_chunks(so_far, "family", FAMILY_SHINGLES).groupBy("family", "low", "high").applyInArrow(_linked(percent), "a long, b long")))
    labels = components(links).toDF("rep", "label")
    ids = durable(labels.join(reps.select("rep", "first_id"), "rep").groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    joined = salted_join(labels, ids.drop("n"), ["label"], hot_keys(ids, ["label"]), F.col("rep"))
    classes = reps.join(joined, "rep", "left").select(*SAME, F.coalesce("component_id", "first_id").alias("component_id"))
    placed = salted_join(signed.select("doc_id", "row", *SAME), classes, SAME, hot_keys(reps, SAME), F.col("doc_id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links at 100 * intersection >= percent * union, confirmed on full sets."""
    found = _classes(texts(docs, F.lit(0).cast("long").alias("row")), width, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, all columns as they are, and the rows without words or doc_id."""
    found = _classes(texts(docs, row_hash(docs).alias("row")), width, percent).filter("n_shingles > 0 and doc_id is not null")
    each = durable(found.groupBy("doc_id", "row").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    first = each.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.*")
    gone = each.join(first, ["doc_id", "row"], "left_anti").select("doc_id", "row")
    again = durable(each.filter("n > 1").join(first, ["doc_id", "row"], "left_semi").select("doc_id", "row"))
    repeats = not again.isEmpty()
    keys, hot = ["__id", "__row"], hot_keys(each, ["doc_id", "row"]).toDF("__id", "__row")
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__row", row_hash(docs))
    left = lambda rows, how: salted_join(keyed, rows.toDF(*keys), keys, hot, F.spark_partition_id(), how)
    out = left(gone.union(again) if repeats else gone, "left_anti")
    if repeats:  # fully equal rows
        out = out.unionByName(left(again, "left_semi").dropDuplicates(keys))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            values, offsets = shingle_sets(batch["text"], width)
            shingles = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*set_sums(values, offsets), shingles], names=[*SAME, "shingles"])

    return sets


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.min(axis=1, initial=np.iinfo(np.int64).max), "b": pairs.max(axis=1, initial=np.iinfo(np.int64).min)})


def _likely_across(percent: int, floor: float):
    """One likely pair for each two families of a bucket's chunks that have one, as far as not joined by others."""

    def across(bucket: pa.Table) -> pa.Table:
        rep, n, label, own = (bucket[c].to_numpy() for c in ("rep", "n_shingles", "label", "own"))
        sketch = np.frombuffer(b"".join(bucket["registers"].to_pylist()), np.uint16).reshape(len(rep), REGISTERS)
        apart = bucket["low"][0].as_py() != bucket["high"][0].as_py()
        names, sizes = np.unique(label, return_counts=True)
        found = []
        for i in np.flatnonzero(label != names[sizes.argmax()]):  # one of any two families isn't the largest
            fits = (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (label != label[i])
            if apart:
                fits &= own != own[i]
            other = np.flatnonzero(fits)
            if len(other):
                other = other[estimate(sketch[other], sketch[[i]], n[other], n[i]) >= floor]
            for family, j in zip(*np.unique(label[other], return_index=True), strict=True):
                found.append((int(rep[i]), int(rep[other[j]])))
                label = np.where(label == family, label[i], label)
        return _pairs(found)

    return across


def _linked(percent: int):
    """Links between the full sets of a family's chunks, those that join what no link before has joined."""

    def linked(family: pa.Table) -> pa.Table:
        rep, own = family["rep"].to_numpy(), family["own"].to_numpy()
        apart = family["low"][0].as_py() != family["high"][0].as_py()
        sets = [x.values.to_numpy() for x in family["shingles"]]
        n = np.array([len(s) for s in sets])
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        names, code = np.unique(np.concatenate(sets), return_inverse=True)
        label, found = family["label"].to_numpy(), []
        for i in range(len(rep)):
            if (label == label[i]).all():
                break
            mark = np.zeros(len(names), np.int64)
            mark[code[begin[i] : begin[i] + n[i]]] = 1
            common = np.add.reduceat(mark[code], begin)
            near = (100 * common >= percent * (n + n[i] - common)) & (label != label[i])
            if apart:
                near &= own != own[i]
            for j in np.flatnonzero(near):
                if label[j] != label[i]:
                    found.append((int(rep[i]), int(rep[j])))
                    label = np.where(label == label[j], label[i], label)
        return _pairs(found)

    return linked


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) < 2 THEN [array_to_string(words, ' ')]
         ELSE [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] END) AS s FROM w WHERE len(words) > 0
), classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sh GROUP BY list_sort(s)
), flat AS (SELECT rep, len(s) AS n, hash(unnest(s)) AS g FROM classes
), rare AS (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS r
            FROM flat JOIN (SELECT g, count(*) AS f FROM flat GROUP BY g) USING (g)
), heads AS (SELECT rep, n, g FROM rare WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1
), cand AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM heads a JOIN heads b
  ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS n, len(y.s) AS m
                    FROM cand JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b)
  WHERE 100 * i >= 80 * (n + m - i)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(node, spot) AS (SELECT rep, rep FROM classes UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.spot = edges.a
), comp AS (SELECT node, min(spot) AS c FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(len(sh.s), 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id,
       coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sh USING (doc_id) LEFT JOIN classes ON classes.s = list_sort(sh.s) LEFT JOIN comp ON comp.node = classes.rep
"""
