"""Nearest neighbours: exact top-k that leaves out what can't be near, and exact radius joins through bands.

Both searches collapse equal values first: a value keeps its smallest ids, as many as a list is long, so that copies of one
another, however many, are one row.

* Hashes are looked up by bands of bits with a growing radius.  Hashes within bands * (flips + 1) - 1 bits share a band but
  for ``flips`` bits, so a value that has enough neighbours within that radius is settled; the next round is for the others.
  A band's bucket of over BUCKET_ROWS values isn't paired: the values that ask for it stay unsettled.
* Vectors are dealt to the regions of at most PIVOTS pivots.  A value asks its nearest regions first; the similarity of the
  last neighbour found and the triangle inequality of angles then rule out all regions that hold nothing better.
* What is left (unsettled hashes, regions not ruled out) is compared in full over a grid of blocks, each pair of blocks in
  one task.  A value is sent to a block of regions once, not to each of its regions.

On uniformly random values nothing is near, so all is compared; on values in clusters a small part is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import hashing
from evidara.operators.skew import salted_join
from evidara.sources.tables import durable

#: Bytes of values in a block, which set the memory of one task, and pairs of a task where there are tasks to spare.
BLOCK_BYTES, TASK_PAIRS = 8_000_000, 50_000_000
BUCKET_ROWS = 2048
#: Queries and rows of a block that are scored at once, as many as a CPU's cache holds.
STEP = (256, 1024)
#: At most so many pivots, and rows of a region on average.
PIVOTS, REGION_ROWS = 1024, 1000
#: At most so many regions of a group, bits of a mask.
GROUP_REGIONS = 62
#: Values whose angles to all pivots are held at once.
VISIT_ROWS = 1000


def _collapsed(rows: DataFrame, need: int) -> DataFrame:
    """value, first, ids: of each distinct value the ``need`` smallest ids in order."""
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("value").orderBy("id"))).filter(F.col("_n") <= need)
    return few.groupBy("value").agg(F.min("id").alias("first"), F.sort_array(F.collect_list("id")).alias("ids"))


def _best(found: DataFrame, need: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("score", "first")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= need).drop("_n")


def _block_rows(width: int) -> int:
    return max(256, BLOCK_BYTES // width)


def _spread(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two tables with rows for every value, never by broadcast: Spark estimates exploded and compressed tables far too small."""
    return left.join(right.hint("merge"), key, how)


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, parts: list[tuple[np.ndarray, int, int]], need: int, score: Callable, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in x and y and scores of the ``need`` lowest scores of each row of x, none over ``floor``, ties to the smaller of y's ``ids``.

    ``parts``: rows of x and the range of y that they meet, in order of ids.  A row's limit is the score of its last neighbour so far,
    so that few pairs pass; what has passed is ranked whenever it would fill the lists twice.
    """
    ordered = len(parts) == 1  # then an equal score comes too late
    under = np.less if ordered else np.less_equal
    most = np.inf if floor is None else np.nextafter(floor, np.inf) if ordered else floor
    whole = None if floor is None else int(floor) + ordered  # the same for scores that are whole numbers
    limit, held, new = None, None, []

    def merged() -> None:
        nonlocal held, new
        q, j, v = (np.concatenate(c) for c in zip(*([held] if held else []), *new, strict=True))
        order = np.lexsort((ids[j], v, q))
        q, j, v = q[order], j[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        limit[q[rank == need - 1]] = v[rank == need - 1]
        held, new = [c[rank < need] for c in (q, j, v)], []

    for rows, start, stop in parts:
        own = x[rows]
        for at in range(start, stop, STEP[1]):
            value = score(own, y[at : min(stop, at + STEP[1])])
            if limit is None:
                limit = np.full(len(x), most if value.dtype.kind != "u" else np.iinfo(value.dtype).max if whole is None else whole, value.dtype)
            q, j = np.divmod(np.flatnonzero(under(value, limit[rows][:, None])), value.shape[1])
            if len(q) > 4 * need * len(rows):  # the first ones: what is over a row's last of so many isn't among them
                last = np.partition(value, need - 1, axis=1)[:, need - 1]
                q, j = (c[value[q, j] <= last[q]] for c in (q, j))
            new.append((rows[q], at + j, value[q, j]))
            if sum(len(c[0]) for c in new) > 2 * need * len(x):
                merged()
    merged()
    return tuple(held)


def _met(index: DataFrame, asked: DataFrame, need: int, block: Callable, score: Callable, floor: float | None, width: int, stats: dict | None) -> DataFrame:
    """q, first, score: of each q of ``asked`` (region, mask, q, value) the ``need`` lowest rows of ``index`` (region, part, first, value).

    A q meets those parts of a region whose bits its mask has.  ``block`` makes an array of a column, ``score`` gets two of them; scores
    over ``floor`` don't count.  A value has ``width`` bytes.
    """
    most = _block_rows(width)
    sizes = [{r["region"]: r["n"] for r in x.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()} for x in (asked, index)]  # a row a region
    spare = 4 * index.sparkSession.sparkContext.defaultParallelism
    cells = []
    for region in sorted(set(sizes[0]) & set(sizes[1])):
        n, m = sizes[0][region], sizes[1][region]
        columns = -(-m // most)
        cells.append((region, max(-(-n // most), -(-min(spare, -(-n * m // TASK_PAIRS)) // columns)), columns))
    if stats is not None:
        each = index.groupBy("region", "part").agg(F.count(F.lit(1)).alias("n"))
        stats["pairs"] = stats.get("pairs", 0) + (asked.join(each, "region").filter("shiftrightunsigned(mask, part) & 1 = 1").agg(F.sum("n")).first()[0] or 0)
    grid = F.broadcast(index.sparkSession.createDataFrame(cells, "region int, rows int, columns int"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "region").withColumn("row", deal("q", "rows")).withColumn("column", every("columns")).select("region", "row", "column", "q", "mask", "value")
    right = index.join(grid, "region").withColumn("column", deal("first", "columns")).withColumn("row", every("rows")).select("region", "row", "column", "first", "part", "value")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            ids, mask, own, part = left["q"].to_numpy(), left["mask"].to_numpy(), right["first"].to_numpy(), right["part"].to_numpy()
            order = np.lexsort((own, part))
            own, part, x, y = own[order], part[order], block(left["value"]), block(right["value"])[order]
            bits, starts = np.unique(part, return_index=True)
            for a in range(0, len(ids), STEP[0]):
                meets = [(np.flatnonzero(mask[a : a + STEP[0]] >> bit & 1), i, j) for bit, i, j in zip(bits, starts, [*starts[1:], len(part)], strict=True)]
                if meets := [m for m in meets if len(m[0])]:
                    q, j, value = _nearest(x[a : a + STEP[0]], y, own, meets, need, score, floor)
                    found.append((ids[a + q], own[j], value.astype(np.float64)))
        query, candidate, best = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"q": query, "first": candidate, "score": best})

    cell = ["region", "row", "column"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(nearest, "q long, first long, score double")
    return _best(found, need)


def _lists(queries: DataFrame, asked: DataFrame, held: DataFrame, near: DataFrame, need: int) -> DataFrame:
    """query, candidate, score, rank from near (q, first, score): values become their ids, the query itself is left out."""
    each = _spread(near, held.select("first", "ids"), "first").select("q", "score", F.explode("ids").alias("first"))
    best = _best(each, need).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "first"))).alias("list"))
    lists = _spread(asked, best, "q").select("value", "list")
    own = salted_join(queries, lists, ["value"], F.col("id")).select(F.col("id").alias("query"), F.slice(F.filter("list", lambda x: x["first"] != F.col("id")), 1, need - 1).alias("list"))
    return own.select("query", F.posexplode("list").alias("rank", "x")).select("query", F.col("x.first").alias("candidate"), F.col("x.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def _band_keys(bands: int, flips: int):
    """Of a hash the keys (band, bits) of all its bands' values within ``flips`` bits."""
    cuts = [hashing.BITS * i // bands for i in range(bands + 1)]

    def keys(i: int):
        width = cuts[i + 1] - cuts[i]
        bits = F.shiftrightunsigned("value", hashing.BITS - cuts[i + 1]).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(m).cast("long") for m in _near_values(width, flips)])
        return F.transform(masks, lambda m: bits.bitwiseXOR(m) + F.lit(i << 33).cast("long"))

    return F.explode(F.concat(*map(keys, range(bands)))).alias("key")


def _by_bands(held: DataFrame, asked: DataFrame, need: int, flips: int, stats: dict | None) -> tuple[DataFrame, DataFrame]:
    """(q, first, score of the settled ones; the rows of ``asked`` that stay unsettled)."""
    bands = hashing.BITS // min(32, max(8, held.count().bit_length()))
    keyed = held.select("first", "value", F.size("ids").alias("n_ids"), _band_keys(bands, 0))
    hot = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS).select("key"))
    left, found = asked, None
    for step in range(flips + 1):
        probes = left.select("q", F.col("value").alias("own"), _band_keys(bands, step).alias("key"))
        if not hot.isEmpty():
            probes = _spread(probes, probes.join(hot, "key", "left_semi").select("q").distinct(), "q", "left_anti")
        near = _spread(probes, keyed, "key").select("q", "first", "n_ids", hashing.hamming(F.col("own"), F.col("value")).cast("double").alias("score"))
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + near.count()
        near = durable(_best(near.filter(F.col("score") < bands * (step + 1)).distinct(), need))
        settled = near.groupBy("q").agg(F.sum("n_ids").alias("n")).filter(F.col("n") >= need).select("q")
        done = _spread(near, settled, "q", "left_semi").drop("n_ids")
        found = done if found is None else found.unionByName(done)
        left = durable(_spread(left, settled, "q", "left_anti"))
        # where nothing is near, a wider radius isn't worth its lookups: the grid has what is left
        if left.isEmpty() or near.filter("score > 0").isEmpty():
            break
    return found, left


def _numbered(queries: DataFrame) -> DataFrame:
    """q, value of the distinct values; the written table fixes the numbers."""
    return durable(queries.select("value").distinct().select(F.monotonically_increasing_id().alias("q"), "value"))


def hamming_top_k(index: DataFrame, queries: DataFrame, k: int, flips: int = 1, stats: dict | None = None, most: int | None = None) -> DataFrame:
    """query, candidate, distance, rank over (id, value) tables of 64-bit hashes; NULL hashes take no part.

    Ties go to the smaller id.  ``stats`` gets the number of pairs that were compared.  Distances over ``most`` don't count, so
    that the grid keeps no pair of hashes that are further apart.
    """

    block = lambda column: column.to_numpy().view(np.uint64)
    distances = lambda a, b: np.bitwise_count(a[:, None] ^ b[None, :])
    keep = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("value").cast("long").alias("value")).filter("value is not null")
    index, queries, need = keep(index), keep(queries), k + 1
    held, asked = durable(_collapsed(index, need)), _numbered(queries)
    near, left = _by_bands(held, asked, need, flips, stats)
    if not left.isEmpty():
        one, only = F.lit(0).alias("region"), F.lit(0).alias("part")
        near = near.unionByName(_met(held.select(one, only, "first", "value"), left.select(one, F.lit(1).cast("long").alias("mask"), "q", "value"), need, block, distances, most, 8, stats))
    if most is not None:
        near = near.filter(F.col("score") <= most)
    found = _lists(queries, asked, held, near, need)
    return found.select("query", "candidate", F.col("score").cast("int").alias("distance"), "rank")


def _matrix(column) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Regions:
    """Pivots, and of each region its rows, the widest angle to the pivot and the longest vector."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
        self.n, self.angle, self.length = (np.zeros(len(pivots)) for _ in range(3))

    def groups(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each region its group and its place there: in order, of up to ``most`` rows where no region has more."""
        group, part, rows = np.zeros(len(self.n), int), np.zeros(len(self.n), int), 0
        for r in range(1, len(self.n)):
            rows += self.n[r - 1]
            new = part[r - 1] + 1 >= GROUP_REGIONS or rows + self.n[r] > most
            group[r], part[r], rows = group[r - 1] + new, 0 if new else part[r - 1] + 1, 0 if new else rows
        return group, part

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), -1, 1))

    def first(self, x: np.ndarray, need: int) -> np.ndarray:
        """bool[rows, regions]: the nearest ones that hold ``need`` rows together."""
        order = np.argsort(self.angles(x), axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < need, axis=1)
        return out & (self.n > 0)

    def possible(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """bool[rows, regions]: those that may hold a product of ``least`` or more."""
        gap = np.maximum(self.angles(x) - self.angle - 1e-6, 0)
        most = np.linalg.norm(x, axis=1, keepdims=True) * self.length * np.maximum(np.cos(gap), 0)
        return (most >= least[:, None] - 1e-9) & (self.n > 0)


def cosine_top_k(index: DataFrame, queries: DataFrame, k: int, floor: float, stats: dict | None = None) -> DataFrame:
    """query, candidate, similarity, rank over (id, value) tables of unit vectors; only similarities of ``floor`` or more.

    Ties go to the smaller id.  ``stats`` gets the number of pairs that were compared.  NULL vectors take no part.
    """
    keep = lambda df: df.select(F.col("id").cast("long").alias("id"), "value").filter("value is not null")
    index, queries, need = keep(index), keep(queries), k + 1
    held, asked = durable(_collapsed(index, need)), _numbered(queries)
    n_pivots = min(PIVOTS, max(1, held.count() // REGION_ROWS))
    chosen = held.select("value").orderBy(F.xxhash64("value"), "value").limit(n_pivots).collect()
    if not chosen:
        return queries.select(F.col("id").alias("query"), F.col("id").alias("candidate"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    regions = _Regions(np.array([r["value"] for r in chosen], np.float64))
    width = 4 * max(1, regions.pivots.shape[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, VISIT_ROWS) for whole in batches for a in range(0, whole.num_rows, VISIT_ROWS)):
            x = _matrix(batch["value"])
            angles = regions.angles(x)
            at = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(angles[np.arange(len(x)), at]), pa.array(np.linalg.norm(x, axis=1)), batch["first"], batch["value"]], names=["region", "angle", "length", "first", "value"])

    kind = held.schema["value"].dataType.simpleString()
    placed = durable(held.select("first", "value").mapInArrow(place, f"region int, angle double, length double, first long, value {kind}"))
    for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.max("length").alias("length")).collect():  # at most PIVOTS rows
        regions.n[r["region"]], regions.angle[r["region"]], regions.length[r["region"]] = r["n"], r["angle"], r["length"]
    group, part = regions.groups(_block_rows(width))
    places = F.broadcast(index.sparkSession.createDataFrame([(r, int(g), int(b)) for r, (g, b) in enumerate(zip(group, part, strict=True))], "own int, region int, part int"))
    grouped = placed.select(F.col("region").alias("own"), "first", "value").join(places, "own").select("region", "part", "first", "value")
    starts, bits = np.flatnonzero(np.diff(group, prepend=-1)), np.int64(1) << part

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a value goes to a group of regions once, with a bit for each region that it asks there
        for whole in batches:
            for a in range(0, whole.num_rows, VISIT_ROWS):
                batch = whole.slice(a, VISIT_ROWS)
                x = _matrix(batch["value"])
                go = regions.first(x, need)
                if "least" in batch.schema.names:
                    go = regions.possible(x, batch["least"].to_numpy(zero_copy_only=False)) & ~go
                mask = np.bitwise_or.reduceat(np.where(go, bits, 0), starts, axis=1)
                q, to = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(mask[q, to]), batch["q"].take(pa.array(q)), batch["value"].take(pa.array(q))], names=["region", "mask", "q", "value"])

    schema = f"region int, mask long, q long, value {kind}"
    negative = lambda a, b: -(a @ b.T)
    met = lambda rows: _met(grouped, durable(rows.mapInArrow(visits, schema)), need, _matrix, negative, -floor, width, stats)
    near = durable(met(asked.select("q", "value")))
    if n_pivots > 1:
        last = near.groupBy("q").agg(F.when(F.count(F.lit(1)) >= need, -F.max("score")).otherwise(floor).alias("least"))
        further = _spread(asked, last, "q", "left").select("q", "value", F.coalesce("least", F.lit(float(floor))).alias("least"))
        near = near.unionByName(met(further))
    found = _lists(queries, asked, held, near, need)
    return found.select("query", "candidate", (-F.col("score")).alias("similarity"), "rank")


def _near_values(width: int, most: int) -> list[int]:
    masks, level = {0}, {0}
    for _ in range(most):
        level = {m ^ (1 << b) for m in level for b in range(width)}
        masks |= level
    return sorted(masks)


def hamming_within(left: DataFrame, right: DataFrame, radius: int, bands: int) -> DataFrame:
    """All pairs a, b, distance within ``radius`` of two (id, value) tables, by equi-joins on bands.

    Hashes within the radius differ by at most radius // bands bits in some band.  The left side lists each band's
    values within that many bits, the right side its own, and only pairs that share a band are compared.  Settings that
    would flip more than one bit a band are refused: their lists match a third of all pairs and more.
    """
    if radius // bands > 1:
        raise ValueError(f"{bands} bands are too few for a radius of {radius}")
    cuts = [hashing.BITS * i // bands for i in range(bands + 1)]
    part = lambda i: F.shiftrightunsigned("value", hashing.BITS - cuts[i + 1]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    near = lambda i: F.transform(F.array(*[F.lit(m).cast("long") for m in _near_values(cuts[i + 1] - cuts[i], radius // bands)]), lambda m: F.struct(F.lit(i).alias("band"), part(i).bitwiseXOR(m).alias("bits")))
    own = lambda i: F.struct(F.lit(i).alias("band"), part(i).alias("bits"))
    a = left.filter("value is not null").select(F.col("id").alias("a"), F.col("value").alias("value_a"), F.explode(F.concat(*[near(i) for i in range(bands)])).alias("key"))
    b = right.filter("value is not null").select(F.col("id").alias("b"), F.col("value").alias("value_b"), F.explode(F.array(*[own(i) for i in range(bands)])).alias("key"))
    distance = hashing.hamming(F.col("value_a"), F.col("value_b"))
    pairs = a.join(b, "key").filter("a <> b").withColumn("distance", distance).filter(F.col("distance") <= radius)
    return pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def ranked_candidates(hashes: DataFrame, vectors: DataFrame, pool: int, top_k: int, most: int) -> DataFrame:
    """Several signals verified together.

    ``hashes``: query, candidate, distance, rank, same_bytes of a pool of ``pool`` a query, cut before any filter;
    ``vectors``: query, candidate, similarity, rank.  The union of both is kept where bytes are equal, the distance is
    within ``most`` or a vector hit vouches for it, then ranked: equal bytes, distance, similarity, the distance of a second
  hash (``dhash_distance``, if ``hashes`` has it; none counts 999), id.
    """
    both = hashes.filter(F.col("rank") <= pool).drop("rank").join(vectors.drop("rank").withColumnRenamed("similarity", "cosine"), ["query", "candidate"], "full_outer")
    same = F.coalesce("same_bytes", F.lit(False))
    kept = both.filter(same | (F.col("distance") <= most) | F.col("cosine").isNotNull())
    scored = kept.withColumn("similarity", hashing.candidate_similarity(hashing.similarity(F.col("distance")), F.col("cosine")))
    dhash = [F.coalesce("dhash_distance", F.lit(999))] if "dhash_distance" in scored.columns else []
    order = Window.partitionBy("query").orderBy(same.desc(), F.coalesce("distance", F.lit(999)), F.col("similarity").desc(), *dhash, "candidate")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.withColumn("band", hashing.band(F.coalesce("distance", F.lit(999)), F.col("cosine")))


def match_summary(ranked: DataFrame) -> DataFrame:
    """Per query the candidates of each band and in all, the least distance and the largest similarity."""
    kinds = [F.count_if(F.col("band") == b).alias(f"n_{b}") for b in ("strong", "possible")]
    return ranked.groupBy("query").agg(*kinds, F.count(F.lit(1)).alias("n_candidates"), F.min("distance").alias("least_distance"), F.max("similarity").alias("most_similarity"))
