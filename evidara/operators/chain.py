"""Hash-chained logs: verification without a global sort, forks, repair and append."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidara.functions.files import row_hash
from evidara.operators.skew import salted_join
from evidara.sources.tables import durable

GENESIS = "0" * 64
#: Rows of a range whose order is settled in one task.
RANGE_ROWS = 200_000
MOST_RANGES = 2000
#: Tasks of a core that chains are dealt to.
CHAIN_TASKS = 4


def with_previous(log: DataFrame, seq: str, columns: list[str], chain: str | None = None) -> DataFrame:
    """Adds previous_<column> of the row before in ``seq`` order, NULL for the first.

    With ``chain``, a column of many chains (one a case), the row before in the same chain.  One long chain is dealt into
    ranges between quantiles of seq, so that gaps and dense stretches don't matter; lag works inside a range and a
    range's first row gets the last row of the range before, found among one row a range.
    """
    if chain:
        own = Window.partitionBy(chain).orderBy(seq)
        return log.select("*", *[F.lag(c).over(own).alias(f"previous_{c}") for c in columns])
    n = min(MOST_RANGES, -(-log.count() // RANGE_ROWS))
    cuts = log.agg(F.percentile_approx(seq, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = F.array(*map(F.lit, sorted(set(cuts or []))))
    ranged = log.withColumn("_range", F.size(F.filter(bounds, lambda c: F.col(seq) > c)) if cuts else F.lit(0))
    lasts = ranged.groupBy("_range").agg(F.max_by(F.struct(*columns), seq).alias("_last"))
    shifted = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(seq)
    out = ranged.withColumn("_near", F.lag(F.struct(*columns)).over(inside)).join(shifted, "_range")
    for c in columns:
        out = out.withColumn(f"previous_{c}", F.coalesce(f"_near.{c}", f"_before.{c}"))
    return out.drop("_range", "_near", "_before")


def link_check(log: DataFrame, content: str = "content", seq: str = "seq", chain: str | None = None) -> DataFrame:
    """seq, content_ok and link_ok: the stored hash fits the row, and the stored previous hash is that of the row before."""
    linked = with_previous(log, seq, ["row_hash"], chain)
    expected = F.coalesce("previous_row_hash", F.lit(GENESIS))
    return linked.select(*([chain] if chain else []), seq, (F.col("row_hash") == row_hash(F.col("previous_hash"), F.col(content))).alias("content_ok"), (F.col("previous_hash") == expected).alias("link_ok"))


def summary(checked: DataFrame, log: DataFrame, seq: str = "seq") -> DataFrame:
    """Totals, the first invalid row, whether all hold, and the head's hash."""
    bad = ~(F.col("content_ok") & F.col("link_ok"))
    totals = checked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_invalid"), F.min(F.when(bad, F.col(seq))).alias("first_invalid"))
    head = log.agg(F.max_by("row_hash", seq).alias("head_hash"))
    return totals.join(head).withColumn("valid", F.col("n_invalid") == 0)


def forks(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows that share their previous hash with another row; very many may name one predecessor."""
    shared = log.groupBy("previous_hash").agg(F.count(F.lit(1)).alias("n_siblings")).filter("n_siblings > 1")
    return salted_join(log, shared, ["previous_hash"], F.col(seq))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """previous_hash, row_hash and _place (1, 2, 3...) of rows in order of chain and place; a chain goes on in the next batch."""
    last, link, place = None, "", 0
    for batch in batches:
        links = []
        for chain, start, text in zip(*(batch[c].to_pylist() for c in ("_chain", "_start_hash", "_text")), strict=True):
            if (chain,) != last:
                last, link, place = (chain,), start, 0
            links.append((link, link := hashlib.sha256((link + text).encode()).hexdigest(), place := place + 1))
        kept = {c: batch[c] for c in batch.schema.names if c not in ("_chain", "_start_hash", "_text")}
        before, own, places = zip(*links, strict=True) if links else ((), (), ())
        yield pa.RecordBatch.from_pydict(kept | {"previous_hash": pa.array(before, pa.string()), "row_hash": pa.array(own, pa.string()), "_place": pa.array(places, pa.int64())})


def relink(log: DataFrame, content: str = "content", seq: str = "seq", chain: str | None = None, start: str | None = None) -> DataFrame:
    """The log with previous_hash and row_hash computed anew.

    A chain is a fold and has one order, so each chain runs in one task, many chains one after the other; rows pass in their
    order and none are gathered.  ``start`` names a column with the hash before a chain's first row here; without it the
    chain begins.
    """
    bare = log.drop("previous_hash", "row_hash")
    return numbered(bare, F.col(content), [seq], F.col(chain) if chain else F.lit(0), F.col(start) if start else F.lit(GENESIS)).drop("_place")


def numbered(rows: DataFrame, text: Column, order: list[str], chain: Column, start: Column, kept: list[str] | None = None) -> DataFrame:
    """rows (of them ``kept``) with previous_hash, row_hash and _place, their number in their chain's ``order``, in one sort.

    ``text`` is made where the rows lie, before they go to their chain's task.  The number of tasks is given, so that small
    partitions aren't put together: a task would get several chains while others have none.
    """
    helped = rows.select("*", chain.cast("string").alias("_chain"), start.alias("_start_hash"), text.alias("_text"))
    new = [StructField("previous_hash", StringType()), StructField("row_hash", StringType()), StructField("_place", LongType())]
    tasks = CHAIN_TASKS * rows.sparkSession.sparkContext.defaultParallelism
    kept = kept or rows.columns
    ordered = helped.repartition(tasks, "_chain").sortWithinPartitions("_chain", *order).select(*kept, "_chain", "_start_hash", "_text")
    return ordered.mapInArrow(_folded, StructType([*rows.select(*kept).schema.fields, *new]))


def diagnosis(log: DataFrame, chain: str, content: str = "content", seq: str = "seq") -> DataFrame:
    """Per chain n_rows, n_modified, first_break (NULL: none), n_to_relink and status: clean, repairable or refused.

    A row whose own hash doesn't fit its content was changed after it was written: such a chain is refused, as linking it
    anew would vouch for the change.
    """
    checked = link_check(log, content, seq, chain).withColumn("_rank", F.row_number().over(Window.partitionBy(chain).orderBy(seq)))
    per = checked.groupBy(chain).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("content_ok")).alias("n_modified"), F.min(F.when(~F.col("link_ok"), F.col(seq))).alias("first_break"), F.max("_rank").alias("_last"), F.min(F.when(~F.col("link_ok"), F.col("_rank"))).alias("_at"))
    status = F.when(F.col("n_modified") > 0, "refused").when(F.col("first_break").isNotNull(), "repairable").otherwise("clean")
    later = F.col("_last") - F.col("_at") + 1
    return per.withColumn("status", status).select(chain, "n_rows", "n_modified", "first_break", F.when(status == "repairable", later).otherwise(0).cast("long").alias("n_to_relink"), "status")


def repair(log: DataFrame, chain: str, content: str = "content", seq: str = "seq", dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(log, diagnosis): repairable chains linked anew from their first break on, with a row that discloses the repair.

    A dry run leaves the log as it is.  Rows before a break, clean and refused chains are not touched.
    """
    if dry_run:
        return log, diagnosis(log, chain, content, seq)
    log = durable(log)  # read six times below
    found = durable(diagnosis(log, chain, content, seq))
    broken = found.filter("status = 'repairable'").select(chain, "first_break", "n_to_relink")
    marked = log.join(broken, chain, "left")
    kept = marked.filter(F.col("first_break").isNull() | (F.col(seq) < F.col("first_break"))).select(*log.columns)
    before = marked.filter(F.col(seq) < F.col("first_break")).groupBy(chain).agg(F.max_by("row_hash", seq).alias("_start"))
    told = F.to_json(F.struct(F.lit("CHAIN_REPAIRED").alias("action"), F.col("first_break"), F.col("n_to_relink").alias("n_relinked")))
    disclosed = marked.filter("first_break is not null").groupBy(chain, "first_break", "n_to_relink").agg((F.max(seq) + 1).alias(seq)).withColumn(content, told)
    columns = [chain, seq, content]
    again = marked.filter(F.col(seq) >= F.col("first_break")).select(*log.columns).unionByName(disclosed.select(*columns), allowMissingColumns=True)
    again = again.join(before, chain, "left").withColumn("_start", F.coalesce("_start", F.lit(GENESIS)))
    return kept.unionByName(relink(again, content, seq, chain, "_start").select(*log.columns)), found
