"""Shared pieces of the corpus operators: table reading, durable checkpoints and vectorised word codes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text only, so that extra or clashing columns of the caller never matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  A temporary one is made only in local mode, as in tests."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="evidara-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written in the shared folder that the session names, and read again.

    Parquet rather than ``checkpoint()``: that keeps the estimated size of its plan, and in a loop of joins the estimates
    multiply to numbers of so many digits that planning stalls after a dozen rounds.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A join salts the keys of most rows: at most so many, the proven bound of what is broadcast, of at least so many rows.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 1000, 32


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The HOT_KEYS keys of most rows; any other key holds under a thousandth of all rows."""
    return counts.filter(F.col(n) > HOT_ROWS).orderBy(F.col(n).desc(), *keys).limit(HOT_KEYS).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose rows of the hot keys are repeated so that left's are dealt over SALTS tasks.

    ``by`` is a column that differs among left's rows of a key.  Right's keys are unique, so no row is joined twice.
    """
    marked = F.broadcast(hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.lit(True).alias("__hot")))

    def mark(rows: DataFrame) -> DataFrame:
        same = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
        return rows.join(marked, same, "left").drop(*[f"__hot_{k}" for k in keys])

    one = mark(left).withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)).drop("__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one.join(mark(right).withColumn("__salt", F.explode(every)).drop("__hot"), [*keys, "__salt"], how).drop("__salt")


def row_hash(df: DataFrame):
    """A 64-bit hash of all columns of a row but maps, which have no order."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def crc_bucket(column, modulus: int):
    """crc32 of a number written as text, modulo ``modulus``; NULL for NULL."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_chunk(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows
        column = pa.array([], column.type)
    return column


def in_pieces(batches, most: int = 3_000_000):
    """The same rows in batches of at most ``most`` text bytes (or one row), to bound a task's memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def split_words(column) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in order, and where each text's words begin (one more entry than texts)."""
    text = pc.fill_null(one_chunk(column).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(words), 0)
    if not pc.all(real, min_count=0).as_py():
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        words, offsets = words.filter(real), before[offsets].astype(np.int64)
    return words, offsets


def code_words(words: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per word its index among the distinct words; their 64-bit codes; the distinct words."""
    if lower:
        words = pc.ascii_lower(words)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes, distinct


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers, so that every bit of a sum counts."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of the ``width`` codes from each position, by doubling; empty if there are fewer."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    out, done, run, length, rest = None, 0, codes, 1, width
    while rest:
        if rest & 1:
            out = run if out is None else out[: len(codes) - done - length + 1] * _power(length) + run[done : len(codes) - length + 1]
            done += length
        rest >>= 1
        if rest:
            run = run[: len(codes) - 2 * length + 1] * _power(length) + run[length : len(codes) - length + 1]
            length *= 2
    return scramble(out[: len(codes) - width + 1])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), n, 1 << 64))


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` words lies inside one text."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - width + 1, 0)
    begin = np.repeat(offsets[:-1], counts)
    return begin + np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(total: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``width`` words from one of ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, total), -1)
    return np.cumsum(change[:-1]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags.astype(np.int64))])
    return total[offsets[1:]] - total[offsets[:-1]]


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged words that stay inside one text: text index, first word, past the last word (global)."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], flags[:-1]]) if len(flags) else flags
    after = np.concatenate([flags[1:], [False]]) if len(flags) else flags
    first = np.flatnonzero(flags & (~before | edge[: len(flags)]))
    last = np.flatnonzero(flags & (~after | edge[1:]))
    return np.searchsorted(offsets, first, "right") - 1, first, last + 1
