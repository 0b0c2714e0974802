"""Which word sequences of a corpus occur in several documents: the shared part of the two repeat finders.

Documents are dealt into blocks that are consecutive ranges of doc_id.  Each block sends its distinct sequence keys,
sorted and difference coded, to the group of the key's range; a group compares the sorted keys of all blocks with their
neighbours and answers each block with two bits a key: held by another document, and held by a document with a smaller
doc_id.  Within a block the documents decide for themselves.  A passage that a third of all documents share is
therefore one key a block, whatever the number of documents, and no task sees more than a block or a group.

A sequence is known by 96 bits: a 64-bit key, whose leading two bytes stand for its first two words and whose other 48 are
of a hash of the whole, and 32 bits of a second hash.  Sequences are never compared word by word, as that would send
each of them in full.  Two different sequences with the same first two words would be taken for equal with a chance of
2**-80: over m sequences of that beginning m*m/2**81 expected times, 4e-8 for 3*10**8 of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import code_words, in_pieces, rolling, scramble, split_words, texts

#: Words in a block and keys in a group; they set the memory of one task.
BLOCK_CHARS = 4_000_000
GROUP_KEYS = 2_000_000
#: Quantiles of doc_id that the driver gets at most.
RANGES = 1 << 16


class Words:
    """The words of one block of documents as arrays."""

    def __init__(self, docs: pa.Table):
        order = np.argsort(docs["doc_id"].to_numpy(), kind="stable")
        self.docs = docs.take(pa.array(order))
        self.doc_id = self.docs["doc_id"].to_numpy()
        self.words, self.offsets = split_words(self.docs["text"])
        index, codes, _ = code_words(self.words)
        self.codes = codes[index]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """doc_id of the text that a word belongs to."""
        return self.doc_id[np.searchsorted(self.offsets, positions, "right") - 1]


#: Of a block's words: the positions that count, and the key and check of each.
Keys = Callable[[Words], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sequence_keys(block: Words, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts; a byte of the first word's code, one of the second's and 48 bits of the whole; 32 bits of another hash."""
    other = scramble(block.codes)
    first = other >> np.uint64(56)
    second = first[starts + 1] if width > 1 else np.zeros(len(starts), np.uint64)
    key = (first[starts] << np.uint64(56)) | (second << np.uint64(48)) | (rolling(block.codes, width)[starts] >> np.uint64(16))
    return starts, key, (rolling(other, width)[starts] >> np.uint64(32)).astype(np.uint32)


def _sorted(keys: np.ndarray, checks: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """Order by key, check and ``then``; checks only matter to the rare keys that have several."""
    order = np.lexsort((*then, keys))
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((*then, checks, keys))
    return order


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their checks, and the place of each one given among them."""
    order = _sorted(keys, checks)
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.empty(len(k), np.int64)
    at[order] = np.cumsum(new) - 1
    return k[new], c[new], at


class Ranges:
    """Numbers of parts of a line that is cut into ranges, each of them into equal parts; as many entries as ranges.

    Small neighbours share a number, a large range has several.  The numbers don't fall along the line.
    """

    def __init__(self, sizes: list[int], most: int):
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        number, held = 0, 0
        for r, n in enumerate(sizes):
            if held and held + n > most:
                number, held = number + 1, 0
            parts = max(1, -(-n // most))
            self.first[r], self.parts[r] = number, parts
            number += parts - 1
            held += n // parts

    def of(self, ranges: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Of places at ``share`` (0 to 1) of their range."""
        parts = self.parts[ranges]
        return self.first[ranges] + np.minimum((share * parts).astype(np.int64), parts - 1)


def in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, block: ranges of doc_id of about BLOCK_CHARS characters; rows of NULL ids form blocks under 0.

    At most RANGES quantiles of doc_id reach the driver, with the characters between two of them: small neighbours are
    put together, a large one is cut into equal widths of doc_id.  What goes to the tasks is of that length too, whatever the
    number of blocks.  It is a constant of the plan: a stage that runs again after a lost executor deals the same rows to the
    same block.  Rows of one doc_id are one block.
    """
    docs = texts(docs)
    size = F.coalesce(F.length("text"), F.lit(0))
    first = docs.agg(F.sum(size).alias("n"), F.sum(F.when(F.col("doc_id").isNull(), size)).alias("none")).first()
    n_none = -(-(first["none"] or 0) // BLOCK_CHARS) or 1
    n_ranges = min(RANGES, 4 * -(-(first["n"] or 0) // BLOCK_CHARS))
    cuts = np.linspace(0, 1, n_ranges + 1)[1:-1].tolist() if n_ranges > 4 else []
    found = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * n_ranges))).first()[0] if cuts else None
    edges = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("long")
    def between(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, doc_id.to_numpy(np.int64), "left"))

    sizes, low, width = [0] * (len(edges) + 1), np.zeros(len(edges) + 1), np.ones(len(edges) + 1)
    if len(edges):
        ranged = docs.filter("doc_id is not null").select("doc_id", size.alias("n"), between("doc_id").alias("range"))
        for r in ranged.groupBy("range").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).toPandas().itertuples():
            sizes[r.range], low[r.range], width[r.range] = int(r.n), float(r.low), float(r.high) - float(r.low) + 1.0
    ranges = Ranges(sizes, BLOCK_CHARS)

    @F.pandas_udf("long")
    def block(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy(np.int64)
        at = np.searchsorted(edges, ids, "left")
        return pd.Series(ranges.of(at, np.clip((ids.astype(np.float64) - low[at]) / width[at], 0.0, 1.0)))

    spread = -1 - F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(n_none))  # these blocks only pass their texts on
    return docs.withColumn("block", F.when(F.col("doc_id").isNull(), spread).otherwise(block(F.coalesce("doc_id", F.lit(0).cast("long")))))


class Groups:
    """Key ranges of about GROUP_KEYS keys from the counts of the keys' leading 16 bits; 65,536 entries, whatever their number."""

    def __init__(self, counts: np.ndarray):
        by_first = counts.reshape(256, 256).sum(axis=1)
        self.range = np.zeros(1 << 16, np.int64)
        sizes: list[int] = []
        for first in range(256):
            if by_first[first] <= GROUP_KEYS:
                self.range[first << 8 : (first + 1) << 8] = len(sizes)
                sizes.append(int(by_first[first]))
            else:
                self.range[first << 8 : (first + 1) << 8] = len(sizes) + np.arange(256)
                sizes += counts[first << 8 : (first + 1) << 8].tolist()
        self.ranges = Ranges(sizes, GROUP_KEYS)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The group of each key; only ranges of a single prefix have parts, cut by the bits after it."""
        rest = ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
        return self.ranges.of(self.range[(keys >> np.uint64(48)).astype(np.int64)], rest)


def plan_groups(docs: DataFrame, leading: Callable[[Words], np.ndarray]) -> Groups:
    """Key ranges from a census of the keys' leading 16 bits.

    The leading byte stands for a sequence's first word and the next byte for its second, so a range is a set of word
    prefixes: rare first words share a range, a frequent one is split by the second word, and a range that is still
    too large by further bits of the whole sequence's hash.  The census reads the documents where they lie; at most
    65,536 counts reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << 16, np.int64)
        for batch in in_pieces(batches):
            found += np.bincount(leading(Words(pa.Table.from_batches([batch]))).astype(np.int64), minlength=1 << 16)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], names=["prefix", "n"])

    rows = texts(docs).filter("doc_id is not null").mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << 16, np.int64)
    counts[rows["prefix"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Groups(counts)


def _encode(keys: np.ndarray, checks: np.ndarray) -> bytes:
    """Sorted keys: the first in full, then differences in as few bytes as the largest one needs; then the checks."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    body = np.ascontiguousarray(gaps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + body.tobytes() + checks.astype("<u4").tobytes()


def _decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = blob[0]
    n = (len(blob) - 9 + width) // (width + 4)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    gaps[1:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, 9).reshape(-1, width)
    return np.cumsum(gaps.view("<u8").ravel().astype(np.uint64), dtype=np.uint64), np.frombuffer(blob[9 + (n - 1) * width :], "<u4")


def packed(block: int, keys: np.ndarray, checks: np.ndarray, groups: Groups) -> pa.Table:
    """A block's distinct keys, one row for each key range that it has keys in."""
    keys, checks, _ = distinct(keys, checks)
    names, begin = np.unique(groups.of(keys), return_index=True)
    sent = [_encode(keys[a:b], checks[a:b]) for a, b in zip(begin, [*begin[1:], len(keys)], strict=True)] if len(names) else []
    return pa.table({"grp": pa.array(names, pa.int64()), "block": pa.array([block] * len(names), pa.int64()), "keys": pa.array(sent, pa.binary())})


def _compare(sent: pa.Table) -> pa.Table:
    """The subtree of one key range: equal neighbours in sorted order are one node; who else is below it."""
    blocks = sent["block"].to_numpy()
    lists = [_decode(x.as_py()) for x in sent["keys"]]
    rank = np.repeat(blocks, [len(x) for x, _ in lists])
    keys, checks = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = _sorted(keys, checks, rank)
    same = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    later = np.concatenate([[False], same])  # a smaller block has it too
    shared = later | np.concatenate([same, [False]])
    bits = np.zeros((2, len(keys)), bool)
    bits[0, order], bits[1, order] = shared, later
    ends = np.cumsum([len(x) for x, _ in lists])
    pack = lambda row: [np.packbits(row[e - len(x) : e]).tobytes() for (x, _), e in zip(lists, ends, strict=True)]
    return pa.table({"grp": sent["grp"], "block": sent["block"], "shared": pa.array(pack(bits[0]), pa.binary()), "earlier": pa.array(pack(bits[1]), pa.binary())})


def compared(sent: DataFrame) -> DataFrame:
    """One row a block and group: two bits a key, in the order of the block's distinct keys in that range."""
    return sent.groupBy("grp").applyInArrow(_compare, "grp long, block long, shared binary, earlier binary")


#: What the blocks of NULL ids send.
NO_KEYS = (np.empty(0, np.uint64), np.empty(0, np.uint32))


def answers(blocks: DataFrame, keys: Keys, groups: Groups) -> DataFrame:
    """What the key ranges answer each block about the keys of its documents."""

    def send(docs: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py()
        return packed(block, *(keys(Words(docs))[1:] if block >= 0 else NO_KEYS), groups)

    return compared(blocks.groupBy("block").applyInArrow(send, "grp long, block long, keys binary"))


def judge(block: Words, positions: np.ndarray, keys: np.ndarray, checks: np.ndarray, answer: pa.Table, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Per position: another document has its key; a document with a smaller doc_id has it."""
    own, _, at = distinct(keys, checks)
    of = groups.of(own)
    shared, earlier = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for g, s, e in zip(answer["grp"].to_pylist(), answer["shared"].to_pylist(), answer["earlier"].to_pylist(), strict=True):
        a, b = np.searchsorted(of, [g, g + 1])
        shared[a:b] = np.unpackbits(np.frombuffer(s, np.uint8), count=b - a)
        earlier[a:b] = np.unpackbits(np.frombuffer(e, np.uint8), count=b - a)
    owner = block.owner(positions)
    least, most = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
    np.minimum.at(least, at, owner)
    np.maximum.at(most, at, owner)
    shared |= least < most
    return shared[at], earlier[at] | (owner > least[at])


def answered(blocks: DataFrame, reply: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring each block's documents and answers together.

    The documents are dealt as in ``answers``, from the same table and columns, so that Spark deals them once.
    """
    return blocks.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(work, schema)
