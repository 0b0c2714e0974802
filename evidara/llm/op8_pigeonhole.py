"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are rows of words: ASCII white space splits, A-Z are lower-cased, punctuation at a word's ends goes.
An item of m words may differ by k = m // 6 word edits.  It is split into k + 1 pieces; k edits leave one piece
untouched, so a text that holds the item holds a piece exactly.  Piece hits come from rolling hashes looked up in the
sorted hashes of all pieces of a length.  Around each hit Myers' bit-parallel recurrence over words computes the
item's smallest edit distance to any stretch of the text, and a second run backwards finds where the stretch begins.

The items go to the tasks in blocks of at most ITEM_CHARS characters, the proven bound of what is sent.  Of a larger benchmark
only the hashes of its pieces go to the tasks first (SENT_PIECES of 8 bytes in a pass over the documents); the documents that hold
a piece, few of all, are written, and the blocks of items meet those only.

Result: one row per document row and item within k edits, at its smallest distance (leftmost of equals).

Nulls and edges: NULL or blank texts match nothing; items of under ``least`` words are too short to tell a leak and
match nothing; repeated items each give a row; NULL ids are passed on; empty tables give an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import durable, in_pieces, rolling, split_words, table, texts, window_starts

ITEM_CHARS, LEAST, WORDS_PER_EDIT = 8_000_000, 5, 6
SENT_PIECES = 4_000_000
PUNCTUATION = ".,;:!?\"'()[]{}*#%&$|<>-_/"
SCHEMA = "doc_id long, item_id long, distance long, item_words long, start long, end long"


def normal_codes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of all texts, where each text begins, and each kept word's place among the text's raw words."""
    words, offsets = split_words(column)
    coded = pc.ascii_lower(words).dictionary_encode()
    bare = [w.strip(PUNCTUATION) for w in coded.dictionary.to_pylist()]
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in bare), np.uint64, len(bare))[coded.indices.to_numpy(zero_copy_only=False)] if len(bare) else np.empty(0, np.uint64)
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    real = codes != 0
    before = np.concatenate([[0], np.cumsum(real)])
    return codes[real], before[offsets], place[real]


def myers(pattern: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the whole pattern to a stretch of text and the first place where one ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, word in enumerate(text):
        eq = pattern.get(word, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = (minus | ~(zero | plus)) & full, plus & zero
        score += bool(up & high) - bool(down & high)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces_of(m: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the pieces of an item of m words: one more than the edits that it may have."""
    n = m // WORDS_PER_EDIT + 1
    cut = [m * i // n for i in range(n + 1)]
    yield from zip(cut[:-1], cut[1:], strict=True)


class Item:
    def __init__(self, item_id: int | None, codes: np.ndarray):
        self.id, self.m, self.k = item_id, len(codes), len(codes) // WORDS_PER_EDIT
        self.codes = codes
        self.forward, self.backward = {}, {}
        for i, c in enumerate(codes.tolist()):
            self.forward[c] = self.forward.get(c, 0) | 1 << i
            self.backward[c] = self.backward.get(c, 0) | 1 << (self.m - 1 - i)

    def pieces(self) -> Iterator[tuple[int, int]]:
        yield from pieces_of(self.m)

    def within(self, text: np.ndarray, at: int) -> tuple[int, int, int] | None:
        """distance, start and end in the text of the best stretch when the item would begin near ``at``."""
        low = max(0, at - self.k)
        near = text[low : max(0, at + self.m + self.k)].tolist()
        distance, end = myers(self.forward, self.m, near)
        if distance > self.k:
            return None
        back = self.m if distance == 0 else myers_back(self.backward, self.m, near[:end][::-1], distance)[1]
        return distance, low + end - back, low + end


def myers_back(pattern: dict[int, int], m: int, text: list[int], distance: int) -> tuple[int, int]:
    """The shortest prefix of ``text`` that the whole pattern has the distance to (both ends fixed at the front)."""
    row = list(range(m + 1))  # few and short: the plain recurrence with a fixed start
    if row[m] == distance:
        return distance, 0
    order = [0] * m
    for code, mask in pattern.items():
        for i in range(m):
            if mask >> i & 1:
                order[i] = code
    for j, word in enumerate(text):
        new = [j + 1]
        for i in range(m):
            new.append(min(row[i] + (order[i] != word), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[m] == distance:
            return distance, j + 1
    return distance, len(text)


def items_of(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """item_id and text of the benchmark, and how many blocks of about ITEM_CHARS characters they make."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return items, max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))


def in_blocks(items: DataFrame, n: int) -> Iterator[pa.Table]:
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()


def hashed_pieces(items: DataFrame, least: int) -> DataFrame:
    """length and hash of the distinct pieces of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            codes, offsets, _ = normal_codes(batch["text"])
            found = [(b - a, rolling(codes[begin + a : begin + b], b - a)[0]) for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if end - begin >= least for a, b in pieces_of(end - begin)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(np.array([h for _, h in found], np.uint64).view(np.int64))], names=["length", "hash"])

    return items.mapInArrow(cut, "length long, hash long").distinct()


def with_hits(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """docs with __hit: the text holds a piece of some item."""
    pieces = durable(hashed_pieces(items, least))
    out = docs.withColumn("__hit", F.lit(False))
    n = -(-pieces.count() // SENT_PIECES)
    for k in range(n):
        rows = pieces.filter(F.pmod("hash", F.lit(n)) == k).toArrow()
        length, hashes = rows["length"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        sent = {int(m): np.sort(hashes[length == m]) for m in np.unique(length)}

        def mark(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches):
                codes, offsets, _ = normal_codes(batch["text"])
                hit = batch["__hit"].to_numpy(zero_copy_only=False).copy()
                for m, keys in sent.items():
                    starts = window_starts(offsets, m)
                    h = rolling(codes, m)[starts] if len(starts) else np.empty(0, np.uint64)
                    found = starts[keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h]
                    hit[np.searchsorted(offsets, found, "right") - 1] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit)], names=batch.schema.names)

        out = out.mapInArrow(mark, out.schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, distance, item_words, start, end (words of the text) of every item found in a document."""
    items, n = items_of(benchmark)
    docs = texts(docs)
    if n > 1:
        docs = durable(with_hits(docs, items, least).filter("__hit").drop("__hit"))
    out = None
    for part in in_blocks(items, n):
        search = _matcher(part, least)

        def match(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "distance", "item_words", "start", "end"]
            for ids, rows in search(batches):
                columns = list(zip(*((ids["doc_id"][r[0]].as_py(), *r[1:]) for r in rows), strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

        found = docs.mapInArrow(match, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows, all columns as they are, whose text holds no item."""
    items, n = items_of(benchmark)
    clean = None
    if n > 1:
        marked = with_hits(docs, items, least)
        clean, docs = marked.filter("not __hit").drop("__hit"), durable(marked.filter("__hit").drop("__hit"))
    for part in in_blocks(items, n):
        search = _matcher(part, least)

        def keep(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch, rows in search(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs if clean is None else clean.unionByName(docs)


def _matcher(part: pa.Table, least: int):
    """Maps batches to (batch, rows of text number, item_id, distance, item_words, start, end)."""
    codes, offsets, _ = normal_codes(part["text"])
    spans = zip(part["item_id"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    raw = [(i, codes[a:b]) for i, a, b in spans if b - a >= least]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        items = [Item(i, c) for i, c in raw]
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for n, item in enumerate(items):
            for a, b in item.pieces():
                by_length.setdefault(b - a, []).append((int(rolling(item.codes[a:b], b - a)[0]), n, a))
        lookup = {}
        for length, entries in by_length.items():
            entries.sort()
            lookup[length] = (np.array([e[0] for e in entries], np.uint64), entries)
        for batch in in_pieces(batches):
            codes, offsets, place = normal_codes(batch["text"])
            starts: dict[tuple[int, int], set[int]] = {}
            for length, (keys, entries) in lookup.items():
                hashes = rolling(codes, length)
                slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                for p in np.flatnonzero(keys[slot] == hashes).tolist():
                    doc = int(np.searchsorted(offsets, p, "right")) - 1
                    if p + length > offsets[doc + 1]:
                        continue
                    e, key = int(slot[p]), hashes[p]
                    while e < len(keys) and keys[e] == key:
                        starts.setdefault((doc, entries[e][1]), set()).add(p - entries[e][2] - int(offsets[doc]))
                        e += 1
            rows = []
            for (doc, n), places in sorted(starts.items()):
                text, item = codes[offsets[doc] : offsets[doc + 1]], items[n]
                hits = [h for h in (item.within(text, p) for p in sorted(places)) if h]
                if hits:
                    d, a, b = min(hits)
                    raw_place = place[offsets[doc] : offsets[doc + 1]]
                    rows.append((doc, item.id, d, item.m, int(raw_place[a]), int(raw_place[b - 1]) + 1))
            yield batch, rows

    return match


def op8_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = None
