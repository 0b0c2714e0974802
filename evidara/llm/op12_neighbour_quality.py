"""Quality by votes of the nearest labelled documents in a latent-semantic space.

Terms of a text are its words in lower case, the shapes of its words (letters and digits become classes, runs of one
class count once, so ``WORD!!`` and ``word###`` are terms whatever the word), pairs of shapes, and whether a word repeats the
one before.  All are hashed to TERMS columns and weighted by the square root of their share of the text times their rarity among the
learnt texts; the words and the other terms have half of the vector each.  The centred matrix of the learnt texts is decomposed (subspace
iteration in numpy), its first DIMENSIONS right singular vectors are the latent space, and a text's vector is its projection.

The learnt texts' vectors go to the tasks (at most 2 * FIT_ROWS rows of DIMENSIONS numbers, the proven bound).  Each batch of documents is
multiplied with all of them in blocks, which gives every cosine exactly; the NEIGHBOURS most similar texts vote with their
cosines, and a vote counts by the inverse of its class's size among the learnt texts.

Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2, at most FIT_ROWS of each class (smallest hashes of
doc_id, a documented bound) and FIT_CHARS // 2 characters of each: a text that doesn't fit what is left is skipped.  Every document is
scored over its whole text.  labels, lang, source and doc_id never enter a score.

Nulls and edges: NULL and blank texts have no vector and score 0.5; labels without a document, NULL labels and NULL doc_ids
are not learnt from; with labels of one class only the score is that class, without any 0.5; held_out is NULL for a NULL
doc_id; a doc_id labelled twice is learnt twice; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import crc_bucket, in_pieces, one_chunk, split_words, table, texts
from evidara.llm.op9_subword_toxicity import fitting

TERMS, DIMENSIONS, NEIGHBOURS, FIT_ROWS, THRESHOLD = 1 << 13, 48, 15, 2000, 0.7
FIT_CHARS = 40_000_000
#: (text, term) pairs that are projected at once, and cosines of a block.
PAIRS, COSINES = 200_000, 4_000_000
HALF = TERMS // 2
REPEATED = TERMS - 1
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def shape(word: str) -> str:
    """Letters as a (lower), A (upper) or B (both), digits as 0, and what else there is, runs of one sign as one."""
    marked = _DIGITS.sub("0", _LETTERS.sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() else "B", word))
    return re.sub(r"(.)\1+", r"\1\1", marked)[:16]


def _hash(text: str, part: int) -> int:
    return part * HALF + xxhash.xxh3_64_intdigest(text) % (HALF - 1)


def counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all (text, term) pairs text, term and how often, ordered by text; words of each text."""
    words, offsets = split_words(column)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lowered = [w.lower() for w in distinct]
    shapes = [shape(w) for w in distinct]
    names = {s: i for i, s in enumerate(dict.fromkeys(shapes))}
    low_names = {s: i for i, s in enumerate(dict.fromkeys(lowered))}
    word_term = np.fromiter((_hash(w, 0) for w in lowered), np.int64, len(lowered))
    shape_term = np.fromiter((_hash(s, 1) for s in shapes), np.int64, len(shapes))
    shape_id = np.fromiter((names[s] for s in shapes), np.int64, len(shapes))
    low_id = np.fromiter((low_names[w] for w in lowered), np.int64, len(lowered))
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    inner = np.ones(len(index), bool)  # has a word before it
    inner[offsets[:-1][n > 0]] = False
    second = np.flatnonzero(inner)
    # pairs of shapes: hashed once a distinct pair
    pair, at = np.unique(shape_id[index[second - 1]] * max(1, len(names)) + shape_id[index[second]], return_inverse=True)
    by_id = list(names)
    pair_term = np.fromiter((_hash(f"{by_id[p // len(names)]} {by_id[p % len(names)]}", 1) for p in pair.tolist()), np.int64, len(pair))
    same = second[low_id[index[second - 1]] == low_id[index[second]]]
    keys = np.concatenate([text * TERMS + word_term[index], text * TERMS + shape_term[index], text[second] * TERMS + pair_term[at], text[same] * TERMS + REPEATED])
    found, times = np.unique(keys, return_counts=True)
    return found // TERMS, found % TERMS, times, n


def weights(text: np.ndarray, term: np.ndarray, times: np.ndarray, n: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Of all pairs; the words and the other terms of a text each have length sqrt(1/2)."""
    value = np.sqrt(times / n[text]) * rarity[term]
    part = 2 * text + (term >= HALF)
    length = np.sqrt(2 * np.bincount(part, value * value, 2 * len(n)))
    return value / np.maximum(length[part], 1e-12)


class Model:
    def __init__(self, rarity: np.ndarray, centre: np.ndarray, space: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.rarity, self.centre, self.space = rarity, centre.astype(np.float32), space.astype(np.float32)
        self.vectors, self.labels = vectors.astype(np.float32), np.asarray(labels, np.int64)
        ones = max(1, int(self.labels.sum())), max(1, int((1 - self.labels).sum()))
        self.power = np.where(self.labels == 1, 1 / ones[0], 1 / ones[1])

    def project(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the texts in the latent space, and which have words."""
        text, term, times, n = counts(column)
        value = weights(text, term, times, n, self.rarity).astype(np.float32)
        out = np.zeros((len(n), self.space.shape[1]), np.float32)
        for a in range(0, len(text), PAIRS):
            part = slice(a, a + PAIRS)
            own, first = np.unique(text[part], return_index=True)
            out[own] += np.add.reduceat(self.space[term[part]] * value[part, None], first, axis=0)
        out -= self.centre @ self.space
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), n > 0

    def score(self, column) -> np.ndarray:
        if not len(self.labels) or self.labels.min() == self.labels.max():
            return np.full(len(column), float(self.labels[0]) if len(self.labels) else 0.5)
        own, full = self.project(column)
        out = np.full(len(own), 0.5)
        m = len(self.labels)
        k = min(NEIGHBOURS, m)
        step = max(1, COSINES // m)
        for a in range(0, len(own), step):
            cosine = own[a : a + step] @ self.vectors.T
            rank = np.rint(cosine * 1e6).astype(np.int64) * m - np.arange(m)  # of equally similar ones the first
            near = np.argpartition(rank, m - k, axis=1)[:, m - k :]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) * self.power[near]
            out[a : a + step] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return np.where(full, np.clip(out, 0, 1), 0.5)


def decompose(x: np.ndarray, dimensions: int, seed: int = 5) -> np.ndarray:
    """First right singular vectors as columns, by subspace iteration."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(x.T @ rng.normal(size=(len(x), min(len(x), x.shape[1], dimensions + 16))).astype(x.dtype))[0]
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T[:, :dimensions]


def fit(column, labels: np.ndarray) -> Model:
    parts = [counts(batch["text"]) for batch in in_pieces([pa.record_batch([one_chunk(column)], ["text"])])]
    ends = np.cumsum([0] + [len(p[3]) for p in parts])
    seen = np.zeros(TERMS)
    for _, term, _, _ in parts:
        seen += np.bincount(term, minlength=TERMS)
    rarity = np.log((len(labels) + 1) / (seen + 1)) + 1
    x = np.zeros((len(labels), TERMS), np.float32)
    for begin, (text, term, times, n) in zip(ends, parts, strict=False):
        x[begin + text, term] = weights(text, term, times, n, rarity)
    centre = x.mean(axis=0) if len(x) else np.zeros(TERMS, np.float32)
    x -= centre
    space = decompose(x, DIMENSIONS) if len(x) else np.zeros((TERMS, 1))
    vectors = x @ space.astype(np.float32)
    return Model(rarity, centre, space, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), labels)


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of each class."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(crc_bucket(F.col("doc_id"), 4) != 2)
    most = FIT_CHARS // 2
    sized = marks.join(texts(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), "doc_id").filter(F.col("n") <= most).withColumn("hash", F.xxhash64("doc_id"))
    parts = [sized.filter(F.col("y") == y).orderBy("hash", "doc_id", "n").limit(rows) for y in (0, 1)]

    def within(some: pa.Table) -> pa.Table:
        some = some.sort_by([("hash", "ascending"), ("doc_id", "ascending"), ("n", "ascending")])
        return some.filter(pa.array(fitting(some["n"].to_pylist(), most))).select(["doc_id", "y"])

    chosen = functools.reduce(DataFrame.unionByName, parts).groupBy("y").applyInArrow(within, "doc_id long, y int")

    def learnt(some: pa.Table) -> pa.Table:
        some = some.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
        model = fit(some["text"], some["y"].to_numpy())
        return pa.table({name: pa.array([np.ascontiguousarray(getattr(model, name), np.float64).tobytes()], pa.binary()) for name in _PARTS})

    # the bounded sample meets in one task; only the model comes to the driver
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("all", F.lit(0))
    found = sample.groupBy("all").applyInArrow(learnt, ", ".join(f"{name} binary" for name in _PARTS)).first()
    if not found:
        return fit(pa.array([], pa.string()), np.empty(0, np.int64))
    read = {name: np.frombuffer(found[name]) for name in _PARTS}
    width = len(read["space"]) // TERMS
    return Model(read["rarity"], read["centre"], read["space"].reshape(TERMS, width), read["vectors"].reshape(-1, width), read["labels"].astype(np.int64))


_PARTS = ("rarity", "centre", "space", "vectors", "labels")


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(batch["text"]), pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(score, "doc_id long, score double")


def with_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose text scores ``threshold`` or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            yield batch.filter(pa.array(model.score(batch["text"]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op12_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL = None
