"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts.  Every training document's tokens are counted, N tokens of V kinds.  The OWN most frequent tokens are classes of
their own; all others fall into SHARED classes by their last two characters, a function of the word alone, so that
unseen words have a class too.  P(token | history) = P(class | two classes before) * P(token | class).

* P(class | history): q = C1 r(before) + C2 r(before that), logits q . t(class) + bias.  Trained in numpy by
  noise-contrastive estimation, noise from the class frequencies.  What training needs of the corpus is how often each
  class follows each two classes, counted over all training documents in SHARDS shards by the hash of the document, at most
  CLASSES ** 3 rows each.  In each of ROUNDS rounds every shard goes through all its rows, each weighted by its count (a
  row of over HEAVY times the mean count as several), and the shards' parameters are averaged by tokens.  So every token
  counts, the work is bounded by the kinds of rows, and the result doesn't depend on the partitioning.
* Scoring normalises exactly: batched matrix products give the logits of all classes for all pairs of classes before,
  and their softmax is a table that every task computes once.
* P(token | class): (c + 1) / (tokens + kinds + 1) of the class, the base score's own smoothing: one possible word of each
  class is taken to be unseen, as the base takes one of the whole vocabulary to be.  So the model differs from the base by
  what the history tells of the class, and an unseen word has no more than its part.

The counts of the most frequent tokens (at most HEAD, the proven bound; of equally frequent ones those of the smallest
codes) go to the tasks.  All other tokens of a document are joined with the table of counts, which may grow with the
corpus, and summed per document.  Which tokens go to the tasks changes no score.

Nulls and edges: a NULL text is one end token; a NULL doc_id is scored, not learnt from, and has a NULL held_out;
repeated rows are learnt from and scored each (fully equal ones once, and the row is repeated); with nothing to learn from, N = V = 0, the base score is log10(1/1)
and the model's classes are even; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import crc_bucket, durable, in_pieces, split_words, table, texts

HEAD, OWN, SHARED, WIDTH, NOISE, BATCH, RATE = 1 << 17, 192, 64, 16, 32, 4096, 0.1
CLASSES, START = OWN + SHARED, OWN + SHARED
SHARDS, ROUNDS, HEAVY = 8, 3, 8
END = xxhash.xxh3_64_intdigest("\n")
HELD_OUT = (7, 2)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token index (into the distinct codes) of all texts, each with its end; where texts begin; codes; shared classes."""
    words, offsets = split_words(column)
    coded = pc.ascii_lower(words).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    shared = np.fromiter((xxhash.xxh3_64_intdigest(w[-2:]) % SHARED for w in distinct), np.int64, len(distinct))
    index = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:], len(distinct))
    return index, offsets + np.arange(len(offsets)), np.append(codes, np.uint64(END)), np.append(shared, 0)


def count(docs: DataFrame) -> DataFrame:
    """code, shared, n of all tokens; counts are summed in each task first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in in_pieces(batches):
            index, _, codes, shared = tokens(batch["text"])
            held.append((codes, shared, np.bincount(index, minlength=len(codes))))
            if len(held) == 64:
                held = [_merged(held)]
        if held:
            codes, shared, n = _merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(shared), pa.array(n)], names=["code", "shared", "n"])

    return docs.mapInArrow(local, "code long, shared long, n long").groupBy("code", "shared").agg(F.sum("n").alias("n"))


def _merged(held):
    codes, shared, n = (np.concatenate(x) for x in zip(*held, strict=True))
    distinct, first, at = np.unique(codes, return_index=True, return_inverse=True)
    return distinct, shared[first], np.bincount(at, n, len(distinct)).astype(np.int64)


class Vocabulary:
    """Counts of the frequent tokens by sorted code, own classes and the sums of the shared ones."""

    def __init__(self, counts: DataFrame):
        totals = counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toPandas()
        self.n, self.kinds = int(totals["n"].sum()), int(totals["kinds"].sum())
        head = counts.filter(self._choose_head(counts)).toPandas()
        own = counts.orderBy(F.col("n").desc(), "code").limit(OWN).toPandas()
        head = pd.concat([head, own]).drop_duplicates("code")
        codes, n, shared = head["code"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), head["shared"].to_numpy(np.int64)
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], n[order]
        shared = shared[order]
        own = np.lexsort((self.codes, -self.counts))[:OWN]
        self.own = np.full(len(self.codes), -1, np.int64)
        self.own[own] = np.arange(len(own))
        self.class_tokens, self.class_kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        self.class_tokens[OWN + totals["shared"].to_numpy(np.int64)] = totals["n"].to_numpy(np.int64)
        self.class_kinds[OWN + totals["shared"].to_numpy(np.int64)] = totals["kinds"].to_numpy(np.int64)
        np.subtract.at(self.class_tokens, OWN + shared[own], self.counts[own])
        np.subtract.at(self.class_kinds, OWN + shared[own], 1)
        self.class_tokens[: len(own)] = self.counts[own]

    def _choose_head(self, counts: DataFrame):
        """Which rows of counts go to the tasks: the levels of most tokens that fit, and the first parts of the next one."""
        level, part = F.floor(F.log2("n") * 64), F.shiftright("code", 52)
        levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("kinds")).toPandas().sort_values("level", ascending=False)
        fits = levels["kinds"].cumsum() <= HEAD
        chosen = level > int(levels["level"].max() if not fits.any() else levels["level"][fits].min() - 1) if len(levels) else F.lit(False)
        if not fits.all():
            last, left = int(levels["level"][~fits].max()), HEAD - int(levels["kinds"][fits].sum())
            parts = counts.filter(level == last).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("kinds")).toPandas().sort_values("part")
            end = parts["part"][parts["kinds"].cumsum() > left].min()
            chosen = chosen | ((level == last) & (part < int(end)))
        self.in_head = chosen
        return chosen

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "in_head"}  # a column stays on the driver

    def look_up(self, codes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each code, and its count or -1 if it is not among the frequent ones."""
        if not len(self.codes):
            return OWN + shared, np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        own = np.where(hit, self.own[at], -1)
        return np.where(own >= 0, own, OWN + shared), np.where(hit, self.counts[at], -1)

    def log_in_class(self, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(token | class) of tokens counted n times; 0 times: the class's unseen word."""
        return np.where(of < OWN, 0.0, np.log10(n + 1) - self.log_mass()[of])

    def log_mass(self) -> np.ndarray:
        """Of each class log10 of its tokens, kinds and the unseen word."""
        return np.log10(self.class_tokens + self.class_kinds + 1)


class LogBilinear:
    def __init__(self, frequency: np.ndarray, values: np.ndarray | None = None):
        share = (frequency + 1.0) / (frequency + 1.0).sum()
        self.noise = share
        rng = np.random.default_rng(11)
        shapes = [(CLASSES + 1, WIDTH), (CLASSES, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (CLASSES,)]
        self.parts = [rng.normal(0, 0.1, shapes[0]), rng.normal(0, 0.1, shapes[1]), np.eye(WIDTH), 0.5 * np.eye(WIDTH), np.log(share)]
        if values is not None:
            ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
            self.parts = [values[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)]
        self.squares = [np.full(p.shape, 1e-3) for p in self.parts]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def train(self, before: np.ndarray, further: np.ndarray, target: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation over weighted rows; the noise tokens are shared by the batch."""
        context, out, c1, c2, bias = self.parts
        noise = rng.choice(CLASSES, NOISE, p=self.noise)
        r1, r2 = context[before], context[further]
        q = r1 @ c1 + r2 @ c2
        k = np.log(NOISE * self.noise)
        good = 1 / (1 + np.exp(-np.clip((q * out[target]).sum(axis=1) + bias[target] - k[target], -30, 30))) - 1
        bad = 1 / (1 + np.exp(-np.clip(q @ out[noise].T + bias[noise] - k[noise], -30, 30)))
        n = len(target)
        good, bad = good * weight, bad * weight[:, None]
        dq = (good[:, None] * out[target] + bad @ out[noise]) / n
        d_out = _summed(target, q * good[:, None], CLASSES) / n
        np.add.at(d_out, noise, bad.T @ q / n)
        d_bias = np.bincount(target, good, CLASSES) / n
        np.add.at(d_bias, noise, bad.sum(axis=0) / n)
        d_context = _summed(before, dq @ c1.T, CLASSES + 1) + _summed(further, dq @ c2.T, CLASSES + 1)
        for p, g, s in zip(self.parts, (d_context, d_out, r1.T @ dq, r2.T @ dq, d_bias), self.squares, strict=True):
            s += g * g
            p -= RATE * g / np.sqrt(s)

    def log_table(self) -> np.ndarray:
        """float32[before, further, class]: normalised log10 probabilities."""
        context, out, c1, c2, bias = self.parts
        near, far = context @ c1 @ out.T + bias, context @ c2 @ out.T
        found = np.empty((CLASSES + 1, CLASSES + 1, CLASSES), np.float32)
        even = np.log(self.noise)
        for i in range(CLASSES + 1):
            logits = near[i] + far
            logits -= logits.max(axis=1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
            found[i] = np.logaddexp(np.log(0.9) + logits, np.log(0.1) + even) / np.log(10)
        return found


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, rows[:, d], n) for d in range(rows.shape[1])], axis=1)


def history(of: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before each token and the one before that; START outside the text."""
    before = np.concatenate([[START], of[:-1]]) if len(of) else of
    further = np.concatenate([[START, START], of[:-2]])[: len(of)]
    first = offsets[:-1]
    before[first], further[first] = START, START
    second = first[np.diff(offsets) > 1] + 1
    further[second] = START
    return before, further


def followers(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """shard, key, n: how often the class follows the two classes before; key packs before, further and the class."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in in_pieces(batches):
            index, offsets, codes, shared = tokens(batch["text"])
            of = words.look_up(codes, shared)[0][index]
            before, further = history(of, offsets)
            shard = np.repeat(batch["shard"].to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
            held.append(np.unique(((shard * (CLASSES + 1) + before) * (CLASSES + 1) + further) * CLASSES + of, return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 21:
                held = [_summed_keys(held)]
                size = 0
        if held:
            key, n = _summed_keys(held)
            step = (CLASSES + 1) ** 2 * CLASSES
            yield pa.RecordBatch.from_arrays([pa.array(key // step), pa.array(key % step), pa.array(n)], names=["shard", "key", "n"])

    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)))
    return dealt.mapInArrow(local, "shard long, key long, n long").groupBy("shard", "key").agg(F.sum("n").alias("n"))


def _summed_keys(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def train(docs: DataFrame, words: Vocabulary) -> LogBilinear:
    """From all training documents; each round averages what the shards have learnt from the same start."""
    frequency, rows = words.class_tokens, durable(followers(docs, words))
    model = LogBilinear(frequency)
    for turn in range(ROUNDS):
        work = _learnt(frequency, model.flat(), turn)
        found = rows.groupBy("shard").applyInArrow(work, "shard long, n long, values array<double>").toPandas().sort_values("shard")
        if len(found):
            model = LogBilinear(frequency, np.average(np.stack(found["values"]), axis=0, weights=found["n"].to_numpy(float)))
    return model


def _learnt(frequency: np.ndarray, start: np.ndarray, turn: int):
    """A round of a shard: its number, its tokens and the parameters that it comes to."""

    def learnt(shard: pa.Table) -> pa.Table:
        number = shard["shard"][0].as_py()
        key, n = shard["key"].to_numpy(), shard["n"].to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        own, rng = LogBilinear(frequency, start), np.random.default_rng([turn, number])
        mean = n.sum() / len(n)
        parts = np.ceil(n / (HEAVY * mean)).astype(np.int64)  # at most an eighth more rows
        key, weight = np.repeat(key, parts), np.repeat(n / parts / mean, parts)
        order = rng.permutation(len(key))
        for a in range(0, len(key), BATCH):
            some = order[a : a + BATCH]
            pair = key[some] // CLASSES
            own.train(pair // (CLASSES + 1), pair % (CLASSES + 1), key[some] % CLASSES, weight[some], rng)
        return pa.table({"shard": [number], "n": [int(n.sum())], "values": pa.array([own.flat()], pa.list_(pa.float64()))})

    return learnt


SCORED = "doc_id long, row long, code long, packed long, own struct<n_tokens:long,n_known:long,base:double,score:double>"


def scores(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: LogBilinear) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document."""
    norm = float(np.log10(words.n + words.kinds + 1))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_class = model.log_table()
        for batch in in_pieces(batches):
            index, offsets, codes, shared = tokens(batch["text"])
            classes, n = words.look_up(codes, shared)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            of, known = classes[index], n[index] >= 0
            before, further = history(of, offsets)
            held = np.maximum(n, 0)
            base = np.where(n >= 0, np.log10(held + 1) - norm, 0.0)
            inside = np.where(n >= 0, words.log_in_class(classes, held), 0.0)
            size = len(offsets) - 1
            per = lambda values: np.bincount(text, values, size)
            own = pa.StructArray.from_arrays(
                [pa.array(np.diff(offsets)), pa.array(per(known).astype(np.int64)), pa.array(per(base[index])), pa.array(per(inside[index] + log_class[before, further, of]))],
                names=["n_tokens", "n_known", "base", "score"],
            )
            ids, row = batch["doc_id"], batch["row"].to_numpy()
            apart = row ^ np.arange(1, size + 1) * 0x9E3779B1  # no token's code: deals these rows evenly
            yield pa.RecordBatch.from_arrays([ids, batch["row"], pa.array(apart), pa.array(np.zeros(size, np.int64)), own], names=names)
            rare = np.flatnonzero(~known)
            pairs, times = np.unique(text[rare] * len(codes) + index[rare], return_counts=True)
            at, word = pairs // len(codes), pairs % len(codes)
            none = pa.nulls(len(pairs), own.type)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(row[at]), pa.array(codes[word].view(np.int64)), pa.array(times * CLASSES + classes[word]), none], names=names)

    names = ["doc_id", "row", "code", "packed", "own"]
    parts = texts(docs).withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(local, SCORED)
    rare = counts.filter(~words.in_head).select("code", "n")
    joined = parts.join(rare, "code", "left")
    times, of = F.floor(F.col("packed") / CLASSES), (F.col("packed") % CLASSES).cast("int")
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    inside = F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.get(numbers(words.log_mass()), of)
    tail = F.col("own").isNull()
    once = joined.groupBy("doc_id", "row").agg(
        F.count("own").alias("copies"),  # fully equal rows
        F.max("own.n_tokens").alias("n_tokens"),
        F.sum(F.when(tail, F.when(F.col("n").isNotNull(), times).otherwise(0)).otherwise(F.col("own.n_known"))).alias("n_known"),
        F.sum(F.when(tail, times * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - norm)).otherwise(F.col("own.base"))).alias("base_score"),
        F.sum(F.when(tail, times * inside).otherwise(F.col("own.score"))).alias("score"),
    )
    each = once.select("doc_id", "n_tokens", F.expr("n_known div copies").alias("n_known"), (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"), F.explode(F.expr("sequence(1, copies)")))
    return each.drop("col")


def language_model(docs: DataFrame, learnt: DataFrame) -> DataFrame:
    """Scores of docs under the model learnt from ``learnt``."""
    learnt = texts(learnt)
    counts = durable(count(learnt))
    words = Vocabulary(counts)
    return scores(docs, counts, words, train(learnt, words)).withColumn("train_tokens", F.lit(words.n).cast("long"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    modulus, rest = HELD_OUT
    found = language_model(docs, docs.filter(crc_bucket(F.col("doc_id"), modulus) != rest))
    held_out = crc_bucket(F.col("doc_id"), modulus) == rest
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL = None
