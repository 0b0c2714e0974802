"""Suffix-array dedup over sparse suffix arrays.

1. Sample.  In every run of 20 consecutive 6-word grams the one with the smallest hash (leftmost of equals) is a
   minimiser, so the choice depends on content alone and equal passages keep equal suffixes.  Every 25 consecutive
   words hold at least one retained suffix.
2. Sort and compare.  Retained suffixes are sorted by their first 25 words (64-bit keys with 32 more bits of a second hash, over key ranges,
   ``repeats``); one whose neighbours come from another document is a seed.
3. Extend.  Every 50-word window whose leading 25 words hold a seed is matched left and right of the seed: the
   windows' keys are sorted and compared in the same way.  Two equal windows of 50 words have the same leading
   25 words, hence the same minimiser there, hence both see a seed: no repeat of 50 words or more is missed, and what is
   reported is exactly the words in 50-word windows that occur in several documents.

Result: one row per maximal repeated span, for the first copy and the later ones alike; ``n_removable`` counts the
span's words that a document with a smaller doc_id holds too, the ones to drop so that one copy stays.

Nulls and edges: NULL and short texts have no spans; rows with a NULL doc_id take no part; rows that share a doc_id
count as one document; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from evidara.llm import repeats
from evidara.llm.common import covered, rolling, runs, table, window_starts

LENGTH, GRAM, RUN = 50, 6, 20
SCHEMA = "doc_id long, start long, end long, n_words long, n_removable long, passage string"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]


def minimisers(codes: np.ndarray, offsets: np.ndarray, gram: int, run: int) -> np.ndarray:
    """Which words begin a gram that is the leftmost smallest of some run of grams in its text."""
    kept = np.zeros(len(codes), bool)
    grams = rolling(codes, gram)
    starts = window_starts(offsets, gram + run - 1)
    if not len(starts):
        return kept
    best, span = np.arange(len(grams)), 1
    while span < run:  # the leftmost smallest of 2, 4, ... and at last of run grams from each place
        step = min(span, run - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        span += step
    kept[best[starts]] = True
    return kept


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """Maximal spans of words that lie in ``length``-word windows found in several documents."""
    reach = gram + run - 1
    assert length >= 2 * reach, "a repeat must hold a retained suffix with reach words to its right"
    blocks = repeats.in_blocks(docs)

    def suffixes(block: repeats.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(block.codes), bool)
        inside[window_starts(block.offsets, reach)] = True
        return repeats.sequence_keys(block, np.flatnonzero(minimisers(block.codes, block.offsets, gram, run) & inside), reach)

    groups = repeats.plan_groups(docs, lambda block: suffixes(block)[1] >> np.uint64(48))
    seeds = repeats.answers(blocks, suffixes, groups)

    def extended(block: repeats.Words, answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, keys, checks = suffixes(block)
        shared, _ = repeats.judge(block, at, keys, checks, answer, groups)
        until = np.concatenate([[0], np.cumsum(np.bincount(at[shared], minlength=len(block.codes)))])
        starts = window_starts(block.offsets, length)
        return repeats.sequence_keys(block, starts[until[starts + run] > until[starts]], length)

    def send(texts: pa.Table, answer: pa.Table) -> pa.Table:
        block = texts["block"][0].as_py()
        return repeats.packed(block, *(extended(repeats.Words(texts), answer)[1:] if block >= 0 else repeats.NO_KEYS), groups)

    def spans(texts: pa.Table, both: pa.Table) -> pa.Table:
        if texts["block"][0].as_py() < 0:  # NULL ids
            return pa.table({name: pa.array([], kind) for name, kind in zip(NAMES, [pa.int64()] * 5 + [pa.string()], strict=True)})
        block = repeats.Words(texts)
        of = [both.filter(pc.equal(both["round"], k)) for k in (1, 2)]
        at, keys, checks = extended(block, of[0])
        shared, earlier = repeats.judge(block, at, keys, checks, of[1], groups)
        some, removable = (covered(len(block.words), at[x], length) for x in (shared, earlier))
        i, a, b = runs(some, block.offsets)
        n = np.concatenate([[0], np.cumsum(removable)])
        passages = pa.array([" ".join(block.words.slice(x, y - x).to_pylist()) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string())
        return pa.table({"doc_id": pa.array(block.doc_id[i], pa.int64()), "start": a - block.offsets[i], "end": b - block.offsets[i], "n_words": b - a, "n_removable": n[b] - n[a], "passage": passages})

    matched = repeats.answered(blocks, seeds, send, "grp long, block long, keys binary")
    replies = seeds.selectExpr("*", "1 as round").unionByName(repeats.compared(matched).selectExpr("*", "2 as round"))
    return repeats.answered(blocks, replies, spans, SCHEMA)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).selectExpr("doc_id", "start", "end", "n_words", "n_removable", "sha2(encode(passage, 'UTF-8'), 256) as passage_sha256")


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(words, p + 1, p + 50), ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS p FROM w WHERE len(words) >= 50)
), firsts AS (SELECT win, min(doc_id) AS first_doc FROM starts GROUP BY win HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, pos, max(CAST(later AS INTEGER)) AS later
  FROM (SELECT s.doc_id, unnest(range(s.p, s.p + 50)) AS pos, f.first_doc < s.doc_id AS later FROM starts s JOIN firsts f USING (win))
  GROUP BY doc_id, pos
), islands AS (
  SELECT doc_id, pos, later, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM hits
), spans AS (
  SELECT doc_id, min(pos) AS s, max(pos) + 1 AS e, sum(later) AS n_removable FROM islands GROUP BY doc_id, island
)
SELECT w.doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(e - s AS BIGINT) AS n_words,
       CAST(n_removable AS BIGINT) AS n_removable,
       sha256(array_to_string(list_slice(words, s + 1, e), ' ')) AS passage_sha256
FROM spans JOIN w USING (doc_id)
"""
