"""Substring dedup over prefix-partitioned suffix trees.

Every suffix of every text is cut to its first 13 words.  Variable-length word prefixes split the suffixes into
ranges that fit one task (``repeats.plan_groups``).  In a range, the sorted suffixes are the leaves of one subtree: a
node of depth 13 is a run of equal keys, and it is a repeat if leaves of two documents hang below it.  Deeper nodes
need no separate visit: a repeat of more than 13 words is a run of consecutive starts whose nodes all repeat, so the
maximal repeats are read off per document as maximal runs.

A word is removed if it lies in a 13-word window that also starts in a document with a smaller doc_id.

Nulls and edges: a NULL text has no words; texts of under 13 words keep all of them; rows with a NULL doc_id are kept
whole and are nobody's source; rows that share a doc_id never remove each other's words; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidara.llm import repeats
from evidara.llm.common import covered, per_text, runs, scramble, table, window_starts

WINDOW = 13
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


def suffix_keys(block: repeats.Words, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, their keys and checks."""
    return repeats.sequence_keys(block, window_starts(block.offsets, width), width)


def leading(block: repeats.Words, width: int = WINDOW) -> np.ndarray:
    starts = window_starts(block.offsets, width)
    first = scramble(block.codes) >> np.uint64(56)
    return (first[starts] << np.uint64(8)) | (first[starts + 1] if width > 1 else np.uint64(0))


def substring_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) and the removed word spans."""
    blocks = repeats.in_blocks(docs)
    groups = repeats.plan_groups(docs, lambda block: leading(block, width))
    keys = lambda block: suffix_keys(block, width)
    reply = repeats.answers(blocks, keys, groups)

    def remove(texts: pa.Table, answer: pa.Table) -> pa.Table:
        if texts.num_rows and texts["block"][0].as_py() < 0:  # NULL ids
            texts = texts.set_column(0, "doc_id", pa.array(np.zeros(texts.num_rows, np.int64)))
            return _kept(repeats.Words(texts), np.empty(0, np.int64), width, True)
        block = repeats.Words(texts)
        starts, key, check = keys(block)
        _, earlier = repeats.judge(block, starts, key, check, answer, groups)
        return _kept(block, starts[earlier], width, False)

    return repeats.answered(blocks, reply, remove, SCHEMA)


def _kept(block: repeats.Words, starts: np.ndarray, width: int, no_id: bool) -> pa.Table:
    n = len(block.words)
    gone = covered(n, starts, width)
    removed = per_text(gone, block.offsets)
    at, a, b = runs(gone, block.offsets)
    spans: list[list] = [[] for _ in block.doc_id]
    for i, x, y in zip(at.tolist(), a.tolist(), b.tolist(), strict=True):
        spans[i].append({"start": x - int(block.offsets[i]), "end": y - int(block.offsets[i])})
    left = block.words.filter(pa.array(~gone))
    ends = (np.diff(block.offsets) - removed).cumsum()
    kept = []
    for i, e in enumerate(ends.tolist()):
        s = e - int(block.offsets[i + 1] - block.offsets[i] - removed[i])
        kept.append(" ".join(left.slice(s, e - s).to_pylist()))
    ids = pa.nulls(len(block.doc_id), pa.int64()) if no_id else pa.array(block.doc_id, pa.int64())
    return pa.table({"doc_id": ids, "n_words": np.diff(block.offsets), "n_removed": removed, "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).selectExpr("doc_id", "n_words", "n_removed", "sha2(encode(kept_text, 'UTF-8'), 256) as kept_sha256", "size(spans) as n_spans")


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, p, list_slice(words, p, p + 12) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13)
), firsts AS (SELECT win, min(doc_id) AS first_doc FROM starts GROUP BY win
), hits AS (
  SELECT DISTINCT s.doc_id, s.p + k.i AS pos
  FROM starts s JOIN firsts f ON s.win = f.win AND f.first_doc < s.doc_id, (SELECT unnest(range(0, 13)) AS i) k
), marked AS (
  SELECT doc_id, count(*) AS n_removed,
         count(*) FILTER (WHERE prev IS NULL OR prev < pos - 1) AS n_spans
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM hits) GROUP BY doc_id
), kept AS (
  SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.pos) AS t
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w) k
  LEFT JOIN hits h ON h.doc_id = k.doc_id AND h.pos = k.pos WHERE h.pos IS NULL GROUP BY k.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans
FROM w LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
