"""What must not grow with the tables: broadcasts of a search, what a vector is sent to, evaluations of a log."""

import re

import numpy as np
from pyspark.sql import functions as F

from evidara.operators import chain, neighbours


def test_searches_broadcast_no_table_of_values(spark, monkeypatch):
    """Exploded and compressed tables look small to Spark: no join by the keys of values may be planned as a broadcast."""
    plans, plain = [], neighbours.durable
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(neighbours, "durable", lambda df: (told(df), plain(df))[1])
    rng = np.random.default_rng(11)
    values = [int(v) ^ (1 << b) for v in rng.integers(-(2**62), 2**62, 40) for b in (0, 0, 5)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, value long")
    told(neighbours.hamming_top_k(df, df, 3))
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, value array<float>")
    monkeypatch.setattr(neighbours, "REGION_ROWS", 20)
    told(neighbours.cosine_top_k(df, df, 3, 0.0))
    assert any("SortMergeJoin" in p for p in plans)
    assert not [m for p in plans for m in re.findall(r"BroadcastHashJoin \[(?:key|q|first)#\S*", p)]


def test_a_repair_computes_its_log_once(spark):
    """What the log is made from is read once, not once for each part of the repair."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(c, i, f"text {c} {i}") for c in "ab" for i in range(200)], "c string, seq long, content string")
    log = chain.relink(rows, chain="c").withColumn("previous_hash", F.when(F.col("seq") == 150, "0").otherwise(F.col("previous_hash")))
    log = log.withColumn("row_hash", F.sha2(F.concat("previous_hash", "content"), 256)).mapInArrow(counted, log.schema)
    repaired, found = chain.repair(log, "c", dry_run=False)
    checked = chain.link_check(repaired, chain="c")
    assert checked.filter("link_ok and content_ok").count() == repaired.count() == 402
    assert [r.status for r in found.collect()] == ["repairable"] * 2 and seen.value == 400


def test_a_chain_goes_on_from_batch_to_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(c, i, f"{c}{i}", "f" * 64) for c in ("a", "b", None) for i in range(20)], "c string, seq long, content string, start string")
        for start, first in ((None, chain.GENESIS), ("start", "f" * 64)):
            got = {(r.c, r.seq): r for r in chain.relink(rows, chain="c", start=start).collect()}
            assert len(got) == 60 and all(got[c, 0].previous_hash == first for c in ("a", "b", None))
            assert all(got[c, i].previous_hash == got[c, i - 1].row_hash for c in ("a", "b", None) for i in range(1, 20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_of_blocks_equals_brute_force(monkeypatch):
    """Many ties, steps that don't divide the blocks, several parts of which a row meets some, and a floor."""
    monkeypatch.setattr(neighbours, "STEP", (7, 10))
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 6, 20).astype(float), rng.integers(0, 6, 95).astype(float)
    for bounds in ([0, 95], [0, 1, 40, 95]):
        ids = np.concatenate([np.sort(part) for part in np.split(rng.permutation(95), bounds[1:-1])])
        parts = [(np.flatnonzero(rng.uniform(size=20) < 0.8) if len(bounds) > 2 else np.arange(20), a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
        for floor in (None, 1.0):
            q, j, value = neighbours._nearest(x, y, ids, parts, 4, lambda a, b: np.abs(a[:, None] - b[None, :]), floor)
            got = [(int(a), float(v), int(ids[b])) for a, b, v in zip(q, j, value, strict=True)]
            want = []
            for a in range(20):
                met = [(float(abs(x[a] - y[b])), int(ids[b])) for rows, i, k in parts if a in rows for b in range(i, k)]
                want += [(a, v, i) for v, i in sorted(m for m in met if floor is None or m[0] <= floor)[:4]]
            assert got == want


def test_a_vector_goes_to_a_group_of_regions_once(spark, monkeypatch):
    """Uniform vectors rule no region out: each is sent to the few groups of regions, not to every region."""
    sent, plain = [], neighbours.durable
    monkeypatch.setattr(neighbours, "REGION_ROWS", 25)

    def durable(df):
        out = plain(df)
        if {"q", "region"} <= set(df.columns):
            sent.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "durable", durable)
    x = np.random.default_rng(13).normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, value array<double>")
    got = {(r.query, r["rank"]): r.candidate for r in neighbours.cosine_top_k(df, df, 3, -1.0).collect()}
    product = x @ x.T - 9 * np.eye(400)
    assert got == {(q, n + 1): int(i) for q in range(400) for n, i in enumerate(np.argsort(-product[q])[:3])}
    assert len(sent) == 2 and max(sent) <= 2 * 400  # 16 regions, one group; two of 256 rows at most
