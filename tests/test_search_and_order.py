"""Exact search, grouped quantiles, positions in lineages and joins with hot keys, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.operators import chain, evaluation, latest, lineage, neighbours, quantiles, skew, windows

bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")


def nearest_plainly(rows, queries, k, score):
    out = set()
    for q, x in queries:
        if x is not None:
            best = sorted((score(x, y), i) for i, y in rows if y is not None and i != q)[:k]
            out |= {(q, i, n + 1, s) for n, (s, i) in enumerate(best)}
    return out


def clustered(rng, families, size, spread):
    out = []
    for _ in range(families):
        centre = int(rng.integers(-(2**63), 2**63 - 1))
        for _ in range(size):
            value = centre
            for b in rng.integers(0, 63, rng.integers(0, spread + 1)):
                value ^= 1 << int(b)
            out.append(value)
    return out


@pytest.mark.parametrize("bucket", [2048, 20])
def test_hamming_top_k_in_clusters_equals_brute_force(spark, monkeypatch, bucket):
    """Families of near hashes, copies of one another and strays; a bucket's limit that many values go over."""
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(4)
    values = clustered(rng, 12, 8, 2) + [7] * 40 + [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 15)] + [None]
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "id long, value long")
    got = {(r.query, r.candidate, r["rank"], r.distance) for r in neighbours.hamming_top_k(df, df, 4).collect()}
    assert got == nearest_plainly(rows, rows, 4, bits)
    few = df.filter("id % 20 = 0")
    got = {(r.query, r.candidate, r["rank"], r.distance) for r in neighbours.hamming_top_k(df, few, 3).collect()}
    assert got == nearest_plainly(rows, [r for r in rows if r[0] % 20 == 0], 3, bits)
    assert neighbours.hamming_top_k(df.limit(0), df, 3).count() == 0 and neighbours.hamming_top_k(df, df.limit(0), 3).count() == 0


def test_hamming_top_k_compares_few_pairs_in_clusters(spark):
    rng = np.random.default_rng(5)
    values = clustered(rng, 60, 20, 2)
    df = spark.createDataFrame(list(enumerate(values)), "id long, value long")
    stats = {}
    got = neighbours.hamming_top_k(df, df, 5, stats=stats)
    assert {(r.query, r.candidate, r["rank"], r.distance) for r in got.collect()} == nearest_plainly(list(enumerate(values)), list(enumerate(values)), 5, bits)
    assert stats["pairs"] < 0.1 * len(values) ** 2


@pytest.mark.parametrize(("pivots", "floor"), [(1, -1.0), (8, 0.2), (8, -1.0)])
def test_cosine_top_k_equals_brute_force(spark, monkeypatch, pivots, floor):
    monkeypatch.setattr(neighbours, "REGION_ROWS", 300 // pivots)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 16))
    x = np.repeat(centres, 30, axis=0) + 0.1 * rng.normal(size=(300, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[200:212] = x[200]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, value array<float>")
    stats = {}
    got = sorted((r.query, r["rank"], r.candidate, r.similarity) for r in neighbours.cosine_top_k(df, df, 3, floor, stats).collect())
    product = x.astype(float) @ x.astype(float).T
    want = []
    for q in range(300):
        order = sorted((-round(product[q, i], 12), i) for i in range(300) if i != q and product[q, i] >= floor)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    want.sort()
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    if pivots > 1:
        assert stats["pairs"] < 0.5 * 300**2


def test_grouped_quantiles_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    groups = {"even": rng.normal(size=501), "wide": 10.0 ** rng.uniform(-200, 200, 400) * rng.choice([-1, 1], 400), "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 100), "one": np.array([3.25]), "zero": np.zeros(7), "far": np.array([-np.inf, -1.0, 0.0, 1e-320, np.inf]), None: rng.normal(size=30)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.0, "mid": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    for limit in (100_000, 0):  # bins broadcast, and joined
        monkeypatch.setattr(quantiles, "BROADCAST_ROWS", limit)
        got = {r.k: r for r in quantiles.grouped_quantiles(df, ["k"], "v", wanted).collect()}
        assert set(got) == set(groups)
        for k, values in groups.items():
            for name, p in wanted.items():
                at = p * (len(values) - 1)
                low, high = sorted(values)[math.floor(at)], sorted(values)[math.ceil(at)]
                want = low if low == high else low + (at - math.floor(at)) * (high - low)
                assert got[k][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, name)
    whole = quantiles.grouped_quantiles(df.filter("k = 'even'"), [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [np.median(groups["even"])]
    assert quantiles.grouped_quantiles(df.limit(0), ["k"], "v", wanted).count() == 0
    nan = quantiles.grouped_quantiles(spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double"), [], "v", {"m": 0.5, "top": 1.0}).first()
    assert nan.m == 2.0 and math.isnan(nan.top)


def test_no_task_gets_a_key_of_a_quantile(spark):
    """One key with all rows: the most rows that any step but the first scan hands on is far below their number."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.rand(3) * 1000).alias("v"))
    seen = df.withColumn("b", quantiles._bin(F.col("v"))).withColumn("p", quantiles._part(F.col("v"))).groupBy("k", "b", "p").count().agg(F.max("count"), F.count("count")).first()
    assert seen[0] < 2000 and seen[1] > 10_000
    assert quantiles.grouped_quantiles(df, ["k"], "v", {"m": 0.5}).first().m == pytest.approx(df.agg(F.median("v")).first()[0])


def test_residual_outliers_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 400)
    y = 2 * x + 1 + rng.normal(0, 0.1, 400)
    y[:9] += 5
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("b", 1.0, 1.0), ("b", 2.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in windows.residual_outliers(df, "k", "x", "y").collect()}
    slope, intercept = np.polyfit(x, y, 1)
    r = y - slope * x - intercept
    off = np.abs(r - np.median(r))
    mad = np.median(off)
    assert got["a"].mad == pytest.approx(mad) and got["a"].p99 == pytest.approx(np.percentile(np.abs(r), 99))
    assert got["a"].n_outliers == int((0.6745 * off / mad > 3.5).sum()) and got["b"].n_outliers == 0
    row = evaluation.latency(df.filter("k = 'a'"), "y").first()
    assert row.median == pytest.approx(np.median(y)) and row.p95 == pytest.approx(np.percentile(y, 95))


def test_positions_by_pointer_doubling(spark, monkeypatch):
    """A chain of 10,000 in at most 15 rounds, trees, cycles, a parent that isn't there and repeated ids."""
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew, "SALTS", 4)
    calls = []
    from evidara.sources import tables

    plain = tables.durable
    monkeypatch.setattr(tables, "durable", lambda df: calls.append(1) or plain(df))
    chain_ = [(i, i - 1 if i else None) for i in range(10_000)]
    got = {r.id: (r.root, r.depth, r.on_cycle) for r in lineage.positions(spark.createDataFrame(chain_, "id long, parent_id long")).collect()}
    assert got == {i: (0, i, False) for i in range(10_000)} and (len(calls) - 2) / 2 <= 15
    star = [(1, None), (2, 1)] + [(100 + i, 2) for i in range(300)]  # very many share an inner node
    more = [(10, 11), (11, 12), (12, 10), (13, 12), (14, 14), (20, 99), (21, 20), (21, 20), (30, None), (None, 3)]
    got = {r.id: (r.root, r.depth, r.on_cycle) for r in lineage.positions(spark.createDataFrame(star + more, "id long, parent_id long")).collect()}
    want = {1: (1, 0, False), 2: (1, 1, False), 20: (99, 1, False), 21: (99, 2, False), 30: (30, 0, False)} | {100 + i: (1, 2, False) for i in range(300)} | {i: (None, None, True) for i in (10, 11, 12, 13, 14)}
    assert got == want
    assert lineage.positions(spark.createDataFrame([], "id long, parent_id long")).count() == 0


def test_salted_join_deals_a_hot_key_out(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    right = left.groupBy("k").agg(F.count("id").alias("n"))
    joined = skew.salted_join(left, right, ["k"], F.col("id"))
    assert joined.count() == 9000 and joined.filter("k = 'hot'").agg(F.min("n"), F.max("n")).first()[:] == (3000, 3000)
    assert skew.salted_join(left, right.filter("n > 1"), ["k"], F.col("id"), "left_semi").count() == 3000
    assert skew.salted_join(left, right.filter("n > 1"), ["k"], F.col("id"), "left").count() == 9000


def test_forks_and_ties_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    log = spark.createDataFrame([(i, "same" if i % 3 else f"h{i}") for i in range(300)], "seq long, previous_hash string")
    assert sorted((r.seq, r.n_siblings) for r in chain.forks(log).collect()) == [(i, 200) for i in range(300) if i % 3]
    rows = spark.createDataFrame([(1, i, "2024-01-01" if i < 200 else "2024-01-02", 5 if i == 7 else None) for i in range(300)] + [(2, 9, None, 1)], "g long, i long, ts string, gen int").withColumn("ts", F.to_timestamp("ts"))
    got = latest.earliest_with_ties(rows, "g", "ts", "gen", "i").collect()
    assert sorted(r.i for r in got) == list(range(200)) and {(r.g, r.earliest, r.n_tied, r.is_tied) for r in got} == {(1, 7, 200, True)}


def test_equal_error_rate_by_group(spark):
    rng = np.random.default_rng(9)
    rows = [(g, int(v), float(s)) for g in "ab" for v, s in zip(rng.integers(0, 2, 200), rng.uniform(size=200), strict=True)] + [("c", 1, 0.5), ("c", 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r.g: r for r in evaluation.eer(df, by="g").collect()}
    for g in "ab":
        one = evaluation.eer(df.filter(F.col("g") == g)).first()
        assert (got[g].eer_gap, got[g].eer) == (one.eer_gap, one.eer)
    assert got["c"].eer_gap is None and got["c"].eer is None


def test_report_of_metrics(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("a", None)], "name string, value double")
    evaluation.report(df, str(tmp_path / "r"), "Benchmark")
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2
    lines = [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()]
    assert lines == ["# Benchmark", "", "| name | value |", "| --- | --- |", "| a |  |", "| b | 0.5 |"]
