"""What an analysis of cases must not repeat with every file: reads of bytes, parses of payloads, pairs far apart; and that results stay."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from evidara import schema
from evidara.functions import hashing
from evidara.media import containers
from evidara.operators import casework, chain, intake, neighbours
from evidara.sources.commits import Store

NOW = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def _files(spark, ids):
    rows = [(i, "case-" + i[0], f"p{i}", i, f"{ord(i[-1]) % 7:064d}", 3, "image/png", "image", None, None, None) for i in ids]
    return spark.createDataFrame(rows, "id string, case_id string, path string, filename string, sha256 string, length long, mime string, media_type string, phash string, dhash string, ahash string")


def test_files_are_made_once_and_chains_go_on(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    store = Store(spark, str(tmp_path / "store"))
    for number, ids in enumerate((["a1", "a2", "b1", "a9"], ["a3", "b2", "c1"])):
        files = _files(spark, ids)
        intake.take_in(store, files.mapInArrow(counted, files.schema), f"batch-{number}", "tester", NOW)
    assert seen.value == 7
    log = intake.content_of(store.read("audit_log", schema.AUDIT))
    assert chain.link_check(log, chain="case_id").filter("not (link_ok and content_ok)").isEmpty()
    places = {r.case_id: r.s for r in log.groupBy("case_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect()}
    assert places == {c: list(range(1, n + 1)) for c, n in {"case-a": 7, "case-b": 4, "case-c": 2}.items()}  # a9 has the bytes of a2: one row
    assert log.filter("audit_id <> concat_ws('-', case_id, seq)").isEmpty()


def test_a_payload_is_parsed_once(spark):
    items = spark.createDataFrame([("x", "image", None)], "id string, media_type string, phash string")
    results = spark.createDataFrame([("x", "metadata", "OK", None, '{"status":"OK","camera":true,"captured":true}')], "evidence_id string, kind string, status string, score double, payload string")
    matches = spark.createDataFrame([], "query_id string, same_bytes boolean, distance int")
    found = casework.signals_of(items, results, matches)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= len(casework.PAYLOADS)
    assert {r.signal_id: r.score for r in found.collect()}["metadata_integrity"] == 0.25


def test_only_a_manifest_has_declared_details(spark):
    plain, signed = b'"claim_generator": "maker" c2pa.created', b'jumb c2pa "claim_generator": "maker" c2pa.created'
    files = spark.createDataFrame([("plain", bytearray(plain)), ("signed", bytearray(signed)), ("gone", None)], "path string, content binary")
    read = {r.path: r for r in casework.facts(files).collect()}
    want = files.filter("path = 'signed'").select(containers.declared_details(F.col("content")).alias("d")).first().d
    assert read["signed"].has_manifest and read["signed"].declared == want and want.generator == "maker"
    assert read["plain"].declared is None and read["gone"].declared is None and read["gone"].recomputed is None


def test_searches_within_a_distance_equal_brute_force(spark):
    """At the limit, over it, with ties and copies; the grid keeps no pair over it."""
    rng = np.random.default_rng(21)
    values = []
    for base in rng.integers(-(2**62), 2**62, 30):
        for bits in (0, 0, 3, 11, 12, 13, 20):
            mask = sum(1 << int(b) for b in rng.choice(63, bits, replace=False))
            values.append(int(base) ^ mask)
    x = np.array(values, np.int64).view(np.uint64)
    d = np.bitwise_count(x[:, None] ^ x[None, :]).astype(int)
    df = spark.createDataFrame(list(enumerate(values)), "id long, value long")
    got = {(r.query, r["rank"]): (r.candidate, r.distance) for r in neighbours.hamming_top_k(df, df, 5, most=12).collect()}
    want = {}
    for q in range(len(values)):
        near = sorted((d[q, c], c) for c in range(len(values)) if c != q and d[q, c] <= 12)[:5]
        want |= {(q, n + 1): (c, v) for n, (v, c) in enumerate(near)}
    assert got == want and 12 in {v for _, v in want.values()}
    for bounds in ([(0, 40)], [(0, 15), (15, 40)]):  # one part meets in order of ids, several don't
        ids, y = np.arange(40), x[:40]
        _, _, v = neighbours._nearest(x[:20], y, ids, [(np.arange(20), a, b) for a, b in bounds], 40, lambda a, b: np.bitwise_count(a[:, None] ^ b[None, :]), 12)
        assert len(v) == (d[:20, :40] <= 12).sum() and v.max() == 12


def test_a_second_hash_still_brings_in_what_is_far_by_the_first(spark):
    far, near = "00000000000fffff", "0000000000000001"  # 20 and 1 bits from 0
    rows = [("a", "s1", "0" * 16, "0" * 16, None), ("b", "s2", far, "0" * 16, None), ("c", "s3", near, None, None)]
    df = spark.createDataFrame(rows, "id string, sha256 string, phash string, dhash string, ahash string")
    got = {(r.query_id, r.candidate_id): r.distance for r in casework.search(df, df, 3).collect()}
    assert got == {("a", "b"): 0, ("b", "a"): 0, ("a", "c"): 1, ("c", "a"): 1}
    alone = df.withColumn("dhash", F.lit(None).cast("string"))
    assert {(r.query_id, r.candidate_id) for r in casework.search(alone, alone, 3).collect()} == {("a", "c"), ("c", "a")}


def test_mean_hash_equals_its_definition(spark):
    x = np.random.default_rng(22).normal(size=(50, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").union(spark.createDataFrame([(50, None)], "id long, v array<float>"))
    found = df.select("id", hashing.mean_hash(F.col("v")).alias("h"))
    got = {r.id: r.h for r in found.collect()}
    for i, v in enumerate(x):
        mean = sum(float(a) for a in v) / 64
        assert got[i] == int(np.array(int("".join("1" if float(a) > mean else "0" for a in v), 2), np.uint64).view(np.int64))
    assert got[50] is None
