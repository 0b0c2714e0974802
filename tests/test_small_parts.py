"""Column functions and small operators that no query shows on its own."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from evidara.functions import files, hashing, scores
from evidara.media import containers
from evidara.operators import alerts, casework, fusion, lineage, listing, sessions, web, windows
from evidara.sources import readers, tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hints_and_paths(spark):
    lit = F.lit
    row = one(spark, files.software_hint(lit("Adobe PHOTOSHOP and GIMP"), files.EDITOR_HINTS).alias("a"), files.software_hint(lit("a camera"), files.EDITOR_HINTS).alias("b"), files.software_hint(lit("DALL-E 3"), files.GENERATIVE_HINTS).alias("c"), files.software_hint(lit(None).cast("string"), files.EDITOR_HINTS).alias("d"))
    assert row[:] == ("photoshop", None, "dall-e", None)
    row = one(spark, *[files.under(lit(p), "/root/x/").alias(f"c{i}") for i, p in enumerate(("/root/x/a", "/root/xy/a", "/root/x/../y", "/root/x", "/root/x/a..b"))])
    assert row[:] == (True, False, False, False, True)


def test_quality_of_the_standard_table(spark):
    scaled = lambda s: F.array(*[F.lit(v * s) for v in containers.LUMA])
    row = one(spark, containers.jpeg_quality(scaled(1)).alias("a"), containers.jpeg_quality(scaled(2)).alias("b"), containers.jpeg_quality(F.slice(scaled(1), 1, 63)).alias("c"))
    assert row[:] == (50.0, 1.0, None)


def test_match_basis_says_what_there_is(spark):
    rows = [(True, 0, 0, 1, 2, 0.5), (True, 3, 3, None, None, None), (False, 4, 4, 5, None, 0.876), (None, None, None, None, None, None), (False, None, None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "s boolean, d int, p int, h int, a int, c double")
    got = [r.b for r in df.select(hashing.match_basis(*[F.col(x) for x in "sdphac"]).alias("b")).collect()]
    assert got == ["Exact SHA-256 byte match", "Multi-hash verified (pHash dist 3)", "Multi-hash verified (pHash dist 4, dHash dist 5, embedding sim 0.88)", "Perceptual match", "Multi-hash verified (embedding sim 1.00)"]


def test_forensic_signal(spark):
    rows = [("OK", 0.3), ("OK", None), ("OK", 1.4), ("UNSUPPORTED_MEDIA", None), ("INSUFFICIENT_DATA", 0.2), ("ERROR", None), ("odd", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, v double")
    score, status = fusion.forensics(F.col("s"), F.col("v"))
    assert [(r.x, r.y) for r in df.select(score.alias("x"), status.alias("y")).collect()] == [(0.3, "OK"), (None, "ERROR"), (None, "ERROR"), (None, "UNSUPPORTED_MEDIA"), (None, "INCONCLUSIVE"), (None, "ERROR"), (None, "ERROR"), (None, "UNAVAILABLE")]
    shares = [0.0, 0.05, 0.1, 0.15, 0.45, 0.9]
    got = [one(spark, scores.forensic_score(F.lit(s), F.lit(off)).alias("s")).s for s in shares for off in (False, True)]
    assert got == pytest.approx([0.15, 0.2, 0.15, 0.2, 0.225, 0.275, 0.3, 0.35, 0.6, 0.6, 0.6, 0.6])


def test_scores_of_frames_and_outputs(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    row = one(spark, scores.mean_of_present(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)).alias("m"), scores.mean_of_present(F.lit(None).cast("double")).alias("n"), scores.activation(a(0.0, 1.0), "softmax").alias("s"), scores.activation(a(0.0), "sigmoid").alias("g"), scores.activation(a(3.0), "identity").alias("i"), scores.clean_confidence(F.lit("0.98765")).alias("c"), scores.clean_confidence(F.lit("x")).alias("d"))
    assert (row.m, row.n, row.g, row.i, row.c, row.d) == (1.5, None, [0.5], [3.0], 0.9877, None) and math.isclose(row.s[1], 1 / (1 + math.exp(-1)))
    frames = one(spark, windows.even_frames(F.lit(31)).alias("a"), windows.even_frames(F.lit(3)).alias("b"), windows.even_frames(F.lit(0)).alias("c"))
    assert frames.a == list(range(0, 31, 2)) and frames.b == [0, 1] + [2] * 14 and frames.c is None
    df = spark.createDataFrame([("k", 1, None), ("k", 2, 5.0), ("k", 3, None), ("l", 1, None)], "k string, t int, v double")
    assert [r.v for r in windows.forward_filled(df, "k", "t", "v").orderBy("k", "t").collect()] == [None, 5.0, 5.0, None]


def test_rationale_is_rendered_from_the_state(spark):
    signals = spark.createDataFrame([("a", "image", "ai_detection", 0.9, "OK", "DECISIVE", None)], "evidence_id string, media_type string, signal_id string, score double, status string, role string, execution_status string")
    row = fusion.rationale(fusion.assess(signals)).first()
    assert row.rationale == "State INDICATORS_DETECTED from 1 contributing checks; eligible coverage 1.00; score 0.9000; reasons ABOVE_THRESHOLD"


def test_reads_by_key_and_what_waits(spark):
    df = spark.createDataFrame([("a", "h", True), ("b", "h", False), ("c", None, False), ("d", "h", None)], "id string, phash string, indexed boolean")
    assert [r.id for r in listing.by_key(df, "id", "b").collect()] == ["b"] and listing.by_key(df, "id", "z").count() == 0
    assert sorted(r.id for r in listing.waits_for_index(df).collect()) == ["b", "d"]
    rows = spark.createDataFrame([(1, "INSUFFICIENT_EVIDENCE"), (2, "MANIPULATED"), (3, None)], "item long, verdict string").withColumn("created_at", F.current_timestamp())
    assert [(r.item, r.severity, r.category) for r in alerts.coverage_alerts(rows).collect()] == [(1, "low", "coverage")]


def test_priorities_and_missing_files(spark):
    df = spark.createDataFrame([("HIGH",), ("low",), ("urgent",), (None,)], "p string")
    kept = lambda w: [r.p for r in df.filter(listing.priority_filter("p", w)).collect()]
    assert len(kept(None)) == len(kept("All")) == 4 and kept("high, URGENT") == ["HIGH", "urgent"] and kept("none") == []
    rows = spark.createDataFrame([("x.png", 1), ("y.png", 0), ("z.png", 1)], "file string, label int")
    held = spark.createDataFrame([("x.png", "a/x.png"), ("x.png", "b/x.png"), ("z.png", "a/z.png")], "filename string, path string")
    found, missing = readers.with_files(rows, held)
    assert sorted(r.file for r in found.collect()) == ["x.png", "z.png"] and missing.first().n_missing == 1


def test_search_among_very_many_copies(spark):
    """Of 500 files of the same bytes every one has the smallest other ids as candidates, and no pairs are made within the group."""
    rows = [(f"f{i:03d}", "same" if i < 500 else f"s{i}", f"{(i * 2654435761) % 2**64:016x}" if i >= 500 else "00000000000000ff") for i in range(520)]
    df = spark.createDataFrame(rows, "id string, sha256 string, phash string").withColumn("dhash", F.lit(None).cast("string")).withColumn("ahash", F.lit(None).cast("string"))
    got = {}
    for r in casework.search(df, df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.candidate_id, r.distance, r.method))
    same = [f"f{i:03d}" for i in range(500)]
    for q in same:
        assert [c for _, c, _, _ in sorted(got[q])] == [x for x in same[:4] if x != q][:3] and {d for _, _, d, _ in got[q]} == {0}
    assert sorted(got["f000"])[0][3] == "Exact SHA-256 byte match"


def test_sessions(spark):
    at = lambda h: datetime.datetime(2026, 1, 1, h)
    held = spark.createDataFrame([("good", 1, at(12), None), ("over", 1, at(10), None), ("revoked", 1, at(12), at(9)), ("idle", 2, at(12), None), ("nobody", 3, at(12), None)], "t string, user_id long, expires_at timestamp, revoked_at timestamp")
    held = held.select(F.sha2("t", 256).alias("token_hash"), "user_id", "expires_at", "revoked_at")
    tokens = spark.createDataFrame([(t,) for t in ("good", "over", "revoked", "idle", "nobody", "other", "", None)], "token string")
    users = spark.createDataFrame([(1, True), (2, False)], "user_id long, is_active boolean")
    assert [(r.token, r.user_id) for r in sessions.resolved(tokens, held, users, F.lit(at(10))).collect()] == [("good", 1)]


def test_cache_replay(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [("k", 1, 0, "REQUEST", None), ("k", 2, 0, "RESULT", "SUCCESS"), ("k", 3, 50, "RESULT", "ERROR"), ("k", 4, 100, "REQUEST", None), ("k", 5, 101, "REQUEST", None), ("l", 6, 5, "REQUEST", None)]
    df = spark.createDataFrame([(k, i, at(s), n, v) for k, i, s, n, v in rows], "key string, id long, at timestamp, kind string, status string")
    assert sorted((r.id, r.hit, r.result_id) for r in web.replayed(df, 100).collect()) == [(1, True, 2), (4, True, 2), (5, False, None), (6, False, None)]
    assert {r.id for r in web.replayed(df, 0).filter("hit").collect()} == {1, 4, 5}


def test_manifests_lists_and_vectors(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "d", "manifest_version": 2, "items": [{"evidence_id": "a", "path": "p"}, {"evidence_id": "b", "path": "q"}, {"evidence_id": "a", "path": "p"}]}))
    items = readers.manifest(spark, str(tmp_path / "m.json"))
    known = spark.createDataFrame([("b",)], "evidence_id string")
    assert items.count() == 3 and [r.evidence_id for r in readers.new_items(items, known).collect()] == ["a"] and readers.new_items(items, known, limit=0).count() == 0
    (tmp_path / "l.csv").write_text("x.png,1\ny.png,0\nz.png,7\n")
    assert sorted(map(tuple, readers.labelled_list(spark, str(tmp_path / "l.csv")).collect())) == [("x.png", 1), ("y.png", 0)]
    files_ = spark.createDataFrame([("p", "s", 3), ("q", "t", 4)], "path string, sha256 string, length long")
    want = spark.createDataFrame([("p", "s", 3), ("q", "t", 5), ("r", "u", 1)], "path string, sha256 string, size long")
    assert {r.path: r.ok for r in readers.verified(files_, want).collect()} == {"p": True, "q": False, "r": None}
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [float("nan"), 1.0]), ("e", None), ("f", [1.0, None]), ("g", [float("inf"), 0.0])], "id string, value array<double>")
    assert [(r.id, r.value) for r in tables.rebuilt_vectors(vectors, 2).collect()] == [("a", [0.6, 0.8])]
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 1.0])], "id string, value array<double>")
    add, remove = tables.vector_changes(index, vectors, 2)
    assert [r.id for r in add.collect()] == ["a"] and sorted(r.id for r in remove.collect()) == ["a", "z"]


def test_tables_grow_and_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    tables.append(spark.createDataFrame([("a", 3)], "k string, v int"), path, "k")
    tables.replace_partitions(spark.createDataFrame([("b", 9)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 3), ("b", 9)]


def test_edges_carry_similarity(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1)], "id long, parent_id long")
    matches = spark.createDataFrame([(1, 2, 16), (1, 9, 3)], "query long, candidate long, distance int")
    got = {(r.source, r.target, r.relation, r.similarity, r.verified) for r in lineage.edges(nodes, matches).collect()}
    assert got == {(1, 2, "recorded_parent", None, False), (1, 2, "near_duplicate_candidate", 0.75, True)}


def test_files_are_examined_without_being_stored(spark):
    items = spark.createDataFrame([("x", "nowhere/x.jpg", "image", bytearray(b"\xff\xd8\xff\xda\0\2")), ("y", "nowhere/y.jpg", "image", None)], "id string, stored_path string, media_type string, content binary")
    decoded = spark.createDataFrame([], "origin string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    said = spark.createDataFrame([("x", 0.1, "OK", False)], "evidence_id string, score double, status string, abstained boolean")
    got = {(r.evidence_id, r.kind): r for r in casework.examined(items, decoded, said).collect()}
    assert len(got) == 10 and got["x", "fusion"].verdict == "AUTHENTIC" and got["y", "fusion"].verdict == "INSUFFICIENT_EVIDENCE"
    assert got["y", "metadata"].status == "ERROR" and got["x", "forensics"].status == "ERROR"  # it can't be decoded
