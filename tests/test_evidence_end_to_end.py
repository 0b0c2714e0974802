"""From files to a stored verdict: intake, analysis, reads; and the state that streams keep."""

import datetime
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara import schema
from evidara.functions import nested
from evidara.media import containers, hashes, pixels, profiles
from evidara.operators import casework, chain, intake
from evidara.sources import readers
from evidara.sources.commits import Store
from evidara.streaming import ingest, keyed
from tests.test_sources_media_streaming import exif_jpeg, png, scene

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5, tzinfo=datetime.UTC)


def put(folder, name, pixels_, level=6):
    data = png(pixels_)
    if level != 6:  # the same picture in other bytes
        at = data.index(b"IDAT")
        (size,) = struct.unpack(">I", data[at - 4 : at])
        body = zlib.compress(zlib.decompress(data[at + 4 : at + 4 + size]), level)
        data = data[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + data[at + 8 + size :]
    (folder / f"{name}.png").write_bytes(data)


def with_ids(spark, folder, case_of):
    """Files of a folder as intake wants them: the name's stem is the id."""
    files = readers.media_files(spark, str(folder))
    hashed = hashes.hashed_images(spark, str(folder)).select(F.regexp_replace("origin", "^file:/+", "file:/").alias("path"), "phash", "dhash", "ahash")
    rows = files.join(hashed, "path", "left").withColumn("id", F.regexp_extract("path", "([^/]+)[.][a-z]+$", 1))
    cases = F.create_map(*[F.lit(x) for pair in case_of.items() for x in pair])
    return rows.withColumn("case_id", F.try_element_at(cases, F.col("id")))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """A: the original; B: brighter, the case's item; C: cropped; D: other bytes, same picture; E: another picture; X: no picture."""
    folder = tmp_path_factory.mktemp("corpus")
    base = scene(256, 320)
    put(folder, "A", base)
    put(folder, "B", np.clip(base.astype(int) + 6, 0, 255).astype(np.uint8))
    put(folder, "C", base[4:252, 5:315])
    put(folder, "D", base, level=1)
    put(folder, "E", scene(256, 320, True))
    (folder / "X.bin").write_bytes(b"not a picture at all")
    return folder


CASES = {"A": "corpus", "C": "corpus", "D": "corpus", "E": "corpus", "B": "case-b", "X": "case-b"}


@pytest.fixture(scope="module")
def taken(spark, corpus, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    files = with_ids(spark, corpus, CASES)
    assert intake.take_in(store, files, "batch-1", "tester", NOW) == 1
    return store, files


def test_intake_is_one_commit_with_linked_audit_rows(spark, taken):
    store, files = taken
    evidence, log = store.read("evidence", schema.EVIDENCE), store.read("audit_log", schema.AUDIT)
    assert {r.id: r.case_id for r in evidence.collect()} == {k: v for k, v in CASES.items() if k != "X"}
    assert all(r.phash and r.sha256 and r.media_type == "image" for r in evidence.collect())
    told = {(r.case_id, r.event, json.loads(r.details).get("id") or json.loads(r.details).get("filename")) for r in log.collect()}
    assert told == {(CASES[i], e, i) for i in "ABCDE" for e in (intake.INGESTED, intake.HASHED, intake.PERCEPTUAL)} | {("case-b", intake.REFUSED, "X.bin")}
    checked = chain.link_check(intake.content_of(log), chain="case_id").collect()
    assert len(checked) == 16 and all(r.content_ok and r.link_ok for r in checked)
    # the same batch again, and the same files as another batch
    assert intake.take_in(store, files, "batch-1", "tester", NOW) == 1 and store.read("evidence", schema.EVIDENCE).count() == 5
    assert intake.take_in(store, files, "batch-2", "tester", NOW) == 2 and store.read("evidence", schema.EVIDENCE).count() == 5
    log = store.read("audit_log", schema.AUDIT)
    again = [json.loads(r.details) for r in log.filter(F.col("event") == intake.DUPLICATE).collect()]
    assert sorted(r["existing_id"] for r in again) == list("ABCDE")
    checked = chain.link_check(intake.content_of(log), chain="case_id").collect()
    assert len(checked) == 22 and all(r.content_ok and r.link_ok for r in checked)


def test_intake_tells_duplicates_by_scope(spark):
    files = spark.createDataFrame([("1", "c", "p1", "s", "image"), ("2", "c", "p2", "s", "image"), ("3", "d", "p3", "s", "image"), ("4", "c", "p0", "s", None), ("5", None, "p5", "t", "image"), ("6", None, "p6", "t", "image"), ("7", "c", "p7", "old", "image")], "id string, case_id string, path string, sha256 string, media_type string")
    stored = spark.createDataFrame([("o", "c", "old"), ("o2", "x", "s")], "id string, case_id string, sha256 string")
    outcome = lambda scope: {r.id: (r.outcome, r.existing_id) for r in intake.judged(files, stored, scope).collect()}
    assert outcome(["case_id"]) == {"1": ("ACCEPTED", None), "2": ("DUPLICATE", "1"), "3": ("ACCEPTED", None), "4": ("REFUSED", None), "5": ("ACCEPTED", None), "6": ("DUPLICATE", "5"), "7": ("DUPLICATE", "o")}
    assert outcome([])["1"] == ("DUPLICATE", "o2") and outcome([])["3"] == ("DUPLICATE", "o2")


def test_commits_are_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.commits() == [] and store.read("a", "x long").count() == 0
    store.write("t1", {"a": spark.range(3).toDF("x")})  # killed before the second table and the commit
    assert store.read("a", "x long").count() == 0
    assert store.commit("t1", {"a": spark.range(5).toDF("x"), "b": spark.range(2).toDF("y")}) == 1
    assert store.commit("t1", {"a": spark.range(9).toDF("x")}) == 1 and store.read("a", "x long").count() == 5  # done already
    assert not store._publish(1, "{}")  # another writer took the number
    assert store.commit("t2", {"b": spark.range(4).toDF("y")}) == 2 and store.read("b", "y long, z string").count() == 6
    store.write("t3", {"a": spark.range(1).toDF("x")})
    assert store.expire(keep={"t3"}) == 0 and store.expire(set()) == 1 and store.read("a", "x long").count() == 5


def test_case_is_analysed_end_to_end(spark, taken, corpus):
    store, _ = taken
    files, decoded = readers.media_files(spark, str(corpus)).select("path", "content"), pixels.images(spark, str(corpus))
    cases = spark.createDataFrame([("case-b",)], "case_id string")
    assert casework.verdicts(store, "case-b").first().pending
    n = casework.analyse(store, cases, files, decoded, "run-1", "tester", NOW)
    results = store.read("analysis_results", schema.ANALYSIS)
    assert {(r.evidence_id, r.kind) for r in results.collect()} == {("B", k) for k in casework.KINDS}
    by = {r.kind: r for r in results.collect()}
    assert by["detector"].status == "UNAVAILABLE" and by["provenance"].status == "OK" and json.loads(by["provenance"].payload)["state"] == "ABSENT"
    assert by["forensics"].status == "OK" and 0 <= by["forensics"].score <= 0.6
    # the demo's invariants: A, C and D are found, neither itself nor E; A is the earliest known instance
    found = casework.matches_of(store, "case-b").collect()
    assert {r.candidate_evidence_id for r in found} == {"A", "C", "D"} and all(r.method.startswith("Multi-hash verified (pHash dist") for r in found)
    assert sorted(r["rank"] for r in found) == [1, 2, 3]
    verdict = casework.verdicts(store, "case-b").collect()
    assert [(r.evidence_id, r.verdict, r.pending, r.leading) for r in verdict] == [("B", "INSUFFICIENT_EVIDENCE", False, True)]  # no detector decides
    told = [r.event for r in store.read("audit_log", schema.AUDIT).filter("case_id = 'case-b'").orderBy("seq").collect()]
    assert told[-1] == "ANALYSIS_COMPLETED" and set(casework.EVENTS.values()) <= set(told)
    log = intake.content_of(store.read("audit_log", schema.AUDIT))
    assert all(r.content_ok and r.link_ok for r in chain.link_check(log, chain="case_id").collect())
    # again: no stage runs anew but what was asked for
    assert casework.analyse(store, cases, files, decoded, "run-1", "tester", NOW) == n
    later = NOW + datetime.timedelta(hours=1)
    casework.analyse(store, cases, files, decoded, "run-2", "tester", later)
    assert store.read("analysis_results", schema.ANALYSIS).count() == 5
    detections = spark.createDataFrame([("B", 0.9, "OK", False)], "evidence_id string, score double, status string, abstained boolean")
    casework.analyse(store, cases, files, decoded, "run-3", "tester", later, detections, refresh=True)
    assert [(r.verdict, round(r.score, 6)) for r in casework.verdicts(store, "case-b").collect()] == [("MANIPULATED", 0.9)]
    assert store.read("analysis_results", schema.ANALYSIS).count() == 10


def test_spread_of_a_case_names_the_earliest_instance(spark, taken, corpus, tmp_path):
    store, _ = taken
    when = {"A": "2024-01-01", "C": "2024-02-01", "D": "2024-03-01", "E": "2023-01-01", "B": "2025-01-01"}
    dated = store.read("evidence", schema.EVIDENCE).drop("observed_at").join(spark.createDataFrame(list(when.items()), "id string, t string").select("id", F.to_timestamp("t").alias("observed_at")), "id")
    other = Store(spark, str(tmp_path / "dated"))
    other.commit("all", {"evidence": dated.select(*[c.split()[0] for c in schema.EVIDENCE.split(", ")])})
    cases = spark.createDataFrame([("case-b",)], "case_id string")
    casework.analyse(other, cases, readers.media_files(spark, str(corpus)).select("path", "content"), pixels.images(spark, str(corpus)), "r", "tester", NOW)
    row = casework.spread(other, "case-b").first()
    assert row.earliest == "A" and row.status == "TRACED" and row.n_nodes == 4 and row.n_edges >= 3 and not row.truncated


def test_changed_bytes_are_refused_and_told(spark, taken, corpus, tmp_path):
    store, _ = taken
    cases = spark.createDataFrame([("corpus",)], "case_id string")
    files = readers.media_files(spark, str(corpus)).select("path", "content").filter("path not like '%/E.png'")
    changed = files.withColumn("content", F.when(F.col("path").endswith("/D.png"), F.unhex(F.lit("00"))).otherwise(F.col("content")))
    casework.analyse(store, cases, changed, pixels.images(spark, str(corpus)), "run-9", "tester", NOW)
    results = store.read("analysis_results", schema.ANALYSIS).filter("case_id = 'corpus'")
    assert {r.evidence_id for r in results.collect()} == {"A", "C", "E"}
    assert {r.status for r in results.filter("evidence_id = 'E' and kind in ('metadata', 'provenance')").collect()} == {"ERROR"}  # the file is gone
    no = [json.loads(r.details) for r in store.read("audit_log", schema.AUDIT).filter("event = 'ANALYSIS_REFUSED'").collect()]
    assert [r["path"] for r in no] == ["D"] and no[0]["recorded_sha256"] != no[0]["recomputed_sha256"]


XMP = b"""<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
<rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/" xmlns:stEvt="http://ns.adobe.com/xap/1.0/sType/ResourceEvent#" xmp:CreatorTool="EditorX 2.0" xmpMM:DocumentID="doc:1">
<xmp:ModifyDate>2024-05-06T07:08:09Z</xmp:ModifyDate><xmpMM:History><rdf:Seq><rdf:li rdf:parseType="Resource"><stEvt:action>created</stEvt:action><stEvt:softwareAgent>EditorX</stEvt:softwareAgent></rdf:li><rdf:li stEvt:action="saved"/></rdf:Seq></xmpMM:History>
</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>"""


def icc_profile():
    text = b"Test RGB\0"
    desc = b"desc\0\0\0\0" + struct.pack(">I", len(text)) + text
    head = struct.pack(">I4s", 0, b"test") + bytes([4, 0x30, 0, 0]) + b"mntrRGB XYZ " + b"\0" * 12 + b"acsp" + b"\0" * 88
    table = struct.pack(">I4sII", 1, b"desc", 144, len(desc))
    return head + table + desc


def containers_of(xmp, icc):
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    cut = len(icc) // 2
    jpeg = b"\xff\xd8" + seg(0xE1, profiles.XMP_JPEG + xmp) + seg(0xE2, profiles.ICC_JPEG + b"\2\2" + icc[cut:]) + seg(0xE2, profiles.ICC_JPEG + b"\1\2" + icc[:cut]) + b"\xff\xda\0\2"
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png_ = lambda packed: profiles.PNG_HEAD + chunk(b"iCCP", b"name\0\0" + zlib.compress(icc)) + chunk(b"iTXt", profiles.XMP_PNG + b"\0" + (b"\1\0\0\0" + zlib.compress(xmp) if packed else b"\0\0\0\0" + xmp)) + chunk(b"IEND", b"")

    def tiff(order):
        entries = [(profiles.XMP_TAG, 1, xmp), (profiles.ICC_TAG, 7, icc)]
        at, body, out = 8 + 2 + 12 * len(entries) + 4, b"", b""
        for tag, kind, data in entries:
            out += struct.pack(order + "HHII", tag, kind, len(data), at + len(body))
            body += data
        return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries)) + out + struct.pack(order + "I", 0) + body

    return {"jpeg": jpeg, "png": png_(False), "png packed": png_(True), "tiff little": tiff("<"), "tiff big": tiff(">")}


def test_xmp_and_icc_in_every_container(spark):
    rows = [(k, bytearray(v)) for k, v in containers_of(XMP, icc_profile()).items()]
    rows += [("plain", bytearray(exif_jpeg())), ("cut", bytearray(containers_of(XMP, icc_profile())["tiff big"][:40])), ("none", None), ("bomb", bytearray(containers_of(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>', b"")["jpeg"])), ("broken", bytearray(containers_of(b"<x", b"short")["png"]))]
    got = {r.k: r for r in spark.createDataFrame(rows, "k string, content binary").select("k", profiles.xmp("content").alias("x"), profiles.icc("content").alias("i")).collect()}
    for k in ("jpeg", "png", "png packed", "tiff little", "tiff big"):
        x, i = got[k].x, got[k].i
        assert x.present and (x.creator_tool, x.modify_date, x.document_id, x.history) == ("EditorX 2.0", "2024-05-06T07:08:09Z", "doc:1", ["created by EditorX", "saved"]), k
        assert i.present and (i.version, i.profile_class, i.colour_space, i.description, i.size_bytes) == ("4.3", "mntr", "RGB", "Test RGB", len(icc_profile())), k
    assert not got["plain"].x.present and not got["plain"].i.present and got["none"].x.present is None
    assert got["bomb"].x.present and got["bomb"].x.creator_tool is None and got["broken"].x.creator_tool is None and got["broken"].i.version is None


def test_credentials_follow_the_containers():
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    head = b"\x89PNG\r\n\x1a\n"
    yes = [b"\xff\xd8\xff\xd0\0" + seg(0xEB, b"..c2pa") + b"\xff\xda\0\2", head + chunk(b"caBX", b""), b"x" + containers.CREDENTIALS_UUID, b"jumb c2ma", b"jumb c2pa"]
    no = [b"\xff\xd8" + seg(0xE1, b"c2pa") + b"\xff\xda\0\2", b"\xff\xd8\xff\xda\0\2" + seg(0xEB, b"c2pa"), head + chunk(b"IEND", b"") + chunk(b"caBX", b""), b"jumb", b"c2pa", b""]
    assert all(map(containers.has_credentials, yes)) and not any(map(containers.has_credentials, no))


def dct_plainly(block):
    k = np.arange(8)
    out = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            c = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
            out[u, v] = c * (block * np.cos((2 * k[:, None] + 1) * u * np.pi / 16) * np.cos((2 * k[None, :] + 1) * v * np.pi / 16)).sum()
    return out


def test_recompression_residuals_equal_a_plain_version(spark, corpus):
    luma = hashes.gray(70, 75, 1, np.random.default_rng(3).integers(0, 256, 70 * 75, dtype=np.uint8).tobytes())
    table = pixels.quantisation(90)
    assert table[0, 0] == 3 and pixels.quantisation(50)[0, 0] == 16 and pixels.quantisation(100).max() == 1
    back = pixels.recompressed(luma)
    block = luma[8:16, 16:24] - 128
    held = np.round(dct_plainly(block) / table) * table
    k = np.arange(8)
    basis = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * i + 1) * u * np.pi / 16) for i in k] for u in k])
    assert np.array_equal(back[8:16, 16:24], np.clip(np.round(basis.T @ held @ basis + 128), 0, 255)) and back.shape == luma.shape
    assert np.array_equal(pixels.recompressed(np.full((64, 64), 77.0)), np.full((64, 64), 77.0))
    tiles = pixels.residual_tiles(pixels.images(spark, str(corpus)))
    one = {(r.tile_y, r.tile_x): r for r in tiles.filter("origin like '%/A.png'").collect()}
    plain = hashes.gray(256, 320, 3, np.ascontiguousarray(scene(256, 320)[:, :, ::-1]).tobytes())
    residual, gradient = pixels.residual_and_gradient(plain)
    assert len(one) == 80 and all(np.isclose(one[y, x].residual, residual[y, x]) and np.isclose(one[y, x].gradient, gradient[y, x]) for y, x in one)
    report = {r.origin[-5]: r for r in pixels.residual_report(pixels.images(spark, str(corpus))).collect()}
    assert set(report) == set("ABCDE") and report["A"].n_tiles == 80 and report["A"].p99 is not None
    flat = np.tile(np.repeat([[0.0, 50.0]], 8, axis=1), (64, 5))  # steps at every eighth column
    assert pixels.grid_energies(flat)[0] > 10 * pixels.grid_energies(flat)[1:].max()
    assert pixels.grid_energies(flat[:, 3:])[5] > 10 * np.delete(pixels.grid_energies(flat[:, 3:]), 5).max()
    assert {r.origin[-5] for r in pixels.grid_phases(pixels.images(spark, str(corpus))).collect()} == set("ABCDE")


def test_tensors_and_activations(spark, corpus):
    spec = pixels.Spec(size=(10, 6), mean=(0.5, 0.4, 0.3), std=(0.2, 0.3, 0.4))
    data = np.random.default_rng(5).integers(0, 256, (12, 20, 3), dtype=np.uint8)
    got = pixels.tensor(12, 20, 3, data.tobytes(), spec)
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    want = np.zeros((3, 6, 10))
    for c in range(3):
        plane = data[:, :, 2 - c].astype(float)
        across = level(np.array([[(row * w).sum() for w in pixels._triangle(20, 10)] for row in plane]))
        want[c] = level(np.array([[(across[:, x] * w).sum() for x in range(10)] for w in pixels._triangle(12, 6)]))
    want = (want / 255 - np.array(spec.mean)[:, None, None]) / np.array(spec.std)[:, None, None]
    assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-5)
    flat = pixels.tensor(2, 2, 1, bytes([9, 9, 9, 9]), pixels.Spec(size=(4, 4), mean=(0, 0, 0), std=(1, 1, 1), layout="NHWC"))
    assert flat.shape == (4, 4, 3) and np.allclose(flat, 9 / 255)
    raw = np.array([[1.0, 3.0], [0.0, 0.0]])
    assert np.allclose(pixels.activated(raw, pixels.Spec()), [1 / (1 + np.exp(-2)), 0.5]) and np.allclose(pixels.activated(raw, pixels.Spec(activation="sigmoid")), 1 / (1 + np.exp(-raw[:, 1])))
    assert pixels.activated(raw, pixels.Spec(activation="identity", positive=9)).tolist() == [3.0, 0.0]
    assert np.allclose(pixels.activated(np.array([[2.0], [-1.0]]), pixels.Spec(activation="sigmoid")), 1 / (1 + np.exp([-2.0, 1.0]))) and pixels.activated(np.array([2.0, -1.0]), pixels.Spec()).tolist() == [1.0, 0.0]
    said = pixels.detected(pixels.images(spark, str(corpus)), lambda x: np.stack([x.mean(axis=(1, 2, 3)) * 0, x.mean(axis=(1, 2, 3))], axis=1), pixels.Spec(size=(8, 8)), batch_rows=2)
    assert said.count() == 5 and all(0 <= r.score <= 1 for r in said.collect())
    assert all(r.score is None for r in pixels.detected(pixels.images(spark, str(corpus)), lambda x: np.full((len(x), 2), 7.0), pixels.Spec(size=(8, 8), activation="identity")).collect())


def test_nested_metadata_is_bounded(spark):
    deep = {"a": None}
    for _ in range(60):
        deep = {"d": deep}
    cases = {
        "text": ("\0  x" + "y" * 600, "y"), "bytes": ({"$bytes": "AAEC"}, "000102"), "printable": ({"$bytes": "aGVsbG8A"}, "hello"), "long bytes": ({"$bytes": "QUFB" * 40}, "<120 bytes>"),
        "fraction": ({"$numerator": 1, "$denominator": 4}, 0.25), "over zero": ({"$numerator": 1, "$denominator": 0}, None), "list": ([[i] for i in range(50)], 32), "map": ({str(i): i for i in range(90)}, 64), "deep": (deep, "d"), "flag": ([True, None, 1.5], [True, None, 1.5]),
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("bad", "{"), ("nan", "NaN"), ("null", None)], "k string, j string")
    got = {r.k: r.c for r in df.select("k", nested.cleaned("j").alias("c")).collect()}
    value = {k: json.loads(v) for k, v in got.items() if v is not None}
    assert len(value["text"]) == 512 and value["text"].startswith("xy") and len(value["list"]) == 32 and len(value["map"]) == 64 and "deep" in value
    assert all(value[k] == cases[k][1] for k in ("bytes", "printable", "long bytes", "fraction", "over zero", "flag"))
    assert got["bad"] is None and got["null"] is None and value["nan"] is None
    flat = spark.createDataFrame([("  a \0", None)], "x string, y string").select(nested.cleaned_fields({"x": F.col("x"), "y": F.col("y")}).alias("c")).first().c
    assert flat.y is None and flat.x.strip("\0").strip() == "a"


def test_chains_grow_side_by_side_and_replay(spark, tmp_path):
    source, log, mark = (str(tmp_path / n) for n in ("in", "log", "mark"))
    ddl = "case_id string, seq long, content string"
    batches = [[("a", 2, "y"), ("a", 1, "x"), ("b", 5, "q")], [("a", 3, "z"), ("b", 6, "r"), ("c", 1, None)], [("a", 2, "late"), ("a", 4, "w"), (None, 1, "n"), ("b", None, "no seq")]]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        ingest.append_chain(stream, log, mark, chain="case_id").awaitTermination()
    stored = spark.read.parquet(log)
    assert sorted((r.case_id, r.seq, r.content) for r in stored.collect()) == [("", 1, "n"), ("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("a", 4, "w"), ("b", 5, "q"), ("b", 6, "r"), ("c", 1, "")]
    assert all(r.content_ok and r.link_ok for r in chain.link_check(stored, chain="case_id").collect())
    # a batch whose commit was lost runs again from the same state and gives the same rows
    before = {(r.case_id, r.seq): r.row_hash for r in stored.collect()}
    last = sorted((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    for crc in (tmp_path / "mark" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    ingest.append_chain(spark.readStream.schema(ddl).parquet(source), log, mark, chain="case_id").awaitTermination()
    assert {(r.case_id, r.seq): r.row_hash for r in spark.read.parquet(log).collect()} == before and spark.read.parquet(log).count() == 8


def test_web_cache_forgets_by_time_and_number(spark, tmp_path):
    source = str(tmp_path / "in")
    ddl = "key string, at timestamp, kind string, status string, payload string"
    at = lambda s: datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    batches = [
        [("a", at(0), "REQUEST", None, None), ("a", at(0), "RESULT", "SUCCESS", "A"), ("b", at(1), "RESULT", "ERROR", "no"), ("b", at(2), "REQUEST", None, None), ("a", at(5), "REQUEST", None, None)],
        [("b", at(10), "RESULT", "NO_RESULTS", "B"), ("a", at(11), "REQUEST", None, None), ("c", at(12), "RESULT", "SUCCESS", "C"), ("b", at(13), "REQUEST", None, None), ("a", at(14), "RESULT", "ERROR", "no"), ("a", at(15), "REQUEST", None, None)],
        [("a", at(101), "REQUEST", None, None), ("c", at(108), "REQUEST", None, None)],
        [("z", at(500), "REQUEST", None, None)], [("z", at(501), "REQUEST", None, None)],
    ]
    keyed.use_rocksdb(spark)
    got = []
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = keyed.cached_results(spark.readStream.schema(ddl).parquet(source), "1 second", ttl_seconds=100, most=2)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
    zero = at(0).timestamp()
    got = {(r.key, int(r.at.replace(tzinfo=r.at.tzinfo).timestamp() - zero), r.outcome, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("a", 0, "STORED", "A"), ("b", 1, "NOT_STORED", "no"), ("b", 2, "MISS", None), ("a", 5, "HIT", "A"), ("b", 10, "STORED", "B"), ("a", 11, "HIT", "A")} <= got
    assert ("b", 12, "EVICTED", "B") in got and ("b", 13, "MISS", None) in got and ("c", 12, "STORED", "C") in got  # b was not used for longest
    assert ("a", 14, "NOT_STORED", "no") in got and ("a", 15, "HIT", "A") in got  # a failure doesn't replace a finding
    assert ("a", 101, "MISS", None) in got and any(r[0] == "a" and r[2] == "EXPIRED" for r in got) and ("c", 108, "HIT", "C") in got
    assert any(r[0] == "c" and r[2] == "EXPIRED" for r in got)  # by a timer, without a request
