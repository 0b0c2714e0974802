import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from evidara.media import containers, detectors, hashes
from evidara.operators import chain
from evidara.sources import readers, tables
from evidara.streaming import ingest


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def scene(h, w, flip=False):
    y, x = np.mgrid[0:h, 0:w]
    u, v = (y / h, x / w) if flip else (x / w, y / h)  # flipped: another picture, turned and with other waves
    base = 128 + 60 * np.sin((13 if flip else 7) * u) * np.cos((3 if flip else 5) * v) - 50 * u
    return np.stack([np.clip(base + d, 0, 255) for d in (0, 10, -10)], axis=2).astype(np.uint8)


def test_image_hashes_survive_resizing(spark, tmp_path):
    for name, pixels in (("a", scene(160, 200)), ("b", scene(80, 100)), ("c", scene(160, 200, True))):
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    rows = {r.origin[-5]: r for r in hashes.hashed_images(spark, str(tmp_path)).collect()}
    far = lambda a, b: bin(int(rows[a].phash, 16) ^ int(rows[b].phash, 16)).count("1")
    assert far("a", "b") <= 4 < far("a", "c")
    assert rows["a"].width == 200 and all(len(h) == 16 for h in (rows["a"].dhash, rows["a"].ahash))


def exif_jpeg():
    text = b"EditorX\0"
    ifd = struct.pack("<H", 1) + struct.pack("<HHII", 0x0131, 2, len(text), 26) + struct.pack("<I", 0)
    body = b"Exif\0\0II*\0" + struct.pack("<I", 8) + ifd + text
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


def test_containers(spark):
    mvhd = struct.pack(">I4s", 32, b"mvhd") + struct.pack(">IIIIII", 0, 3850000000, 0, 1000, 5000, 0)
    mp4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8 + len(mvhd), b"moov") + mvhd
    signed = b"\xff\xd8\xff\xeb" + struct.pack(">H", 14) + b"JP..jumbc2pa" + b"\xff\xda\0\2"
    df = spark.createDataFrame([("jpg", bytearray(exif_jpeg())), ("mp4", bytearray(mp4)), ("c2pa", bytearray(signed)), ("cut", bytearray(mp4[:20])), ("none", None)], "k string, content binary")
    got = {r.k: r for r in df.select("k", containers.exif_tags("content").alias("e"), containers.movie_header("content").alias("m"), containers.credentials("content").alias("c")).collect()}
    assert got["jpg"].e.software == "EditorX" and got["jpg"].e.make is None
    assert got["mp4"].m.brand == "isom" and got["mp4"].m.duration_s == 5.0 and got["mp4"].m.created.startswith("2025-")
    assert (got["c2pa"].c, got["jpg"].c, got["none"].c) == (True, False, None)
    row = df.filter("k = 'jpg'").select(containers.declared(F.col("content"), "(Editor.)").alias("d"), containers.jpeg_quality(F.array(F.lit(8), F.lit(11)), [16, 22]).alias("q"), containers.completeness({"a": F.lit("x"), "b": F.lit(None).cast("string")}).alias("c")).first()
    assert row.d == ["EditorX"] and row.q == 100.0 and row.c.missing == ["b"] and row.c.ratio == 0.5


def test_quality_follows_the_scale_and_skips_zeros(spark):
    table = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(containers.jpeg_quality(table(32, 44), [16, 22]).alias("a"), containers.jpeg_quality(table(24, 0), [16, 22]).alias("b"), containers.jpeg_quality(table(16), [16, 22]).alias("c"), containers.jpeg_quality(table(0, 0), [16, 22]).alias("d"), containers.jpeg_quality(table(800, 22, 9), [16, 22]).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (1.0, 25.0, None, None, 1.0)


def test_manifest_details_and_states(spark):
    raw = b'\xff{"claim_generator" : "Tool 2"} c2pa.edited c2pa.created c2pa.edited algorithmicMedia'
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b'"claim_generator_info": [{"x":1,"name":"Other"}]')), ("c", None)], "k string, content binary")
    got = {r.k: r.d for r in df.select("k", containers.declared_details(F.col("content")).alias("d")).collect()}
    assert got["a"].generator == "Tool 2" and got["a"].actions == ["c2pa.created", "c2pa.edited"] and got["a"].generative_types == ["algorithmicMedia"] and got["a"].declares_generative
    assert got["b"].generator == "Other" and got["b"].actions == [] and not got["b"].declares_generative
    facts = spark.createDataFrame([(False, True, True), (True, False, None), (True, True, None), (True, True, True), (True, True, False), (None, None, None)], "r boolean, p boolean, v boolean")
    states = [tuple(x.s) for x in facts.select(containers.provenance_state(F.col("r"), F.col("p"), F.col("v")).alias("s")).collect()]
    assert states == [("ERROR", "ABSENT", False), ("OK", "ABSENT", False), ("OK", "UNVERIFIED", True), ("OK", "VERIFIED", True), ("OK", "INVALID", True), ("ERROR", "ABSENT", False)]


def test_detectors_never_clamp(spark):
    def call(name):
        return {"good": 0.7, "tuple": (0.2, 0.9, {}), "none": None, "big": 1.5, "bool": True}.get(name) if name != "boom" else 1 / 0

    detectors.register("image", call, ("name",))
    df = spark.createDataFrame([("image", n) for n in ("good", "tuple", "none", "big", "bool", "boom")] + [("audio", "good")], "media_type string, name string")
    got = {(r.media_type, r.name): (r.score, r.confidence, r.status) for r in detectors.scored(df).collect()}
    assert got[("image", "good")] == (0.7, None, "OK") and got[("image", "tuple")] == (0.2, 0.9, "OK")
    assert got[("image", "none")][2] == "ABSTAINED" and {got[("image", n)] for n in ("big", "bool", "boom")} == {(None, None, "ERROR")}
    assert got[("audio", "good")] == (None, None, "UNAVAILABLE")


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "d", "manifest_version": 1, "items": [{"evidence_id": "a", "generation": 0}, {"evidence_id": "b", "generation": 1}, {"evidence_id": "a", "generation": 0}]}))
    items = readers.manifest(spark, str(tmp_path / "m.json"))
    assert [r.evidence_id for r in readers.new_items(items, items.filter("evidence_id = 'b'")).collect()] == ["a"]
    (tmp_path / "l.csv").write_text("x.jpg,1\ny.jpg,0\nz.jpg,7\n")
    assert readers.labelled_list(spark, str(tmp_path / "l.csv")).count() == 2
    (tmp_path / "w.json").write_text(json.dumps({"fullMatchingImages": [{"url": "u1"}], "pages_with_matching_images": [{"url": "u2", "page_title": "t"}]}))
    assert {(r.category, r.url, r.title) for r in readers.web_detection(spark, str(tmp_path / "w.json")).collect()} == {("full", "u1", None), ("page", "u2", "t")}
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "a.png").write_bytes(png(scene(8, 8)))
    (tmp_path / "media" / "empty.bin").write_bytes(b"")
    found = readers.media_files(spark, str(tmp_path / "media")).collect()
    assert [(r.mime, r.filename) for r in found] == [("image/png", "a.png")]
    path = str(tmp_path / "index")
    assert tables.load_version(spark, path) is None
    assert (tables.save_version(spark.range(3), path), tables.save_version(spark.range(5), path)) == (1, 2)
    version, rows = tables.load_version(spark, path)
    assert (version, rows.count()) == (2, 5)
    evidence = spark.createDataFrame([("a", "00000000000000ff"), ("b", "bad"), ("c", None)], "id string, phash string")
    add, remove = tables.index_changes(spark.createDataFrame([("z", 1)], "id string, value long"), evidence)
    assert ([r.id for r in add.collect()], [r.id for r in remove.collect()]) == (["a"], ["z"])
    both = tables.replaced(spark.createDataFrame([("q", 1), ("r", 2)], "k string, v int"), spark.createDataFrame([("q", 9)], "k string, v int"), "k")
    assert sorted(map(tuple, both.collect())) == [("q", 9), ("r", 2)]


def test_streams_are_idempotent(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "seq long, sha256 string, content string"
    first = [(1, "a", "x"), (2, "b", "y"), (3, "a", "z")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(source)
    for k, more in enumerate(([], [(4, "b", "w"), (5, "c", "v")])):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.ingest(stream, out, str(tmp_path / "c1")).awaitTermination()
        ingest.append_chain(spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.sha256 for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    stored = spark.read.parquet(log)
    assert stored.count() == 5 and chain.summary(chain.link_check(stored), stored).first().valid
