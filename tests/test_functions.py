import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidara.functions import files, hashing, scores
from evidara.operators import neighbours


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_hamming_keeps_missing_and_refuses_widths(spark):
    row = one(
        spark,
        far=hashing.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000000")),
        none=hashing.hamming_hex(F.lit(None).cast("string"), F.lit("0000000000000000")),
        back=hashing.hash_to_hex(hashing.hash_from_hex(F.lit("f0e1d2c3b4a59687"))),
        bad=hashing.hash_from_hex(F.lit("xyz")),
        six=hashing.rounded_similarity(F.lit(6)),
        strong=hashing.band(F.lit(30), F.lit(0.9)),
        effective=hashing.effective_distance(F.lit(False), F.lit(20), F.lit(11), F.lit(None).cast("int")),
        rejected=hashing.effective_distance(F.lit(False), F.lit(20), F.lit(30), F.lit(None).cast("int")),
    )
    assert (row.far, row.none, row.back, row.bad) == (64, None, "f0e1d2c3b4a59687", None)
    assert (row.six, row.strong, row.effective, row.rejected) == (0.9062, "strong", 11, None)
    with pytest.raises(Exception, match="width"):
        spark.range(1).select(hashing.hamming_hex(F.concat(F.lit("f"), F.col("id").cast("string")), F.lit("0000000000000000"))).collect()


def test_scores_are_never_clamped(spark):
    values = [None, float("nan"), float("inf"), -0.1, 1.1, 0.0, 1.0, 0.4]
    rows = spark.createDataFrame([(v,) for v in values], "s double").select(scores.usable(F.col("s")).alias("u")).collect()
    assert [r.u for r in rows] == [None] * 5 + [0.0, 1.0, 0.4]
    row = one(spark, ramp=scores.ramp(F.lit(1.5), [(1, 0.0), (2, 0.4)], 0.6), none=scores.mean_of_present(F.lit(None).cast("double"), F.lit(None).cast("double")), some=scores.mean_of_present(F.lit(0.5), F.lit(None).cast("double")), video=scores.blended_video_score(F.array(F.lit(0.2), F.lit(0.4))))
    assert math.isclose(row.ramp, 0.2) and row.none is None and row.some == 0.5 and math.isclose(row.video, 0.7 * 0.3 + 0.3 * 0.4)


def test_files(spark):
    magic = {b"\xff\xd8\xff\xe0aaaaaaaaaaaa": "image/jpeg", b"\x89PNG\r\n\x1a\nxxxxxxxx": "image/png", b"RIFFxxxxWAVEfmt ": "audio/wav", b"\0\0\0\x18ftypM4A xxxx": "audio/mp4", b"\0\0\0\x18ftypisomxxxx": "video/mp4", b"ID3xxxxxxxxxxxxx": "audio/mpeg", b"plain text bytes": None}
    rows = spark.createDataFrame([(bytearray(k), v) for k, v in magic.items()], "c binary, want string").select(files.sniff(F.col("c"))["mime"].alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    names = spark.createDataFrame([("../a/b\\évil name?.jpg",), ("...",), (None,)], "n string").select(files.safe_filename(F.col("n")).alias("s")).collect()
    assert [r.s for r in names] == ["_vil name_.jpg", "file", "file"]
    row = one(spark, d=files.domain(F.lit("https://WWW.Example.com:8080/x")), plain=files.domain(F.lit("no url")), pub=files.is_public_url(F.lit("http://10.0.0.1/x")), ok=files.is_public_url(F.lit("https://example.org/x")), exif=files.iso_seconds(files.parse_exif(F.lit("2026:01:15 09:30:00"))), seq=files.case_sequence(F.lit("CASE-2026-1042")), c=files.canonical_json(F.lit('{"b": 1, "a": "é"}')))
    assert (row.d, row.plain, row.pub, row.ok, row.exif, row.seq, row.c) == ("example.com:8080", "no url", False, True, "2026-01-15T09:30:00Z", 1042, '{"a":"é","b":1}')


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=12, unique=True), st.integers(0, 2**32))
def test_band_join_equals_naive_join(spark, values, seed):
    import random

    rng = random.Random(seed)
    values += [v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for v in values]
    df = spark.createDataFrame(list(enumerate(values)), "id long, value long")
    got = {(r.a, r.b, r.distance) for r in neighbours.hamming_within(df, df, 12, 7).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(i, j, bits(a, b)) for i, a in enumerate(values) for j, b in enumerate(values) if i != j and bits(a, b) <= 12}


def test_vector_hashes(spark):
    import numpy as np

    v = np.random.default_rng(5).normal(size=64)
    df = spark.createDataFrame([(v.tolist(),)], "v array<float>")
    row = df.select(hashing.mean_hash(F.col("v")).alias("m"), hashing.gradient_hash(F.col("v")).alias("g"), hashing.median_hash(F.col("v")).alias("d"), hashing.dot(hashing.unit(F.col("v")), hashing.unit(F.col("v"))).alias("n")).first()
    x = v.astype(np.float32).astype(float)
    number = lambda bits: int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)
    grid = x.reshape(8, 8)
    assert row.m == number(x > x.mean()) and row.d == number(x > np.median(x)) and row.g == number((grid < np.roll(grid, -1, axis=1)).ravel())
    assert math.isclose(row.n, 1.0)


def test_uuid5_equals_the_standard(spark):
    import uuid

    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = ["", "a", "example.org", "é😀", *map(str, range(20))]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", files.uuid5(space, F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.UUID(space), r.n)) for r in df.collect())
