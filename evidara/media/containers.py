"""Metadata inside files: EXIF tags, ISO media boxes and content credentials."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: EXIF tags by number.  Fixed values.
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "datetime", 0x9003: "datetime_original", 0x9004: "datetime_digitized"}
EXIF_POINTER, EPOCH = 0x8769, datetime.datetime(1904, 1, 1)
#: The uuid of a box with content credentials.  Fixed value.
CREDENTIALS_UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
#: The standard luminance quantisation table.  Fixed values.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
PARENTS = (b"moov", b"trak", b"mdia", b"udta", b"meta")


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and body of each JPEG segment before the pixels; markers without a body and stray bytes are passed over."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            at += 1
        elif marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker == 0xDA:
            return
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            yield marker, data[at + 4 : at + 2 + size]
            at += 2 + max(size, 2)


def exif(data: bytes) -> dict[str, str]:
    body = next((b[6:] for m, b in segments(data) if m == 0xE1 and b[:6] == b"Exif\0\0"), b"")
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    found: dict[str, str] = {}
    queue = [struct.unpack(order + "I", body[4:8])[0]] if order and len(body) >= 8 else []
    seen: set[int] = set()
    while queue:
        at = queue.pop()
        if at in seen or at + 2 > len(body):
            continue
        seen.add(at)
        (n,) = struct.unpack(order + "H", body[at : at + 2])
        for k in range(n):
            entry = body[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count, value = struct.unpack(order + "HHII", entry)
            if tag == EXIF_POINTER:
                queue.append(value)
            elif tag in TAGS and kind == 2:
                raw = body[value : value + count] if count > 4 else entry[8 : 8 + count]
                found[TAGS[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    return found


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Type, body start and end of ISO media boxes, descending into containers."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        body, stop = at + head, min(at + size, end)
        yield kind, body, stop
        if kind in PARENTS:
            yield from boxes(data, body, stop)
        at += size


def movie(data: bytes) -> dict:
    found: dict = {}
    for kind, a, b in boxes(data):
        body = data[a:b]
        if kind == b"ftyp" and len(body) >= 4:
            found["brand"] = body[:4].decode("latin-1")
        elif kind == b"mvhd" and len(body) >= 20:
            wide = body[0] == 1
            if wide and len(body) < 32:
                continue
            created = struct.unpack(">Q" if wide else ">I", body[4:12] if wide else body[4:8])[0]
            scale, length = struct.unpack(">IQ" if wide else ">II", body[20:32] if wide else body[12:20])
            found["created"] = (EPOCH + datetime.timedelta(seconds=created)).isoformat() + "Z" if 0 < created < 1 << 33 else None
            found["duration_s"] = length / scale if scale else None
        elif kind == b"tkhd" and len(body) >= 8:
            w, h = struct.unpack(">II", body[-8:])
            if w and h and "width" not in found:
                found["width"], found["height"] = w >> 16, h >> 16
    return found


def has_credentials(data: bytes) -> bool:
    """Content credentials where the container keeps them: JPEG APP11, PNG caBX, an ISO media uuid box or a jumb box with a label."""
    if data[:2] == b"\xff\xd8":
        return any(m == 0xEB and b"c2pa" in b for m, b in segments(data))
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at, kind = 8, b""
        while at + 8 <= len(data) and kind != b"IEND":
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"caBX":
                return True
            at += 12 + size
        return False
    return CREDENTIALS_UUID in data or (b"jumb" in data and (b"c2pa" in data or b"c2ma" in data))


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    """Missing entries stay None: a column of numbers would turn them into NaN."""
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


@F.pandas_udf(StructType([StructField(n, StringType()) for n in TAGS.values()]))
def exif_tags(content: pd.Series) -> pd.DataFrame:
    return _table([exif(bytes(c)) if c is not None else {} for c in content], list(TAGS.values()))


@F.pandas_udf(StructType([StructField("brand", StringType()), StructField("created", StringType()), StructField("duration_s", DoubleType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def movie_header(content: pd.Series) -> pd.DataFrame:
    return _table([movie(bytes(c)) if c is not None else {} for c in content], ["brand", "created", "duration_s", "width", "height"])


@F.pandas_udf(BooleanType())
def credentials(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else has_credentials(bytes(c)))


def declared(content: Column, pattern: str) -> Column:
    """Sorted distinct matches of the pattern's first group in the bytes read as Latin-1."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(pattern), 1)))


def jpeg_quality(luma: Column, base: tuple[int, ...] = LUMA) -> Column:
    """Estimated quality of a quantisation table from its mean ratio to the standard one, held to 1..100, one digit.

    Entries that are 0 on either side are left out; a table of fewer entries than the standard one gives NULL.
    """
    table = F.slice(luma, 1, len(base))
    ratios = F.filter(F.zip_with(table, F.array(*map(F.lit, base)), lambda a, b: F.when((a != 0) & (b != 0), a.cast("double") / b)), lambda r: r.isNotNull())
    scale = 100 * F.aggregate(ratios, F.lit(0.0), lambda s, r: s + r) / F.size(ratios)
    quality = F.when(scale > 100, (200 - scale) / 2).otherwise(5000 / F.greatest(scale, F.lit(1e-6)))
    return F.when((F.size(luma) >= len(base)) & (F.size(ratios) > 0), F.round(F.greatest(F.lit(1.0), F.least(F.lit(100.0), quality)), 1))


#: Source types that declare synthetic media, what names a generator, and the actions.
GENERATIVE_TYPES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia", "algorithmicallyEnhanced")
GENERATOR = r'"claim_generator"\s*:\s*"([^"]{1,200})"'
GENERATOR_INFO = r'"claim_generator_info"\s*:\s*\[\s*\{[^}]{0,400}?"name"\s*:\s*"([^"]{1,200})"'
ACTION = r"(c2pa\.(?:created|edited|placed|opened|converted|published))"


def declared_details(content: Column) -> Column:
    """struct<generator, actions, generative_types, declares_generative> that a manifest says of itself, unverified."""
    text = F.decode(content, "ISO-8859-1")
    found = F.coalesce(F.nullif(F.regexp_extract(text, GENERATOR, 1), F.lit("")), F.nullif(F.regexp_extract(text, GENERATOR_INFO, 1), F.lit("")))
    kinds = F.sort_array(F.filter(F.array(*map(F.lit, GENERATIVE_TYPES)), lambda k: F.contains(text, k)))
    return F.struct(found.alias("generator"), declared(content, ACTION).alias("actions"), kinds.alias("generative_types"), (F.size(kinds) > 0).alias("declares_generative"))


def provenance_state(readable: Column, present: Column, validated: Column) -> Column:
    """struct<status, state, manifest_present> from what was found: is the file there, has it a manifest, was that
    checked.  ``validated`` is NULL where nothing could check it, which never makes a manifest valid or invalid."""
    there = F.coalesce(readable, F.lit(False))
    has = there & F.coalesce(present, F.lit(False))
    state = F.when(~has, "ABSENT").when(validated.isNull(), "UNVERIFIED").when(validated, "VERIFIED").otherwise("INVALID")
    return F.struct(F.when(there, "OK").otherwise("ERROR").alias("status"), state.alias("state"), has.alias("manifest_present"))


def completeness(fields: dict[str, Column]) -> Column:
    """struct<present, missing, ratio> of named metadata fields."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), (v.isNotNull() & (v.cast("string") != "")).alias("there")) for k, v in fields.items()])
    present = F.transform(F.filter(pairs, lambda p: F.coalesce(p["there"], F.lit(False))), lambda p: p["name"])
    missing = F.transform(F.filter(pairs, lambda p: ~F.coalesce(p["there"], F.lit(False))), lambda p: p["name"])
    return F.struct(present.alias("present"), missing.alias("missing"), (F.size(present) / F.size(pairs)).alias("ratio"))
