"""XMP packets and ICC colour profiles inside JPEG, PNG and TIFF files."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from evidara.media.containers import segments

#: Signatures, tags and namespaces of the formats.  Fixed values.
XMP_JPEG, ICC_JPEG, PNG_HEAD, XMP_PNG = b"http://ns.adobe.com/xap/1.0/\0", b"ICC_PROFILE\0", b"\x89PNG\r\n\x1a\n", b"XML:com.adobe.xmp"
XMP_TAG, ICC_TAG = 700, 34675
SPACES = {"http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/xap/1.0/mm/": "xmpMM", "http://ns.adobe.com/xap/1.0/sType/ResourceEvent#": "stEvt", "http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/photoshop/1.0/": "photoshop"}
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
#: Bytes of a packed profile or packet that are unpacked at most.
MOST_BYTES = 16 << 20


def _unpacked(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, MOST_BYTES)
    except zlib.error:
        return b""


def _jpeg(data: bytes) -> tuple[bytes, bytes]:
    xmp, parts = b"", {}
    for marker, body in segments(data):
        if marker == 0xE1 and body.startswith(XMP_JPEG):
            xmp = xmp or body[len(XMP_JPEG) :]
        elif marker == 0xE2 and body.startswith(ICC_JPEG) and len(body) >= 14:
            parts.setdefault(body[12], body[14:])  # a profile over 64 KB is cut into numbered segments
    return xmp, b"".join(parts[k] for k in sorted(parts))


def _png(data: bytes) -> tuple[bytes, bytes]:
    xmp, icc, at = b"", b"", 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"iCCP":
            _, _, rest = body.partition(b"\0")
            icc = icc or _unpacked(rest[1:])
        elif kind == b"iTXt" and body.startswith(XMP_PNG + b"\0"):
            rest = body[len(XMP_PNG) + 1 :]
            text = rest[2:].split(b"\0", 2)[-1]  # after flag, method, language and translated keyword
            xmp = xmp or (_unpacked(text) if rest[:1] == b"\1" else text)
        elif kind == b"IEND":
            break
        at += 12 + size
    return xmp, icc


def _tiff(data: bytes) -> tuple[bytes, bytes]:
    order = {b"II*\0": "<", b"MM\0*": ">"}[data[:4]]
    found, seen = {}, set()
    (at,) = struct.unpack(order + "I", data[4:8])
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count, where = struct.unpack(order + "HHII", entry)
            if tag in (XMP_TAG, ICC_TAG) and kind in (1, 7):
                found.setdefault(tag, entry[8 : 8 + count] if count <= 4 else data[where : where + count])
        after = data[at + 2 + 12 * n : at + 6 + 12 * n]
        at = struct.unpack(order + "I", after)[0] if len(after) == 4 else 0
    return found.get(XMP_TAG, b""), found.get(ICC_TAG, b"")


def packets(data: bytes) -> tuple[bytes, bytes]:
    """(XMP packet, ICC profile) of a file, empty where there is none."""
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data[:8] == PNG_HEAD:
        return _png(data)
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        return _tiff(data)
    return b"", b""


def _name(tag: str) -> str | None:
    space, _, local = tag[1:].partition("}")
    return f"{SPACES[space]}:{local}" if tag.startswith("{") and space in SPACES else None


def xmp_fields(packet: bytes) -> dict:
    """creator_tool, create_date, modify_date, document_id, original_id, history of a packet.

    A property may be an attribute or an element; the history is one ``action by agent`` an event.  A packet that declares a
    document type, and so might expand entities, or that is no XML has no fields.
    """
    if b"<!DOCTYPE" in packet or b"<!ENTITY" in packet:
        return {}
    try:
        root = ET.fromstring(packet.strip(b"\0 \t\r\n"))
    except (ET.ParseError, ValueError, LookupError):
        return {}
    plain: dict[str, str] = {}
    history: list[str] = []
    for element in root.iter():
        name = _name(element.tag)
        own = {k: v for tag, v in element.attrib.items() if (k := _name(tag))}
        own |= {k: (child.text or "").strip() for child in element if not len(child) and (k := _name(child.tag))}
        if element.tag == RDF + "li" or any(k.startswith("stEvt:") for k in own):
            if "stEvt:action" in own:
                history.append(" by ".join(v for v in (own["stEvt:action"], own.get("stEvt:softwareAgent", "")) if v))
            continue
        for k, v in own.items():
            if v:
                plain.setdefault(k, v)
        if name and not len(element) and (element.text or "").strip():
            plain.setdefault(name, element.text.strip())
    names = {"creator_tool": "xmp:CreatorTool", "create_date": "xmp:CreateDate", "modify_date": "xmp:ModifyDate", "document_id": "xmpMM:DocumentID", "original_id": "xmpMM:OriginalDocumentID"}
    return {k: plain.get(n) for k, n in names.items()} | {"history": history}


def icc_fields(profile: bytes) -> dict:
    """version, profile_class, colour_space and description of a profile; nothing of one without its signature."""
    if len(profile) < 132 or profile[36:40] != b"acsp":
        return {}
    text = lambda b: b.decode("latin-1").strip("\0 ")
    out = {"version": f"{profile[8]}.{profile[9] >> 4}", "profile_class": text(profile[12:16]), "colour_space": text(profile[16:20])}
    (n,) = struct.unpack(">I", profile[128:132])
    for k in range(min(n, 256)):
        entry = profile[132 + 12 * k : 144 + 12 * k]
        if len(entry) < 12:
            break
        tag, at, size = struct.unpack(">4sII", entry)
        body = profile[at : at + size]
        if tag == b"desc" and body[:4] == b"desc" and len(body) >= 12:
            (length,) = struct.unpack(">I", body[8:12])
            out["description"] = text(body[12 : 12 + length])
        elif tag == b"desc" and body[:4] == b"mluc" and len(body) >= 28:
            length, start = struct.unpack(">II", body[20:28])
            out["description"] = body[start : start + length].decode("utf-16-be", "replace").strip("\0 ")
    return out


_XMP = StructType([StructField("present", BooleanType()), StructField("size_bytes", IntegerType()), *[StructField(n, StringType()) for n in ("creator_tool", "create_date", "modify_date", "document_id", "original_id")], StructField("history", ArrayType(StringType()))])
_ICC = StructType([StructField("present", BooleanType()), StructField("size_bytes", IntegerType()), *[StructField(n, StringType()) for n in ("version", "profile_class", "colour_space", "description")]])


def _rows(content: pd.Series, which: int, fields, schema: StructType) -> pd.DataFrame:
    rows = []
    for c in content:
        packet = packets(bytes(c))[which] if c is not None else None
        found = {} if packet is None else {"present": bool(packet), "size_bytes": len(packet)} | fields(packet)
        rows.append([found.get(n) for n in schema.names])
    return pd.DataFrame(rows, columns=schema.names, dtype=object)


@F.pandas_udf(_XMP)
def xmp(content: pd.Series) -> pd.DataFrame:
    return _rows(content, 0, xmp_fields, _XMP)


@F.pandas_udf(_ICC)
def icc(content: pd.Series) -> pd.DataFrame:
    return _rows(content, 1, icc_fields, _ICC)
