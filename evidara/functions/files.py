"""File names, magic bytes, times, urls and canonical JSON."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Magic bytes as upper-case hex: position in bytes, bytes, mime type, media type, extension.  Fixed values.
MAGIC = (
    (0, "FFD8FF", "image/jpeg", "image", ".jpg"),
    (0, "89504E470D0A1A0A", "image/png", "image", ".png"),
    (0, "474946383761", "image/gif", "image", ".gif"),
    (0, "474946383961", "image/gif", "image", ".gif"),
    (0, "424D", "image/bmp", "image", ".bmp"),
    (0, "49492A00", "image/tiff", "image", ".tiff"),
    (0, "4D4D002A", "image/tiff", "image", ".tiff"),
    (8, "57454250", "image/webp", "image", ".webp"),
    (8, "57415645", "audio/wav", "audio", ".wav"),
    (8, "41564920", "video/x-msvideo", "video", ".avi"),
    (0, "1A45DFA3", "video/webm", "video", ".webm"),
    (0, "4F676753", "audio/ogg", "audio", ".ogg"),
    (0, "664C6143", "audio/flac", "audio", ".flac"),
    (0, "494433", "audio/mpeg", "audio", ".mp3"),
)
#: Brands of the ISO base media format that are not plain MP4 video.  Fixed values.
BRANDS = {"4D344120": ("audio/mp4", "audio", ".m4a"), "4D344220": ("audio/mp4", "audio", ".m4a"), "71742020": ("video/quicktime", "video", ".mov"), "68656963": ("image/heic", "image", ".heic"), "61766966": ("image/avif", "image", ".avif")}


def sniff(content: Column) -> Column:
    """struct<mime, media, ext> of a binary column by its first bytes; NULL if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    kind = lambda mime, media, ext: F.struct(F.lit(mime).alias("mime"), F.lit(media).alias("media"), F.lit(ext).alias("ext"))
    out = None
    for at, magic, mime, media, ext in MAGIC:
        hit = F.substring(head, 2 * at + 1, len(magic)) == magic
        if at == 8:
            hit = hit & head.startswith("52494646")
        out = F.when(hit, kind(mime, media, ext)) if out is None else out.when(hit, kind(mime, media, ext))
    box, brand = F.substring(head, 9, 8), F.substring(head, 17, 8)
    for code, names in BRANDS.items():
        out = out.when((box == "66747970") & (brand == code), kind(*names))
    out = out.when(box == "66747970", kind("video/mp4", "video", ".mp4"))
    out = out.when(box.isin("6D6F6F76", "6D646174", "77696465", "66726565"), kind("video/quicktime", "video", ".mov"))
    return out.when(head.rlike("^FF(FB|F3|F2|FA)"), kind("audio/mpeg", "audio", ".mp3")).when(head.rlike("^FFF[19]"), kind("audio/aac", "audio", ".aac"))


@F.pandas_udf(StringType())
def composed(names: pd.Series) -> pd.Series:
    """NFKC form without unprintable characters."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKC", s) if c.isprintable()))


def safe_filename(name: Column) -> Column:
    """Base name, NFKC, safe characters only, at most 180, never empty."""
    base = F.regexp_extract(name, r"[^/\\]*$", 0)
    clean = F.regexp_replace(composed(base), "[^A-Za-z0-9._ -]", "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"_{2,}", "_"), r"^[ .]+|[ .]+$", "")
    return F.when(F.length(F.coalesce(clean, F.lit(""))) == 0, "file").otherwise(F.substring(clean, 1, 180))


def media_of(column: Column) -> Column:
    """image, video or audio from an alias, a mime type or a file name; NULL if none is meant."""
    low = F.lower(F.trim(column))
    ext = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)
    return (
        F.when(low.isin("image", "photo", "picture", "img") | low.startswith("image/") | ext.isin("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "heic"), "image")
        .when(low.isin("video", "movie", "clip") | low.startswith("video/") | ext.isin("mp4", "mov", "avi", "mkv", "webm", "m4v"), "video")
        .when(low.isin("audio", "voice", "sound", "speech") | low.startswith("audio/") | ext.isin("wav", "mp3", "flac", "ogg", "m4a", "aac"), "audio")
    )


def iso_seconds(ts: Column) -> Column:
    """ISO-8601 to the second with Z; sorts like time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO string with or without offset; NULL if malformed."""
    return F.try_to_timestamp(text)


def parse_exif(text: Column) -> Column:
    """The three spellings cameras use, then ISO; NULL if none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ssXXX")], F.try_to_timestamp(text))


def domain(url: Column) -> Column:
    """Lower-case authority (with a port, if any) without www., or the url itself where there is none."""
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.coalesce(F.regexp_replace(authority, r"^www\.", ""), url)


def is_public_url(url: Column) -> Column:
    """http(s) with a host that is no literal private, loopback, link-local or reserved address; no lookup is made."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    private = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^(22[4-9]|2[3-5][0-9])\.|^\[(::1?|f[cd]|fe[89ab])|^localhost$|\.local(host)?$")
    return scheme.isin("http", "https") & (host != "") & ~private


def canonical(value) -> str:
    """Sorted keys, no blanks, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Any JSON text in canonical form; NULL stays, text that isn't JSON becomes a JSON string."""

    def one(text):
        if text is None:
            return None
        try:
            return canonical(json.loads(text))
        except ValueError:
            return canonical(text)

    return texts.map(one)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) under a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def digest_of(fields: dict[str, Column]) -> Column:
    """sha256 of the canonical JSON of named fields: keys sorted, no blanks, missing ones as null."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def row_hash(previous: Column, content: Column) -> Column:
    """Link of a hash chain: sha256 over the previous link's hash and the content."""
    return F.sha2(F.concat(previous, content).cast("binary"), 256)


def bounded(text: Column, most: int = 512) -> Column:
    return F.substring(text, 1, most)


def case_sequence(text: Column) -> Column:
    """The number in a case reference such as CASE-2026-1042; NULL if there is none."""
    return F.regexp_extract(text, r"^[A-Z]+-(?:[0-9]{4}-)?([0-9]+)$", 1).try_cast("int")


def under(path: Column, root: str) -> Column:
    """Path lies below root and has no step upwards."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


#: What names an editor, and what a generator of synthetic media.  Fixed values.
EDITOR_HINTS = ("photoshop", "lightroom", "gimp", "affinity", "paint.net", "pixlr", "snapseed", "picsart", "canva", "facetune", "capture one", "luminar", "topaz", "krita", "inkscape", "imagemagick", "ffmpeg")
GENERATIVE_HINTS = ("midjourney", "stable diffusion", "stablediffusion", "dall-e", "dalle", "firefly", "openai", "leonardo.ai", "flux", "comfyui", "automatic1111", "invokeai", "gemini", "imagen")


def software_hint(software: Column, hints: tuple[str, ...]) -> Column:
    """First of the hints that the lower-cased text contains, else NULL."""
    found = F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(software), h))
    return F.get(found, F.lit(0))
