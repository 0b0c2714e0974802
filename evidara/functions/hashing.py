"""64-bit perceptual hashes, their distances and bands, and vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64
STRONG_DISTANCE, POSSIBLE_DISTANCE, STRONG_COSINE = 6, 12, 0.85


def hash_from_hex(column: Column) -> Column:
    """Signed 64-bit number of 16 hex digits, most significant first; NULL for anything else."""
    return F.when(column.rlike("^[0-9a-fA-F]{16}$"), F.conv(column, 16, -10).cast("bigint"))


def hash_to_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def bits_to_hash(bits: Column) -> Column:
    """An array of 64 booleans, most significant first, as a signed number."""
    return F.conv(F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), ""), 2, -10).cast("bigint")


def mean_hash(vector: Column) -> Column:
    """Average hash of 64 values: which lie above their mean (summed as doubles)."""
    mean = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(vector)
    # the mean is bound to a name, else it is summed again for every value
    bits = F.transform(F.array(mean), lambda m: F.array_join(F.transform(vector, lambda x: F.when(x.cast("double") > m, "1").otherwise("0")), ""))
    return F.conv(F.get(bits, F.lit(0)), 2, -10).cast("bigint")


def gradient_hash(vector: Column) -> Column:
    """Difference hash over an 8x8 grid read row by row; the last column compares with the row's first."""
    value = lambda i: F.get(vector, i)
    right = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: value(i) < value(F.floor(i / 8) * 8 + (i + 1) % 8))
    return bits_to_hash(right)


def median_hash(vector: Column) -> Column:
    """As the last step of a DCT hash: which of 64 values lie above their median."""
    ordered = F.sort_array(F.transform(vector, lambda x: x.cast("double")))
    median = (F.get(ordered, F.lit(BITS // 2 - 1)) + F.get(ordered, F.lit(BITS // 2))) / 2
    return F.conv(F.array_join(F.transform(vector, lambda x: F.when(x.cast("double") > median, "1").otherwise("0")), ""), 2, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two numbers; NULL if either is missing, never 0."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Of hex strings; different widths are an error, a missing one gives NULL."""
    wrong = F.raise_error(F.lit("hashes differ in width")).cast("int")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(F.length(a) != F.length(b), wrong).otherwise(hamming(hash_from_hex(a), hash_from_hex(b)))


def similarity(distance: Column) -> Column:
    """1 - distance / 64 without rounding: exact in binary."""
    return F.greatest(F.lit(0.0), 1 - distance / F.lit(float(BITS)))


def rounded_similarity(distance: Column) -> Column:
    """Four digits, half to even, as shown to readers."""
    return F.bround(similarity(distance), 4)


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def band(distance: Column, cosine: Column | None = None, strong: int = STRONG_DISTANCE) -> Column:
    """strong or possible; a cosine of 0.85 or more makes any candidate strong."""
    near = distance <= strong
    return F.when(near if cosine is None else near | F.coalesce(cosine >= STRONG_COSINE, F.lit(False)), "strong").otherwise("possible")


def effective_distance(same_bytes: Column, phash: Column, dhash: Column, ahash: Column, most: int = POSSIBLE_DISTANCE) -> Column:
    """0 for equal bytes; the first hash's distance if near enough, else the smallest one if that is; NULL rejects."""
    least = F.least(phash, dhash, ahash)
    return F.when(F.coalesce(same_bytes, F.lit(False)), 0).when(phash <= most, phash).when(least <= most, least)


def candidate_similarity(hash_similarity: Column, cosine: Column) -> Column:
    return F.greatest(hash_similarity, cosine)


def transformation(width_a: Column, height_a: Column, size_a: Column, width_b: Column, height_b: Column, size_b: Column) -> Column:
    """What tells two copies apart: crop (aspect differs by over 0.05), resize, recompression (size ratio and over 1024 bytes)."""
    aspect = F.abs(width_a / height_a - width_b / height_b)
    crop = F.when(aspect > 0.05, "crop").when((width_a != width_b) | (height_a != height_b), "resize")
    ratio = size_b / size_a
    packed = F.when(((ratio < 0.8) | (ratio > 1.2)) & (F.abs(size_a - size_b) > 1024), "recompression")
    return F.array_compact(F.array(crop, packed))


def match_basis(same_bytes: Column, distance: Column, phash: Column, dhash: Column, ahash: Column, cosine: Column) -> Column:
    """What a match rests on, in words: equal bytes at distance 0, else every measure there is."""
    said = [F.when(c.isNotNull(), F.concat(F.lit(f"{name} dist "), c.cast("string"))) for name, c in (("pHash", phash), ("dHash", dhash), ("aHash", ahash))]
    said.append(F.when(cosine.isNotNull(), F.concat(F.lit("embedding sim "), F.format_string("%.2f", cosine))))
    parts = F.concat_ws(", ", *said)
    exact = F.coalesce(same_bytes, F.lit(False)) & F.coalesce(distance == 0, F.lit(False))
    return F.when(exact, "Exact SHA-256 byte match").when(parts != "", F.concat(F.lit("Multi-hash verified ("), parts, F.lit(")"))).otherwise("Perceptual match")


def relationship(distance: Column, cosine: Column) -> Column:
    return F.when(distance == 0, "identical").when(distance <= STRONG_DISTANCE, "near_identical").when(distance <= POSSIBLE_DISTANCE, "similar").when(cosine >= 0.75, "semantically_similar").otherwise("unrelated")
