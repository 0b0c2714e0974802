"""Nested metadata held to bounds: bytes as hex, lists to 32 items, maps to 64 keys, texts to 512 characters."""

from __future__ import annotations

import base64
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bounds.  Fixed values.
MOST_TEXT, MOST_ITEMS, MOST_KEYS, MOST_BYTES, MOST_DEPTH = 512, 32, 64, 64, 32
#: A JSON object of this one key stands for bytes, in base64; one of these two for a fraction.
BYTES, FRACTION = "$bytes", ("$numerator", "$denominator")


def clean_bytes(value: bytes) -> str:
    """Text if it reads as printable text, else hex; of more than MOST_BYTES only how many there are."""
    if len(value) > MOST_BYTES:
        return f"<{len(value)} bytes>"
    try:
        text = value.decode().strip("\0").strip()
    except UnicodeDecodeError:
        return value.hex()
    return text if text.isprintable() else value.hex()


def clean(value, depth: int = 0):
    """The value within bounds; what lies deeper than MOST_DEPTH becomes text, a fraction over 0 and a number that is none NULL."""
    if isinstance(value, str):
        return value.strip("\0").strip()[:MOST_TEXT]
    if isinstance(value, bytes):
        return clean_bytes(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if value is None or isinstance(value, (bool, int)):
        return value
    if depth >= MOST_DEPTH:
        return str(value)[:MOST_TEXT]
    if isinstance(value, dict):
        if set(value) == {BYTES} and isinstance(value[BYTES], str):
            try:
                return clean_bytes(base64.b64decode(value[BYTES], validate=True))
            except ValueError:
                pass
        if set(value) == set(FRACTION) and all(isinstance(value[k], (int, float)) for k in FRACTION):
            return value[FRACTION[0]] / value[FRACTION[1]] if value[FRACTION[1]] else None
        return {str(k): clean(v, depth + 1) for k, v in list(value.items())[:MOST_KEYS]}
    if isinstance(value, (list, tuple)):
        return [clean(v, depth + 1) for v in value[:MOST_ITEMS]]
    return str(value)[:MOST_TEXT]


@F.pandas_udf(StringType())
def cleaned(texts: pd.Series) -> pd.Series:
    """JSON within bounds, keys sorted; NULL for NULL and for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(clean(json.loads(text)), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def cleaned_fields(row: dict[str, Column]) -> Column:
    """The same for a flat struct of named texts and numbers, without Python: texts are trimmed of NUL and blanks and cut."""
    trimmed = lambda c: F.substring(F.regexp_replace(F.regexp_replace(c, "^\\x00+|\\x00+$", ""), "^\\s+|\\s+$", ""), 1, MOST_TEXT)
    return F.struct(*[trimmed(c).alias(name) for name, c in sorted(row.items())])
