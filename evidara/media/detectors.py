"""Pluggable scoring callables, one a media type, behind one contract.

A callable gets the declared columns of one item and answers a score, (score, extras), (score, confidence, extras) or a
mapping.  The adapter validates and never clamps: a failure, a malformed score or an abstention gives a NULL score.
"""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "score double, confidence double, status string"
_REGISTERED: dict[str, tuple[Callable, tuple[str, ...]]] = {}


def register(media_type: str, call: Callable | str, columns: tuple[str, ...]) -> None:
    """Names the callable, or ``module:name`` of one, that scores a media type from the given columns."""
    if isinstance(call, str):
        module, _, name = call.partition(":")
        call = getattr(importlib.import_module(module), name)
    _REGISTERED[media_type] = (call, columns)


def _number(value) -> float | None:
    fits = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and 0 <= value <= 1
    return float(value) if fits else None


def answer(raw) -> tuple[float | None, float | None, str]:
    """(score, confidence, status) of whatever a callable returned."""
    if raw is None:
        return None, None, "ABSTAINED"
    if isinstance(raw, dict):
        if raw.get("abstained"):
            return None, None, "ABSTAINED"
        score, confidence = raw.get("score"), raw.get("confidence")
    elif isinstance(raw, tuple):
        score, confidence = raw[0], raw[1] if len(raw) == 3 else None
    else:
        score, confidence = raw, None
    good = _number(score)
    return (good, _number(confidence), "OK") if good is not None else (None, None, "ERROR")


def _runner(call: Callable, columns: tuple[str, ...]):
    @F.pandas_udf(RESULT)
    def run(args: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in args.itertuples(index=False):
            try:
                rows.append(answer(call(**dict(zip(columns, row, strict=True)))))
            except Exception:
                rows.append((None, None, "ERROR"))
        return pd.DataFrame(rows, columns=["score", "confidence", "status"]).astype({"score": "float64", "confidence": "float64"}).replace({float("nan"): None})

    return run


def scored(items: DataFrame, media: str = "media_type") -> DataFrame:
    """The items with score, confidence and status; a media type without a callable is UNAVAILABLE."""
    result = F.from_json(F.lit('{"status": "UNAVAILABLE"}'), RESULT)
    for kind, (call, columns) in _REGISTERED.items():
        result = F.when(F.col(media) == kind, _runner(call, columns)(F.struct(*columns))).otherwise(result)
    return items.withColumn("_r", result).select(*items.columns, "_r.score", "_r.confidence", "_r.status")
