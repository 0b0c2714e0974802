"""Scores that may be missing: a signal that can't be measured is left out and never becomes zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(score: Column) -> Column:
    """The score if it is a finite number in 0..1, else NULL; nothing is clamped (NaN compares as the largest number)."""
    number = score.cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & number.between(0.0, 1.0), number)


def clean_confidence(value: Column) -> Column:
    """A number in 0..1 given as text or number, to four digits, else NULL."""
    return F.round(usable(value.try_cast("double")), 4)


def ramp(value: Column, points: list[tuple[float, float]], ceiling: float) -> Column:
    """Piecewise linear through points of rising x; level before the first and after the last, at most ``ceiling``."""
    out = F.when(value <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(value.isNotNull(), F.least(out.otherwise(F.lit(float(points[-1][1]))), F.lit(float(ceiling))))


#: Share of tiles that their texture doesn't explain, and the score.  Fixed values.
OUTLIER_RAMP = [(0.05, 0.15), (0.15, 0.30), (0.30, 0.45), (0.45, 0.60)]


def forensic_score(residual: Column, off_grid: Column, points: list[tuple[float, float]] = OUTLIER_RAMP, ceiling: float = 0.60) -> Column:
    """Residual ramp plus 0.05 off the block grid, capped."""
    return F.least(ramp(residual, points, ceiling) + F.when(off_grid, 0.05).otherwise(0.0), F.lit(ceiling))


def abstains(score: Column, margin: float = 0.15) -> Column:
    return F.abs(score - 0.5) < margin


def activation(logits: Column, kind: str) -> Column:
    """softmax, sigmoid or identity over an array of logits."""
    if kind == "identity":
        return logits
    if kind == "sigmoid":
        return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def mean_of_present(*columns: Column) -> Column:
    """Mean of the values that exist; NULL if none does."""
    present = F.array_compact(F.array(*columns))
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def blended_video_score(frames: Column) -> Column:
    """0.7 mean + 0.3 of four population deviations held to 0..1, over an array of frame scores; NULL if empty."""
    n = F.size(frames)
    mean = F.aggregate(frames, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(frames, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return F.when(n > 0, 0.7 * mean + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 4 * spread)))


def plain_text(score: Column) -> Column:
    """A score of up to 15 digits as text, 0.000123 rather than Spark's 1.23E-4; under 0.0001 as 1.2e-05."""
    text, size = score.cast("string"), F.abs(score)
    small = F.regexp_replace(F.regexp_replace(text, r"(\.0)?E-(\d)$", "e-0$2"), r"(\.0)?E-", "e-")
    fixed = F.regexp_replace(score.cast("decimal(38,20)").cast("string"), "0+$", "")
    return F.when(size.between(1e-4, 1e-3), fixed).when((size > 0) & (size < 1e-4), small).otherwise(text)
