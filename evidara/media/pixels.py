"""Measurements of decoded pixels: recompression residuals by tile, block-grid energies and tensors for detectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.media.containers import LUMA
from evidara.media.hashes import gray
from evidara.operators import windows

#: Settings of the measurement.  Fixed values.
QUALITY, BLOCK, TILE, LEAST_EDGE, GRID_RATIO = 90, 8, 32, 64, 1.05


def quantisation(quality: int) -> np.ndarray:
    """The standard table scaled to a quality of 1 to 100."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((np.array(LUMA).reshape(BLOCK, BLOCK) * scale + 50) / 100), 1, 255)


def _transform() -> np.ndarray:
    k, i = np.arange(BLOCK)[:, None], np.arange(BLOCK)[None, :]
    c = np.sqrt(2 / BLOCK) * np.cos(np.pi * (2 * i + 1) * k / (2 * BLOCK))
    c[0] /= np.sqrt(2)
    return c


_COSINES = _transform()


def recompressed(luma: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """The image as it comes back from 8x8 cosine transforms quantised at a quality; edges are repeated to whole blocks."""
    h, w = luma.shape
    padded = np.pad(luma, ((0, -h % BLOCK), (0, -w % BLOCK)), mode="edge") - 128.0
    blocks = padded.reshape(padded.shape[0] // BLOCK, BLOCK, padded.shape[1] // BLOCK, BLOCK).swapaxes(1, 2)
    table = quantisation(quality)
    held = np.round(_COSINES @ blocks @ _COSINES.T / table) * table
    back = (_COSINES.T @ held @ _COSINES).swapaxes(1, 2).reshape(padded.shape)
    return np.clip(np.round(back + 128.0), 0, 255)[:h, :w]


def tile_means(values: np.ndarray) -> np.ndarray:
    """Mean of every whole TILE x TILE tile."""
    y, x = values.shape[0] // TILE, values.shape[1] // TILE
    return values[: y * TILE, : x * TILE].reshape(y, TILE, x, TILE).mean(axis=(1, 3))


def residual_and_gradient(luma: np.ndarray, quality: int = QUALITY) -> tuple[np.ndarray, np.ndarray]:
    """Per tile the mean difference to the recompressed image and the mean step to the next pixel."""
    across = np.abs(np.diff(luma, axis=1, append=luma[:, -1:]))
    down = np.abs(np.diff(luma, axis=0, append=luma[-1:, :]))
    return tile_means(np.abs(luma - recompressed(luma, quality))), tile_means((across + down) / 2)


def grid_energies(luma: np.ndarray) -> np.ndarray:
    """Mean step over the block boundaries of each of the 8 phases of a grid."""
    across, down = np.abs(np.diff(luma, axis=1)).mean(axis=0), np.abs(np.diff(luma, axis=0)).mean(axis=1)
    at = [(phase - 1) % BLOCK for phase in range(BLOCK)]
    return np.array([np.concatenate([across[a::BLOCK], down[a::BLOCK]]).mean() for a in at])


def images(spark: SparkSession, path: str) -> DataFrame:
    """origin, written as the path of ``readers.media_files``, and the decoded image of the files that can be decoded."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("origin"), "image")


def _lumas(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    for origin, image in zip(batch["origin"].to_pylist(), batch["image"].to_pylist(), strict=True):
        if image and image["data"] and image["height"] > 0 and image["width"] > 0:
            yield origin, gray(image["height"], image["width"], image["nChannels"], image["data"])


def residual_tiles(decoded: DataFrame, quality: int = QUALITY) -> DataFrame:
    """origin, tile_y, tile_x, residual, gradient of every whole tile of images of at least 2 x 2 tiles."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, luma in _lumas(batch):
                if min(luma.shape) >= 2 * TILE:
                    residual, gradient = residual_and_gradient(luma, quality)
                    y, x = np.divmod(np.arange(residual.size), residual.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * residual.size), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(residual.ravel()), pa.array(gradient.ravel())], names=["origin", "tile_y", "tile_x", "residual", "gradient"])

    return decoded.select("origin", "image").mapInArrow(measure, "origin string, tile_y int, tile_x int, residual double, gradient double")


def grid_phases(decoded: DataFrame) -> DataFrame:
    """origin, phase, ratio, off_grid: the strongest phase of the block grid and its energy over the mean of the others."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, luma in _lumas(batch):
                if min(luma.shape) >= LEAST_EDGE:
                    energy = grid_energies(luma)
                    best = int(energy.argmax())
                    rest = np.delete(energy, best).mean()
                    rows.append((origin, best, float(energy[best] / rest) if rest > 0 else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["origin", "phase", "ratio"])

    found = decoded.select("origin", "image").mapInArrow(measure, "origin string, phase int, ratio double")
    return found.withColumn("off_grid", (F.col("ratio") >= GRID_RATIO) & (F.col("phase") != 0))


def residual_report(decoded: DataFrame, z: float = 3.0) -> DataFrame:
    """origin with the line of residual over gradient, its fit, mad, p99, n_outliers and n_tiles."""
    return windows.residual_outliers(residual_tiles(decoded), "origin", "gradient", "residual", z)


@dataclass(frozen=True)
class Spec:
    """What a detector is given and how its answer is read: width and height, mean and deviation of R, G, B in 0..1, the
    order of the axes (NCHW or NHWC), softmax, sigmoid or identity, and the output that stands for manipulated."""

    size: tuple[int, int] = (224, 224)
    mean: tuple[float, float, float] = (0.485, 0.456, 0.406)
    std: tuple[float, float, float] = (0.229, 0.224, 0.225)
    layout: str = "NCHW"
    activation: str = "softmax"
    positive: int = 1


def _triangle(size: int, to: int) -> np.ndarray:
    """Bilinear resampling matrix from ``size`` to ``to`` samples, widened when shrinking."""
    scale = max(size / to, 1.0)
    at = (np.arange(to)[:, None] + 0.5) * size / to - np.arange(size)[None, :] - 0.5
    w = np.maximum(1 - np.abs(at / scale), 0)
    return w / w.sum(axis=1, keepdims=True)


def tensor(height: int, width: int, channels: int, data: bytes, spec: Spec) -> np.ndarray:
    """float32 of one image (rows of BGR bytes) in the spec's layout."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(np.einsum("yxc,wx->ywc", rgb, _triangle(width, spec.size[0])))
    small = level(np.einsum("ywc,hy->hwc", across, _triangle(height, spec.size[1])))
    ready = (small / 255 - np.array(spec.mean)) / np.array(spec.std)
    return np.ascontiguousarray(ready.transpose(2, 0, 1) if spec.layout.upper() == "NCHW" else ready, np.float32)


def activated(outputs: np.ndarray, spec: Spec) -> np.ndarray:
    """Of each row of raw outputs the chance of the positive one; a single output is a sigmoid's or held to 0..1."""
    values = np.asarray(outputs, np.float64).reshape(len(outputs), -1)
    if values.shape[1] == 1:
        return 1 / (1 + np.exp(-values[:, 0])) if spec.activation == "sigmoid" else np.clip(values[:, 0], 0, 1)
    if spec.activation == "softmax":
        raised = np.exp(values - values.max(axis=1, keepdims=True))
        values = raised / raised.sum(axis=1, keepdims=True)
    elif spec.activation == "sigmoid":
        values = 1 / (1 + np.exp(-values))
    return values[:, spec.positive if 0 <= spec.positive < values.shape[1] else values.shape[1] - 1]


def detected(decoded: DataFrame, model, spec: Spec, batch_rows: int = 32) -> DataFrame:
    """origin, score: ``model`` gets arrays of up to ``batch_rows`` tensors and answers as many rows of raw outputs.

    ``model`` is a picklable callable; an answer that is no number in 0..1 gives a NULL score, never a clamped one.
    """

    @F.pandas_udf("double")
    def score(frames: pd.DataFrame) -> pd.Series:
        rows = list(zip(frames["height"], frames["width"], frames["nChannels"], frames["data"], strict=True))
        out = []
        for a in range(0, len(rows), batch_rows):
            stack = np.stack([tensor(int(h), int(w), int(c), bytes(d), spec) for h, w, c, d in rows[a : a + batch_rows]])
            out += activated(model(stack), spec).tolist()
        return pd.Series([v if np.isfinite(v) and 0 <= v <= 1 else None for v in out], dtype="float64")

    return decoded.select("origin", score("image").alias("score"))
