"""Perceptual hashes of images read by Spark's ``image`` source (rows of BGR bytes)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@cache
def _weights(size: int, to: int) -> np.ndarray:
    """Lanczos-3 resampling matrix from ``size`` to ``to`` samples, widened when shrinking."""
    scale = max(size / to, 1.0)
    at = (np.arange(to)[:, None] + 0.5) * size / to - np.arange(size)[None, :] - 0.5
    x = at / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return pixels[:, :, 0]
    b, g, r = pixels[:, :, 0], pixels[:, :, 1], pixels[:, :, 2]
    return np.floor((19595 * r + 38470 * g + 7471 * b + 32768) / 65536)


def shrunk(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Both passes rounded to bytes."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(pixels @ _weights(pixels.shape[1], width).T)
    return level(_weights(pixels.shape[0], height) @ across)


@cache
def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * (2 * i + 1) * k / (2 * n))  # not normalised


def to_hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def hashes_of(pixels: np.ndarray) -> tuple[str, str, str]:
    """DCT, gradient and mean hash of a gray image."""
    low = (_cosines(32) @ shrunk(pixels, 32, 32) @ _cosines(32).T)[:8, :8]
    step, flat = shrunk(pixels, 8, 9), shrunk(pixels, 8, 8)
    return to_hex(low > np.median(low)), to_hex(step[:, 1:] > step[:, :-1]), to_hex(flat > flat.mean())


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("phash", "dhash", "ahash")]))
def perceptual_hashes(image: pd.DataFrame) -> pd.DataFrame:
    """Of an image struct; NULL hashes where there is nothing to decode."""
    rows = []
    for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        ok = data is not None and h > 0 and w > 0
        rows.append(hashes_of(gray(int(h), int(w), int(c), bytes(data))) if ok else (None, None, None))
    return pd.DataFrame(rows, columns=["phash", "dhash", "ahash"])


def hashed_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height and the three hashes of the images under a path; files that can't be decoded are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select("image.origin", "image.width", "image.height", perceptual_hashes("image").alias("h")).select("origin", "width", "height", "h.*")
