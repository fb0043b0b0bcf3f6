"""Preparation of images for text recognition, on pixel arrays; decoding is the image source's, encoding the engine's."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in pixels and the weights of red, green and blue.
READABLE_WIDTH, MOST_WIDTH, MOST_HEIGHT, MARGIN = 1200, 3200, 3200, 40
WEIGHTS = (0.299, 0.587, 0.114)


def target_size(width: int, height: int) -> tuple[int, int]:
    """Narrow images grow to a readable width, no further than the largest sizes; none shrinks."""
    wanted = READABLE_WIDTH / width if width < READABLE_WIDTH else 1.0
    scale = max(1.0, min(wanted, MOST_WIDTH / width, MOST_HEIGHT / height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def enlarged(pixels: np.ndarray) -> np.ndarray:
    """``pixels`` (height, width, 3) at their target size, between pixels by straight lines."""
    height, width = pixels.shape[:2]
    w, h = target_size(width, height)
    if (w, h) == (width, height):
        return pixels
    ys, xs = (np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1) for n, old in ((h, height), (w, width)))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    rows = [pixels[y][:, x0] * (1 - fx) + pixels[y][:, x1] * fx for y in (y0, y1)]
    return np.rint(rows[0] * (1 - fy) + rows[1] * fy).astype(np.uint8)


def luminance(pixels: np.ndarray) -> np.ndarray:
    return (pixels.astype(float) @ np.array(WEIGHTS)).astype(np.uint8)


def otsu_threshold(gray: np.ndarray) -> int:
    """The level that parts the histogram with the largest variance between both sides; the first of equals, 0 if all is one level."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, level = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (level / below - (level[-1] - level) / above) ** 2)
    return int(np.argmax(between))


def variants(pixels: np.ndarray) -> list[np.ndarray]:
    """Enlarged; with a white margin; black below the threshold and white above; and the reverse."""
    base = enlarged(pixels)
    margin = np.pad(base, ((MARGIN, MARGIN), (MARGIN, MARGIN), (0, 0)), constant_values=255)
    gray = luminance(base)
    dark = np.where(gray > otsu_threshold(gray), 255, 0).astype(np.uint8)
    return [base, margin, dark, 255 - dark]


def read_images(spark, folder: str) -> DataFrame:
    """``path, width, height, threshold`` of the images in ``folder`` that can be decoded."""
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*").filter("nChannels in (1, 3, 4)")

    @F.pandas_udf("int")
    def threshold(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw: bytes, n: int) -> int:
            flat = np.frombuffer(raw, np.uint8).reshape(-1, n)
            return otsu_threshold(flat[:, 0] if n == 1 else luminance(flat[:, 2::-1]))  # stored as blue, green, red

        return pd.Series([one(d, n) for d, n in zip(data, channels)])

    return images.select(F.col("origin").alias("path"), "width", "height", threshold("data", "nChannels").alias("threshold"))
