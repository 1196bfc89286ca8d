"""64-bit perceptual fingerprints: area-averaged 32x32 grey, low-frequency DCT, median cut."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.schema import ZERO_FINGERPRINT

SIDE = 32
LOW = 8
# Luma weights, in the blue-green-red order of Spark's image source.
LUMA_BGR = (0.114, 0.587, 0.299)


@lru_cache(maxsize=16)
def _cosines(n: int) -> np.ndarray:
    u, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * u / (2 * n))


@lru_cache(maxsize=256)
def _area_weights(n: int, side: int) -> np.ndarray:
    """Row i: how much each of n source pixels covers target cell i."""
    edges = np.arange(side + 1) * n / side
    left = np.maximum(edges[:-1, None], np.arange(n)[None, :])
    right = np.minimum(edges[1:, None], np.arange(1, n + 1)[None, :])
    cover = np.clip(right - left, 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def low_frequencies(grids: np.ndarray) -> np.ndarray:
    """(count, n, n) grids to (count, 64) coefficients, vertical index outermost, DC first."""
    c = _cosines(grids.shape[-1])
    return np.matmul(np.matmul(c, grids), c.T).reshape(len(grids), LOW * LOW)


def median_bits(coefficients: np.ndarray) -> list[str]:
    """One bit per coefficient: above the upper median of its row or not."""
    cut = np.sort(coefficients, axis=1)[:, LOW * LOW // 2][:, None]
    return ["".join(row) for row in np.where(coefficients > cut, "1", "0")]


def _by_grid_size(values: pd.Series, fill, finish) -> pd.Series:
    """Apply a kernel to square grids given as row-major arrays, one size at a time."""
    out = pd.Series([fill] * len(values), dtype="object")
    sizes = values.map(lambda v: 0 if v is None else len(v)).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        n = int(round(size**0.5))
        rows = np.flatnonzero(sizes == size)
        grids = np.stack([np.asarray(values.iloc[i], dtype="float64") for i in rows]).reshape(-1, n, n)
        for i, result in zip(rows, finish(low_frequencies(grids))):
            out.iat[i] = result
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dct_low(values: pd.Series) -> pd.Series:
    """Low-frequency coefficients of square grey grids."""
    return _by_grid_size(values, None, list)


@F.pandas_udf(T.StringType())
def phash_from_pixels(values: pd.Series) -> pd.Series:
    """Fingerprint of square grey grids; a missing grid counts as undecodable."""
    return _by_grid_size(values, ZERO_FINGERPRINT, median_bits)


def shrink_to_grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Decoded pixels (BGR, BGRA or grey) to a 32x32 grey grid of whole levels."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype("float64")
    grey = pixels[..., 0] if channels == 1 else pixels[..., :3] @ np.array(LUMA_BGR)
    small = _area_weights(height, SIDE) @ grey @ _area_weights(width, SIDE).T
    return np.rint(small)


def phash_batches(batches):
    """mapInPandas body: image-source rows to (path, perceptual_hash)."""
    for pdf in batches:
        grids, ok = [], []
        for data, h, w, ch in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"]):
            try:
                grids.append(shrink_to_grey(data, int(h), int(w), int(ch)))
                ok.append(True)
            except (TypeError, ValueError):
                ok.append(False)
        bits = iter(())
        if grids:
            bits = iter(median_bits(low_frequencies(np.stack(grids))))
        yield pd.DataFrame(
            {
                "path": pdf["path"],
                "perceptual_hash": [next(bits) if good else ZERO_FINGERPRINT for good in ok],
            }
        )


def file_fingerprint(content: bytes, decode) -> str:
    """Fingerprint of one file's content; the zero fingerprint if ``decode`` finds no image in it."""
    try:
        height, width, channels, pixels = decode(content)
        grid = shrink_to_grey(pixels, height, width, channels)
    except Exception:  # decoders of foreign formats fail in ways of their own
        return ZERO_FINGERPRINT
    return median_bits(low_frequencies(grid[None]))[0]
