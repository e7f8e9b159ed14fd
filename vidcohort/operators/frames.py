"""Pixel measurements of frames: the one Python function of this part, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GRID_WIDTH, GRID_HEIGHT = 160, 90
KIND = "video_id string, frame_no int, luma double, mean_hue double, valid_px long, gray_grid array<float>"
#: Bytes that are measured at once: the pixels of some pictures and the grids that come of them.
AT_ONCE = 4 << 20


def gray(bgr: np.ndarray) -> np.ndarray:
    """Gray levels 0-255, rounded at each pixel."""
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299]))


def hue_and_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue 0-179 and saturation 0-255 of each pixel."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    high, low = bgr.max(axis=-1).astype(float), bgr.min(axis=-1).astype(float)
    span = np.where(high > low, high - low, 1)
    hue = np.select([high == r, high == g], [(g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span) * 30
    return np.where(high > low, np.rint(hue % 180) % 180, 0), np.where(high > 0, np.rint(255 * (high - low) / np.maximum(high, 1)), 0)


def shrink(levels: np.ndarray) -> np.ndarray:
    """Bilinear sample of pictures of one size on the fixed grid."""
    h, w = levels.shape[-2:]
    y = np.clip((np.arange(GRID_HEIGHT) + 0.5) * h / GRID_HEIGHT - 0.5, 0, h - 1)
    x = np.clip((np.arange(GRID_WIDTH) + 0.5) * w / GRID_WIDTH - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    rows = levels[..., y0, :] * (1 - fy) + levels[..., y1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def measured(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(luma, mean hue or nan, vivid pixels, grid) of pictures of one size."""
    levels = gray(images)
    hue, saturation = hue_and_saturation(images)
    vivid = saturation > 40
    n = vivid.sum(axis=(1, 2))
    mean = np.where(n > 0, (hue * vivid).sum(axis=(1, 2)) / np.maximum(n, 1), np.nan)
    return levels.mean(axis=(1, 2)), mean, n, shrink(levels).reshape(len(images), -1).astype(np.float32)


def at_once(height: int, width: int) -> int:
    """How many pictures of one size are measured at once; a small picture still has a whole grid of doubles."""
    return max(1, AT_ONCE // max(height * width * 3, GRID_HEIGHT * GRID_WIDTH * 8))


def frame_metrics(frames: DataFrame) -> DataFrame:
    """Mean gray, mean hue of saturated pixels and the gray grid of each frame of three channels."""

    def run(batches):
        for b in batches:
            for (h, w), same in b.groupby(["height", "width"], sort=False):
                step = at_once(h, w)
                for i in range(0, len(same), step):
                    part = same.iloc[i : i + step]
                    images = np.frombuffer(b"".join(part["data"]), np.uint8).reshape(-1, h, w, 3)
                    luma, hue, n, grid = measured(images)
                    yield pd.DataFrame({
                        "video_id": part["video_id"].to_numpy(), "frame_no": part["frame_no"].to_numpy(), "luma": luma,
                        "mean_hue": pd.Series(hue).astype(object).where(~np.isnan(hue), None), "valid_px": n, "gray_grid": list(grid),
                    })

    return frames.where("nChannels = 3").select("video_id", "frame_no", "height", "width", "data").mapInPandas(run, KIND)
