"""Small per-image numpy helpers used inside Arrow batches."""

from functools import lru_cache

import numpy as np


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) RGB from interleaved BGR, BGRA or grey bytes."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    return np.ascontiguousarray(raw[:, :, 2::-1])


def _kernel(method: str):
    """(reach, weight by distance) of a resize method, at a scale of one."""
    if method == "bilinear":
        return 1.0, lambda d: np.clip(1.0 - d, 0.0, None)
    if method == "bicubic":  # the cubic convolution with a = -0.5
        return 2.0, lambda d: np.where(
            d < 1, (1.5 * d - 2.5) * d * d + 1,
            np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
    raise ValueError(f"unknown resize method {method!r}")


@lru_cache(maxsize=256)
def resize_taps(source: int, target: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), each (taps, target), of a one-axis resize; pixel centres at i + 0.5.

    When it shrinks, the kernel is stretched, so every pixel counts.
    """
    scale = source / target
    centres = (np.arange(target) + 0.5) * scale
    if method == "nearest":
        places = np.clip(np.floor(centres).astype(int), 0, source - 1)
        return places[None], np.ones((1, target))
    reach, weight = _kernel(method)
    stretch = max(scale, 1.0)
    first = np.floor(centres - reach * stretch).astype(int)
    places = first + np.arange(int(np.ceil(2 * reach * stretch)) + 2)[:, None]
    weights = weight(np.abs(places + 0.5 - centres) / stretch)
    weights[(places < 0) | (places >= source)] = 0.0
    used = weights.any(axis=1)
    places, weights = np.clip(places[used], 0, source - 1), weights[used]
    return places, weights / weights.sum(axis=0)


def resized(planes: np.ndarray, height: int, width: int, method: str) -> np.ndarray:
    """(channels, height, width) of (channels, any, any), rows first."""
    places, weights = resize_taps(planes.shape[1], height, method)
    rows = sum(planes[:, p, :] * w[:, None] for p, w in zip(places, weights))
    places, weights = resize_taps(planes.shape[2], width, method)
    return sum(rows[:, :, p] * w for p, w in zip(places, weights))


def model_tensor(rgb: np.ndarray, size: int, method: str, mean, std) -> np.ndarray:
    """Resized, scaled to 0..1, normalised, channel-first and flat, as float32."""
    planes = resized(rgb.astype(np.float64).transpose(2, 0, 1) / 255.0, size, size, method)
    shifted = (planes - np.asarray(mean)[:, None, None]) / np.asarray(std)[:, None, None]
    return shifted.astype(np.float32).ravel()
