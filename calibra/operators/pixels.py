"""Distortions and features of pictures held as arrays: numpy in Arrow batches, one registry of kernels.

KERNELS defines each distortion on one picture; tables go through `pixel_stacks`, which does the same to many at a time.

A picture is a flat array<double> of SIDE x SIDE x 3 values in 0 to 255. Codecs (JPEG, JPEG 2000), palettes, fonts and
resampling filters need an imaging library and are not built.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from calibra.operators import pixel_stacks
from calibra.operators.pixel_stacks import STACK

SIDE = 32


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255)


def _blur(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(3)]
        p = np.pad(x, pad, mode="reflect")
        x = sum(w * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return x


def _disc(x: np.ndarray, radius: int) -> np.ndarray:
    y, z = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    mask = y**2 + z**2 <= radius**2
    p = np.pad(x, ((radius, radius), (radius, radius), (0, 0)), mode="reflect")
    n = x.shape[0]
    return sum(p[i : i + n, j : j + n] for i, j in zip(*np.nonzero(mask), strict=True)) / mask.sum()


def _motion(x: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    a = rng.uniform(0, np.pi)
    shifts = [(int(round(t * np.sin(a))), int(round(t * np.cos(a)))) for t in np.linspace(-length / 2, length / 2, length)]
    p = np.pad(x, ((length, length), (length, length), (0, 0)), mode="reflect")
    n = x.shape[0]
    return sum(p[length + dy : length + dy + n, length + dx : length + dx + n] for dy, dx in shifts) / len(shifts)


def _impulse(x: np.ndarray, p: float, rng: np.random.Generator) -> np.ndarray:
    u = rng.random(x.shape[:2])[..., None]
    return np.where(u < p / 2, 0.0, np.where(u > 1 - p / 2, 255.0, x))


def _jitter(x: np.ndarray, amount: float, rng: np.random.Generator) -> np.ndarray:
    n = x.shape[0]
    y, z = np.clip(np.mgrid[0:n, 0:n] + rng.uniform(-amount, amount, (2, n, n)), 0, n - 1)
    y0, z0 = np.minimum(y.astype(int), n - 2), np.minimum(z.astype(int), n - 2)
    fy, fz = (y - y0)[..., None], (z - z0)[..., None]
    return (1 - fy) * ((1 - fz) * x[y0, z0] + fz * x[y0, z0 + 1]) + fy * ((1 - fz) * x[y0 + 1, z0] + fz * x[y0 + 1, z0 + 1])


def _gray(x: np.ndarray) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114])


def _level(gray: np.ndarray) -> np.ndarray:
    return gray[..., None]


def _spread_colour(x: np.ndarray, size: int) -> np.ndarray:
    """Colour grows over its edges, brightness stays: the strongest colour difference in a square of `size` replaces each."""
    y = _gray(x)
    r, out = size // 2, []
    for c in range(3):
        d = x[..., c] - y
        p = np.pad(d, r, mode="edge")
        views = np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1))
        high, low = views.max(axis=(2, 3)), views.min(axis=(2, 3))
        out.append(y + np.where(np.abs(high) >= np.abs(low), high, low))
    return np.stack(out, axis=-1)


def _median(x: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(x, ((r, r), (r, r), (0, 0)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1), axis=(0, 1)), axis=(3, 4))


def _pixelated(x: np.ndarray, size: int) -> np.ndarray:
    n = x.shape[0]
    at = np.minimum(np.arange(n) // size * size + size // 2, n - 1)
    return x[np.ix_(at, at)]


def _patches(x: np.ndarray, size: int, count: int, g: np.random.Generator) -> np.ndarray:
    size = min(size, x.shape[0] // 2)
    out, n = x.copy(), x.shape[0] - size
    for _ in range(count):
        y, z, dy, dz = (int(v) for v in (*g.integers(0, n + 1, 2), *g.integers(-size, size + 1, 2)))
        ty, tz = np.clip([y + dy, z + dz], 0, n)
        out[ty : ty + size, tz : tz + size] = x[y : y + size, z : z + size]
    return out


def _coloured(x: np.ndarray, size: int, count: int, g: np.random.Generator) -> np.ndarray:
    out, size = x.copy(), min(size, x.shape[0] - 1)
    for _ in range(count):
        y, z = g.integers(0, x.shape[0] - size, 2)
        out[y : y + size, z : z + size] = g.uniform(0, 255, 3)
    return out


#: name -> (picture, parameter, generator) -> picture before clipping
KERNELS = {
    "gaussian_blur": lambda x, v, g: _blur(x, v),
    "lens_blur": lambda x, v, g: _disc(x, v),
    "motion_blur": lambda x, v, g: _motion(x, v, g),
    "color_diffusion": lambda x, v, g: _spread_colour(x, v),
    "color_shift": lambda x, v, g: np.stack([np.roll(x[..., 0], v, 1), x[..., 1], np.roll(x[..., 2], -v, 1)], axis=-1),
    "color_saturation_up": lambda x, v, g: _level(_gray(x)) + v * (x - _level(_gray(x))),
    "color_saturation_down": lambda x, v, g: _level(_gray(x)) + v * (x - _level(_gray(x))),
    "white_noise": lambda x, v, g: x + g.normal(0, v, x.shape[:2])[..., None],
    "color_noise": lambda x, v, g: x + g.normal(0, v, x.shape),
    "impulse_noise": lambda x, v, g: _impulse(x, v, g),
    "multiplicative_noise": lambda x, v, g: x * (1 + g.normal(0, v, x.shape)),
    "denoise": lambda x, v, g: _blur(_median(x, v), 0.8),
    "brighten": lambda x, v, g: x * v,
    "darken": lambda x, v, g: x * v,
    "mean_shift": lambda x, v, g: x + v,
    "jitter": lambda x, v, g: _jitter(x, v, g),
    "patch_shuffle": lambda x, v, g: _patches(x, *v, g),
    "pixelate": lambda x, v, g: _pixelated(x, v),
    "quantization": lambda x, v, g: np.floor(x / 2 ** (8 - v)) * 2 ** (8 - v),
    "color_block": lambda x, v, g: _coloured(x, *v, g),
    "sharpen": lambda x, v, g: x + v * (x - _blur(x, 2.0)),
    "contrast_change": lambda x, v, g: _gray(x).mean() + v * (x - _gray(x).mean()),
    "ladder_blur": lambda x, v, g: _blur(x, v) if v else x,
    "ladder_noise": lambda x, v, g: x + g.normal(0, v, x.shape) if v else x,
    "ladder_exposure": lambda x, v, g: x * v,
}
#: Parameters of the levels, mildest first, in pixels or grey values (fixed values).
LEVELS = {
    "gaussian_blur": [0.6, 1.2, 2.2, 3.6, 5.5],
    "lens_blur": [2, 3, 5, 8, 12],
    "motion_blur": [4, 7, 11, 16, 22],
    "color_diffusion": [5, 9, 15, 23, 33],
    "color_shift": [1, 2, 3, 5, 7],
    "color_saturation_up": [1.4, 1.8, 2.4, 3.2, 4.2],
    "color_saturation_down": [0.75, 0.55, 0.38, 0.2, 0.0],
    "white_noise": [5, 10, 17, 26, 38],
    "color_noise": [5, 10, 17, 26, 38],
    "impulse_noise": [0.004, 0.01, 0.02, 0.04, 0.07],
    "multiplicative_noise": [0.06, 0.12, 0.2, 0.3, 0.42],
    "denoise": [3, 5, 7, 9, 13],
    "brighten": [1.3, 1.6, 2.0, 2.6, 3.4],
    "darken": [0.72, 0.52, 0.36, 0.22, 0.1],
    "mean_shift": [12, 25, 42, 62, 85],
    "jitter": [0.6, 1.1, 1.8, 2.8, 4.2],
    "patch_shuffle": [(16, 6), (16, 12), (16, 22), (16, 34), (16, 50)],
    "pixelate": [3, 5, 8, 13, 20],
    "quantization": [5, 4, 3, 2, 1],
    "color_block": [(10, 1), (16, 3), (22, 6), (28, 10), (36, 16)],
    "sharpen": [0.8, 1.5, 2.4, 3.6, 5.2],
    "contrast_change": [0.78, 0.58, 0.4, 0.24, 0.1],
    "ladder_blur": [0, 1.2, 3.0, 7.0],
    "ladder_noise": [0, 10, 25, 60],
    "ladder_exposure": [1.0, 0.5, 0.25, 0.1],
}


def degrade(x: np.ndarray, kernel: str, level: int, seed: int) -> np.ndarray:
    """A picture (rows, columns, 3) at a level of a distortion, clipped; the same for the same arguments."""
    return _clip(KERNELS[kernel](x, LEVELS[kernel][level], np.random.default_rng(seed)))


def pictures(ids: DataFrame) -> DataFrame:
    """item_id, pixels: a picture for each id, the same on every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), STACK):
                own = batch.column("item_id").slice(k, STACK)
                yield pa.RecordBatch.from_arrays([own.cast(pa.int64()), _lists(pixel_stacks.pictures(own.to_numpy(), SIDE))], names=["item_id", "pixels"])

    _small_batches(ids)
    return ids.mapInArrow(run, "item_id long, pixels array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    """A stack as an array of lists."""
    flat = np.moveaxis(x, -1, 0).reshape(x.shape[-1], -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _stack(pixels: pa.Array) -> np.ndarray:
    values = pixels.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(len(pixels), SIDE * SIDE * 3).T).reshape(SIDE, SIDE, 3, len(pixels))


def _small_batches(df: DataFrame) -> None:
    """A batch is some stacks of pictures, not ten thousand pictures."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * STACK * SIDE * SIDE * 3 * 8))


def distort(rows: DataFrame, level: int = 2) -> DataFrame:
    """rows: item_id, pixels, kernels (array of names). Gives item_id, kernel, mean, deviation of each result at a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike: dict[tuple, list[int]] = {}
            for i, names in enumerate(batch.column("kernels").to_pylist()):
                alike.setdefault(tuple(names), []).append(i)
            for names, places in alike.items():
                for k in range(0, len(places), STACK):
                    own = batch.take(pa.array(places[k : k + STACK]))
                    ids = own.column("item_id").to_numpy()
                    x, draws = _stack(own.column("pixels")), pixel_stacks.Draws(ids, SIDE)
                    made = {n: pixel_stacks.moments(pixel_stacks.degrade(x, n, LEVELS[n][level], draws)) for n in set(names)}
                    columns = [np.concatenate([made[n][i].round(6) for n in names]) if names else np.empty(0) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(names)), pa.int64()), pa.array(np.repeat(names, len(ids)).tolist(), pa.string()), *map(pa.array, columns)], names=["item_id", "kernel", "mean", "deviation"])

    _small_batches(rows)
    return rows.mapInArrow(run, "item_id long, kernel string, mean double, deviation double")


def _names() -> list[str]:
    return list(pixel_stacks.features(np.zeros((SIDE, SIDE, 3, 1))))


def features(rows: DataFrame) -> DataFrame:
    """item_id and a column for each of 29 measures of sharpness, noise, blocks, light, colour and contrast."""
    names = _names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), STACK):
                made = pixel_stacks.features(_stack(batch.column("pixels").slice(k, STACK)))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(k, STACK).cast(pa.int64()), *(pa.array(made[n].round(6)) for n in names)], names=["item_id", *names])

    _small_batches(rows)
    return rows.mapInArrow(run, "item_id long, " + ", ".join(f"{n} double" for n in names))


def laddered(rows: DataFrame, kernel: str) -> DataFrame:
    """item_id, level and a column for each feature of every picture at every level of a distortion."""
    names = _names()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), STACK):
                ids = batch.column("item_id").slice(k, STACK).cast(pa.int64())
                x, draws = _stack(batch.column("pixels").slice(k, STACK)), pixel_stacks.Draws(ids.to_numpy(), SIDE)
                for level, value in enumerate(LEVELS[kernel]):
                    made = pixel_stacks.features(pixel_stacks.degrade(x, kernel, value, draws))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), level, np.int32)), *(pa.array(made[n]) for n in names)], names=["item_id", "level", *names])

    _small_batches(rows)
    return rows.mapInArrow(run, "item_id long, level int, " + ", ".join(f"{n} double" for n in names))
