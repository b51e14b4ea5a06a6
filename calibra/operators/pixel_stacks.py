"""The kernels and features of `pixels` for many pictures at a time.

A stack has the shape rows x columns x 3 x pictures: the pictures lie innermost, so a shift of all of them is one run of
memory, and an operation of numpy costs its call once for a stack. Each picture's random numbers are those that its own
generator gives `pixels.KERNELS`.
"""
from __future__ import annotations

import numpy as np

#: Pictures of a stack.
STACK = 64
_GRAY = np.array([0.299, 0.587, 0.114])


class Draws:
    """Random numbers of each picture from its own seed; every kernel starts its generator anew."""

    def __init__(self, seeds: np.ndarray, side: int) -> None:
        self.made = [np.random.default_rng(int(s)) for s in seeds]
        self.start = [g.bit_generator.state for g in self.made]
        self.side, self._normal = side, None
        self.uniform = np.stack([g.random(2 * side * side) for g in self.made], axis=-1)

    def generators(self):
        for g, s in zip(self.made, self.start, strict=True):
            g.bit_generator.state = s
            yield g

    def normal(self) -> np.ndarray:
        """side * side * 3 x pictures."""
        if self._normal is None:
            self._normal = np.ascontiguousarray(np.stack([g.standard_normal(3 * self.side**2) for g in self.generators()]).T)
        return self._normal


def pictures(ids: np.ndarray, side: int) -> np.ndarray:
    """A stack of waves, those of `pixels.pictures`."""
    f = np.stack([np.random.default_rng(int(i)).uniform(1, 9, (3, 2)) for i in ids], axis=-1)
    at = np.arange(side) / side
    rows, columns = f[None, :, 0] * at[:, None, None] * 6, f[None, :, 1] * at[:, None, None] * 6
    return np.clip(127 + 100 * np.sin(rows[:, None] + columns[None]), 0, 255)


def _smear(side: int, sigma: float) -> np.ndarray:
    """The matrix of a blur along one axis with mirrored edges."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    at, out = np.pad(np.arange(side), r, mode="reflect"), np.zeros((side, side))
    for i in range(side):
        np.add.at(out[i], at[i : i + 2 * r + 1], k / k.sum())
    return out


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    n, m = len(x), _smear(len(x), sigma)
    down = (m @ x.reshape(n, -1)).reshape(n, n, -1)
    return (m @ down).reshape(x.shape)


def _padded(x: np.ndarray, r: int, mode: str) -> np.ndarray:
    at = np.pad(np.arange(len(x)), r, mode=mode)
    return x[at][:, at]


def disc(x: np.ndarray, radius: int) -> np.ndarray:
    """Runs of each row of the disc are differences of running sums."""
    n, p = len(x), _padded(x, radius, "reflect")
    upto = np.concatenate([np.zeros_like(p[:, :1]), np.cumsum(p, axis=1)], axis=1)
    out, count = np.zeros_like(x), 0
    for dy in range(-radius, radius + 1):
        half = int(np.floor(np.sqrt(radius**2 - dy**2) + 1e-9))
        rows = upto[radius + dy : radius + dy + n]
        out += rows[:, radius + half + 1 : radius + half + 1 + n] - rows[:, radius - half : radius - half + n]
        count += 2 * half + 1
    return out / count


def motion(x: np.ndarray, length: int, d: Draws) -> np.ndarray:
    n, out, t = len(x), np.empty_like(x), np.linspace(-length / 2, length / 2, length)
    p = np.ascontiguousarray(np.moveaxis(_padded(x, length, "reflect"), -1, 0))
    for j, a in enumerate(np.pi * d.uniform[0]):
        shifts = zip(np.round(t * np.sin(a)).astype(int), np.round(t * np.cos(a)).astype(int), strict=True)
        out[..., j] = sum(p[j, length + dy : length + dy + n, length + dx : length + dx + n] for dy, dx in shifts) / length
    return out


def _greatest(x: np.ndarray, size: int, larger) -> np.ndarray:
    """The greatest (or least) of each square of size x size, by doubling runs."""
    for axis in (0, 1):
        x, run = np.moveaxis(x, axis, 0), 1
        while 2 * run <= size:
            x, run = larger(x[: len(x) - run], x[run:]), 2 * run
        rest = size - run
        x = np.moveaxis(larger(x[: len(x) - rest], x[rest:]) if rest else x, 0, axis)
    return x


def gray(x: np.ndarray) -> np.ndarray:
    return x[:, :, 0] * _GRAY[0] + x[:, :, 1] * _GRAY[1] + x[:, :, 2] * _GRAY[2]


def spread_colour(x: np.ndarray, size: int) -> np.ndarray:
    y, r = gray(x)[:, :, None], size // 2
    p = _padded(x - y, r, "edge")
    high, low = _greatest(p, 2 * r + 1, np.maximum), _greatest(p, 2 * r + 1, np.minimum)
    return y + np.where(np.abs(high) >= np.abs(low), high, low)


def median(x: np.ndarray, size: int) -> np.ndarray:
    """Exact: a plane's values become their places in its order, and each square's middle place is found bit by bit."""
    n, r = len(x), size // 2
    flat = np.ascontiguousarray(x.reshape(n * n, -1).T)
    order = np.argsort(flat, axis=1)
    place = np.empty(order.shape, np.int16)
    np.put_along_axis(place, order, np.arange(n * n, dtype=np.int16)[None], axis=1)
    p = _padded(np.ascontiguousarray(place.T).reshape(n, n, -1), r, "edge")
    half, low = (2 * r + 1) ** 2 // 2, np.zeros((n, n, p.shape[2]), np.int16)
    kind = np.uint8 if (2 * r + 1) ** 2 < 256 else np.uint16
    below, count = np.empty(low.shape, bool), np.empty(low.shape, kind)
    for bit in range((n * n - 1).bit_length() - 1, -1, -1):
        tried = low + np.int16(1 << bit)
        count[:] = 0
        for dy in range(2 * r + 1):
            for dx in range(2 * r + 1):
                np.less(p[dy : dy + n, dx : dx + n], tried, out=below)
                np.add(count, below.view(np.uint8), out=count)
        np.copyto(low, tried, where=count <= half)
    at = np.take_along_axis(order, np.ascontiguousarray(low.reshape(n * n, -1).T), axis=1)
    return np.ascontiguousarray(np.take_along_axis(flat, at, axis=1).T).reshape(x.shape)


def impulse(x: np.ndarray, p: float, d: Draws) -> np.ndarray:
    u = d.uniform[: len(x) ** 2].reshape(len(x), len(x), 1, -1)
    return np.where(u < p / 2, 0.0, np.where(u > 1 - p / 2, 255.0, x))


def jitter(x: np.ndarray, amount: float, d: Draws) -> np.ndarray:
    n, pictures_ = len(x), np.arange(x.shape[-1])
    y, z = np.clip(np.mgrid[0:n, 0:n][..., None] + (-amount + 2 * amount * d.uniform.reshape(2, n, n, -1)), 0, n - 1)
    y0, z0 = np.minimum(y.astype(int), n - 2), np.minimum(z.astype(int), n - 2)
    fy, fz = (y - y0)[:, :, None], (z - z0)[:, :, None]
    flat, first = np.moveaxis(x, 2, 0).reshape(3, -1), (y0 * n + z0) * len(pictures_) + pictures_
    down, right = n * len(pictures_), len(pictures_)
    at = lambda by: np.moveaxis(flat[:, (first + by).ravel()].reshape(3, n, n, -1), 0, 2)
    return (1 - fy) * ((1 - fz) * at(0) + fz * at(right)) + fy * ((1 - fz) * at(down) + fz * at(down + right))


def patches(x: np.ndarray, size: int, count: int, d: Draws) -> np.ndarray:
    size = min(size, len(x) // 2)
    n = len(x) - size
    low, high = np.tile([0, 0, -size, -size], count), np.tile([n + 1, n + 1, size + 1, size + 1], count)
    own = np.ascontiguousarray(np.moveaxis(x, -1, 0))
    out = own.copy()
    for source, target, g in zip(own, out, d.generators(), strict=True):
        at = g.integers(low, high).reshape(count, 4)  # as pairs drawn one after the other
        to = np.clip(at[:, :2] + at[:, 2:], 0, n)
        for (y, z), (ty, tz) in zip(at[:, :2].tolist(), to.tolist(), strict=True):
            target[ty : ty + size, tz : tz + size] = source[y : y + size, z : z + size]
    return np.moveaxis(out, 0, -1)


def coloured(x: np.ndarray, size: int, count: int, d: Draws) -> np.ndarray:
    size = min(size, len(x) - 1)
    out = np.moveaxis(x, -1, 0).copy()  # of one picture, ascontiguousarray would be x itself
    for target, g in zip(out, d.generators(), strict=True):
        for _ in range(count):
            y, z = g.integers(0, len(x) - size, 2)
            target[y : y + size, z : z + size] = g.uniform(0, 255, 3)
    return np.moveaxis(out, 0, -1)


def _saturated(x: np.ndarray, v: float) -> np.ndarray:
    y = gray(x)[:, :, None]
    return y + v * (x - y)


def _noise(x: np.ndarray, v: float, d: Draws) -> np.ndarray:
    return v * d.normal().reshape(x.shape)


def _contrast(x: np.ndarray, v: float) -> np.ndarray:
    mean = gray(x).mean(axis=(0, 1))
    return mean + v * (x - mean)


#: name -> (stack, parameter, draws) -> stack before clipping
KERNELS = {
    "gaussian_blur": lambda x, v, d: blur(x, v),
    "lens_blur": lambda x, v, d: disc(x, v),
    "motion_blur": motion,
    "color_diffusion": lambda x, v, d: spread_colour(x, v),
    "color_shift": lambda x, v, d: np.stack([np.roll(x[:, :, 0], v, 1), x[:, :, 1], np.roll(x[:, :, 2], -v, 1)], axis=2),
    "color_saturation_up": lambda x, v, d: _saturated(x, v),
    "color_saturation_down": lambda x, v, d: _saturated(x, v),
    "white_noise": lambda x, v, d: x + v * d.normal()[: len(x) ** 2].reshape(len(x), len(x), 1, -1),
    "color_noise": lambda x, v, d: x + _noise(x, v, d),
    "impulse_noise": impulse,
    "multiplicative_noise": lambda x, v, d: x * (1 + _noise(x, v, d)),
    "denoise": lambda x, v, d: blur(median(x, v), 0.8),
    "brighten": lambda x, v, d: x * v,
    "darken": lambda x, v, d: x * v,
    "mean_shift": lambda x, v, d: x + v,
    "jitter": jitter,
    "patch_shuffle": lambda x, v, d: patches(x, *v, d),
    "pixelate": lambda x, v, d: x[_squares(len(x), v)][:, _squares(len(x), v)],
    "quantization": lambda x, v, d: np.floor(x / 2 ** (8 - v)) * 2 ** (8 - v),
    "color_block": lambda x, v, d: coloured(x, *v, d),
    "sharpen": lambda x, v, d: x + v * (x - blur(x, 2.0)),
    "contrast_change": lambda x, v, d: _contrast(x, v),
    "ladder_blur": lambda x, v, d: blur(x, v) if v else x,
    "ladder_noise": lambda x, v, d: x + _noise(x, v, d) if v else x,
    "ladder_exposure": lambda x, v, d: x * v,
}


def _squares(n: int, size: int) -> np.ndarray:
    return np.minimum(np.arange(n) // size * size + size // 2, n - 1)


def degrade(x: np.ndarray, kernel: str, value, d: Draws) -> np.ndarray:
    return np.clip(KERNELS[kernel](x, value, d), 0, 255)


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each picture (of the last axis)."""
    flat = x.reshape(-1, x.shape[-1])
    mean = flat.mean(axis=0)
    d = flat - mean
    return mean, np.sqrt(np.einsum("in,in->n", d, d) / len(flat))


def _sobel(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, e = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return d[:-2] + 2 * d[1:-1] + d[2:], e[:, :-2] + 2 * e[:, 1:-1] + e[:, 2:]


def _box_mean(g: np.ndarray, size: int = 8) -> np.ndarray:
    n, at = len(g), np.pad(np.arange(len(g)), (size // 2, size - size // 2 - 1), mode="symmetric")
    g = g[at]
    g = sum(g[i : i + n] for i in range(size))[:, at]
    return sum(g[:, i : i + n] for i in range(size)) / size**2


def _steps(g: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.abs(np.diff(g, axis=axis)).mean(axis=1 - axis)
    border = np.arange(1, len(d) + 1) % 8 == 0
    return (d[border].mean(axis=0) if border.any() else 0.0), (d[~border].mean(axis=0) if (~border).any() else 0.0)


def features(x: np.ndarray) -> dict[str, np.ndarray]:
    """The 29 features of `pixels.features`, of each picture of a stack."""
    g = np.round(gray(x))
    n, m = len(g), x.shape[-1]
    p = _padded(g, 1, "edge")  # of one row, mirrored edges are the same
    laplacian = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var(axis=(0, 1))  # often an exact tie of its rounding
    gx, gy = _sobel(p)
    square = gx * gx + gy * gy
    slope = np.sqrt(square)
    slope_mean, slope_std = moments(slope)
    g_mean, g_std = moments(g)
    spectrum = np.fft.fft2(g - g_mean, axes=(0, 1))
    power = spectrum.real**2 + spectrum.imag**2
    at = np.arange(n) - n / 2
    far = np.fft.ifftshift(np.hypot(at[:, None], at[None]) > 0.25 * n / 2)
    second = p[:, :-2] - 2 * p[:, 1:-1] + p[:, 2:]
    residue = (second[:-2] - 2 * second[1:-1] + second[2:])[1:-1, 1:-1]
    noise = np.sqrt(np.pi / 2) * np.abs(residue).sum(axis=(0, 1)) / (6 * (n - 2) ** 2)
    (col, col_in), (row, row_in) = _steps(g, 1), _steps(g, 0)
    flat = np.ascontiguousarray(g.reshape(n * n, m).T)
    p1, p5, p50, p95, p99 = np.percentile(np.sort(flat, axis=1), [1, 5, 50, 95, 99], axis=1)
    red, green, blue = x[:, :, 0], x[:, :, 1], x[:, :, 2]
    top, low = np.maximum(np.maximum(red, green), blue), np.minimum(np.minimum(red, green), blue)
    saturation = np.floor(255 * np.divide(top - low, top, out=np.zeros_like(top), where=top > 0)) / 255
    sat_mean, sat_std = moments(saturation)
    (rg_mean, rg_std), (yb_mean, yb_std) = moments(red - green), moments((red + green) / 2 - blue)
    local = g - _box_mean(g)
    owner = np.arange(m)
    share = np.bincount((flat.astype(np.int64) + 256 * owner[:, None]).ravel(), minlength=256 * m).reshape(m, 256) / (n * n)
    coarse = (x // 16).astype(np.int64)
    colours = np.bincount(((coarse[:, :, 0] * 16 + coarse[:, :, 1]) * 16 + coarse[:, :, 2] + 4096 * owner).ravel(), minlength=4096 * m).reshape(m, 4096)
    tenengrad = square.mean(axis=(0, 1))
    return {
        "lap_var": laplacian, "lap_var_log": np.log1p(laplacian), "tenengrad": tenengrad, "tenengrad_log": np.log1p(tenengrad),
        "edge_mean_mag": slope_mean, "edge_density": (slope > slope_mean + slope_std).mean(axis=(0, 1)), "hf_energy_ratio": power[far].sum(axis=0) / (power.sum(axis=(0, 1)) + 1e-12),
        "noise_sigma": noise, "noise_sigma_log": np.log1p(noise), "blockiness_col": col - col_in, "blockiness_row": row - row_in, "blockiness_mean": (col - col_in + row - row_in) / 2,
        "blockiness_ratio": (col + row) / (col_in + row_in + 1e-6), "lum_mean": g_mean, "lum_std": g_std, "lum_p5": p5, "lum_p50": p50, "lum_p95": p95,
        "clip_low_frac": (g <= 2).mean(axis=(0, 1)), "clip_high_frac": (g >= 253).mean(axis=(0, 1)), "sat_mean": sat_mean, "sat_std": sat_std,
        "colourfulness": np.hypot(rg_std, yb_std) + 0.3 * np.hypot(rg_mean, yb_mean), "local_contrast_mean": np.abs(local).mean(axis=(0, 1)), "local_contrast_std": moments(local)[1],
        "rms_contrast": g_std / (g_mean + 1e-6), "michelson_contrast": (p99 - p1) / (p99 + p1 + 1e-6),
        "unique_color_ratio": (colours > 0).sum(axis=1) / (n * n), "gray_entropy": -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1),
    }
