"""Fits with several parameters by Newton's method on every row of every group.

Rows are packed once into blocks of one group. Each round tasks sum loss, gradient and Hessian of their blocks by group,
Spark adds the tasks' sums, and the driver takes a step for each group: it holds a group's parameters and never its rows. Groups (suites, scales, folds)
are few by nature. All objectives are convex, so steps are only shortened where the loss rises, and bounds hold by
leaving out the parameters that press against them.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a temperature's logarithm and of a sharpness' logarithm; no bias or weight goes beyond FAR.
LOG_T, LOG_S, FAR = (-5.0, 7.0), (-3.0, 3.0), 60.0
#: Rows of a block, which are turned into a design at a time, and bytes that close it earlier.
CHUNK, BLOCK_BYTES = 4096, 4 << 20
#: Blocks that a task gets, where there are not more than the partitions of a shuffle hold.
BLOCKS = 8
Arrays = dict[str, np.ndarray]


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Softmax:
    """softmax(design @ w): design gives rows x classes x parameters of a group; the loss is the NLL of y."""

    design: Callable[[object, Arrays], np.ndarray]

    def sums(self, unit, rows: Arrays, w: np.ndarray):
        y, phi = rows["y"], self.design(unit, rows)
        logp = log_softmax(phi @ w)
        p, n = np.exp(logp), np.arange(len(y))
        mean = np.einsum("nk,nkd->nd", p, phi)
        return -logp[n, y].sum(), (mean - phi[n, y]).sum(axis=0), np.einsum("nk,nkd,nke->de", p, phi, phi, optimize=True) - mean.T @ mean


@dataclass
class Matrix:
    """softmax(W x + b) on standardized features; w is W (classes x features), row by row, then b."""

    classes: int
    pools: dict = field(default_factory=dict)

    def features(self, unit, rows: Arrays) -> np.ndarray:
        mean, std = self.pools[unit]
        return (rows["z"] - mean) / std

    def sums(self, unit, rows: Arrays, w: np.ndarray):
        k, y = self.classes, rows["y"]
        x = np.c_[self.features(unit, rows), np.ones(len(y))]
        f = x.shape[1]
        order = np.arange(k * f).reshape(k, f)
        order = np.r_[order[:, :-1].ravel(), order[:, -1]]
        flat = np.empty(k * f)
        flat[order] = w
        logp = log_softmax(x @ flat.reshape(k, f).T)
        p = np.exp(logp)
        g = ((p - np.eye(k)[y]).T @ x).ravel()
        q = (p[:, :, None] * x[:, None, :]).reshape(len(y), k * f)
        h, own = -(q.T @ q).reshape(k, f, k, f), (q.T @ x).reshape(k, f, f)
        for a in range(k):
            h[a, :, a] += own[a]
        return -logp[np.arange(len(y)), y].sum(), g[order], h.reshape(k * f, k * f)[np.ix_(order, order)]


class Ordinal:
    """P(y >= j) = sigmoid(slope * s - cut_j); w is the slope and the rising cuts."""

    def sums(self, unit, rows: Arrays, w: np.ndarray):
        s, y, d = rows["s"], rows["y"], len(w)
        if (np.diff(w[1:]) <= 0).any():
            return np.inf, np.zeros(d), np.zeros((d, d))
        ends = np.r_[-np.inf, w[1:], np.inf]
        loss, g, h = 0.0, np.zeros(d), np.zeros((d, d))
        for j in range(d):  # a level at a time: its rows have two of the cuts
            own = s[y == j]
            if not len(own):
                continue
            up, low = w[0] * own - ends[j], w[0] * own - ends[j + 1]
            su, sl = (1 / (1 + np.exp(-np.clip(v, -700, 700))) for v in (up, low))
            # log(sigmoid(up) - sigmoid(low)) without cancellation
            gap = -np.expm1(np.maximum(low - up, -700)) if np.isfinite(ends[j]) and np.isfinite(ends[j + 1]) else np.ones(len(own))
            p = np.maximum(su * (1 - sl) * gap, 1e-300)
            loss -= np.log(p).sum()
            du, dl = su * (1 - su), sl * (1 - sl)
            gu, gl = -du / p, dl / p
            huu = (du / p) ** 2 - du * (1 - 2 * su) / p
            hll = (dl / p) ** 2 + dl * (1 - 2 * sl) / p
            hul = -du * dl / p**2
            for at, dv in ((j, gu), (j + 1, gl)):
                if 1 <= at < d:
                    g[at] -= dv.sum()
            g[0] += (gu * own + gl * own).sum()
            h[0, 0] += ((huu + hll + 2 * hul) * own**2).sum()
            for at, own_h, other in ((j, huu, hul), (j + 1, hll, hul)):
                if 1 <= at < d:
                    h[at, at] += own_h.sum()
                    h[0, at] -= ((own_h + other) * own).sum()
            if 1 <= j and j + 1 < d:
                h[j, j + 1] += hul.sum()
                h[j + 1, j] += hul.sum()
        h[1:, 0] = h[0, 1:]
        return loss, g, h


@dataclass
class Fit:
    w: np.ndarray
    loss: float  # mean of the rows, with the penalty
    n: int


def _arrays(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, Arrays]]:
    """The rows of each unit of a batch, in pieces, with list columns as matrices."""
    codes = batch.column(key).dictionary_encode()
    names, code = codes.dictionary.to_pylist(), codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
    columns = {}
    for name in batch.schema.names:
        if name == key:
            continue
        c = batch.column(name)
        if pa.types.is_list(c.type):
            columns[name] = (c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy())
        else:
            columns[name] = (c.to_numpy(zero_copy_only=False), None)
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order])) + 1
    for own in np.split(order, edges):
        for at in range(0, len(own), CHUNK):
            rows = own[at : at + CHUNK]
            if len(rows):
                unit = names[code[rows[0]]] if code[rows[0]] < len(names) else None
                yield unit, {k: v[rows] if o is None else v[o[rows][:, None] + np.arange(o[rows[0] + 1] - o[rows[0]])] for k, (v, o) in columns.items()}


def _pack(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """A row for each block: its unit and its columns as arrays."""
    held: dict = {}

    def block(unit) -> pa.RecordBatch:
        parts = held.pop(unit)[0]
        columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        return pa.RecordBatch.from_arrays([pa.array([unit], kind), pa.array([pickle.dumps(columns, 5)], pa.binary())], names=[key, "block"])

    for batch in batches:
        kind = batch.schema.field(key).type
        for unit, rows in _arrays(batch, key):
            own = held.setdefault(unit, [[], 0, 0])
            own[0].append(rows)
            own[1] += len(next(iter(rows.values())))
            own[2] += sum(v.nbytes for v in rows.values())
            if own[1] >= CHUNK or own[2] >= BLOCK_BYTES:
                yield block(unit)
        if sum(own[2] for own in held.values()) > 16 * BLOCK_BYTES:  # many units
            for unit in list(held):
                yield block(unit)
    for unit in list(held):
        yield block(unit)


class Blocks:
    """The rows of fits, packed by unit, spread and kept: a round moves a few large values instead of rows.

    df has the key and the models' columns; it is read twice. units: unit -> rows.
    """

    def __init__(self, df: DataFrame, key: str) -> None:
        conf = df.sparkSession.conf
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
        self.units = {r[0]: r[1] for r in df.groupBy(key).agg(F.count("*").alias("n")).collect()}
        parts = min(int(conf.get("spark.sql.shuffle.partitions")), 1 + sum(self.units.values()) // (BLOCKS * CHUNK))
        packed = df.mapInArrow(lambda batches: _pack(batches, key), f"`{key}` {df.schema[key].dataType.simpleString()}, block binary")
        self.df = packed.repartition(parts).persist()

    def sums(self, names: Iterable, each: Callable[[object, Arrays], Iterable[tuple[object, np.ndarray]]]) -> dict:
        """name -> the sum of all vectors that each(unit, rows) gives under that name."""
        names = list(names)
        place = {name: i for i, name in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for batch in batches:
                for unit, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for name, v in each(unit, pickle.loads(block.as_buffer())):
                        total[name] = total[name] + v if name in total else v
            for name, v in total.items():
                columns = [np.full(len(v), place[name], np.int32), np.arange(len(v), dtype=np.int32), np.asarray(v, float)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "i", "v"])

        found = self.df.mapInArrow(run, "name int, i int, v double").groupBy("name", "i").agg(F.sum("v").alias("v")).toArrow()
        name, i, v = (found.column(c).to_numpy() for c in ("name", "i", "v"))
        out = {}
        for at in np.unique(name):
            own = name == at
            out[names[at]] = v[own][np.argsort(i[own])]
        return out


@contextmanager
def packed(df: DataFrame | Blocks, key: str) -> Iterator[Blocks]:
    """The blocks of df, given up at the end; blocks that the caller has stay the caller's."""
    if isinstance(df, Blocks):
        yield df
        return
    blocks = Blocks(df, key)
    try:
        yield blocks
    finally:
        blocks.df.unpersist()


Parts = Callable[[object, Arrays], Iterable[tuple[object, Arrays]]]


def _whole(unit, rows: Arrays):
    yield unit, rows


def _round(blocks: Blocks, model, at: dict, parts: Parts) -> dict:
    """name -> (n, loss, gradient, Hessian), summed over all rows."""

    def each(unit, rows):
        for name, own in parts(unit, rows):
            if name in at and len(own["y"]):
                loss, g, h = model.sums(name, own, at[name])
                yield name, np.r_[len(own["y"]), loss, g, h[np.triu_indices(len(g))]]

    out = {}
    for name, v in blocks.sums(at, each).items():
        d = len(at[name])
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = v[2 + d :]
        out[name] = (int(v[0]), v[1], v[2 : 2 + d], h + np.triu(h, 1).T)
    return out


def minimize(df: DataFrame | Blocks, key: str, model, start: dict, ridge: dict | None = None, bounds: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 60, parts: Parts = _whole) -> dict[object, Fit]:
    """unit -> Fit of the least mean loss plus sum(r * (w - c)**2), from the start of each unit.

    df has the key, y and the model's columns. ridge: unit -> (r, c). A unit without rows is left out. parts gives the fits
    that a block's rows take part in, by name, with the rows that each takes; by default all in that of their unit.
    """
    with packed(df, key) as blocks:
        return _descend(blocks, model, start, ridge, bounds, rounds, parts)


def _descend(blocks: Blocks, model, start: dict, ridge: dict | None, bounds, rounds: int, parts: Parts) -> dict[object, Fit]:
    here: dict[object, Fit] = {}
    slope: dict = {}
    trial = {u: np.asarray(w, float) for u, w in start.items()}
    halvings = dict.fromkeys(trial, 0)
    for _ in range(rounds):
        for u, (n, loss, g, h) in _round(blocks, model, trial, parts).items():
            w = trial[u]
            loss, g, h = loss / n, g / n, h / n
            if ridge:
                r, c = ridge[u]
                loss, g, h = loss + (r * (w - c) ** 2).sum(), g + 2 * r * (w - c), h + np.diag(2 * r)
            if u in here and not loss <= here[u].loss + 1e-13 * abs(here[u].loss):
                halvings[u] += 1
                if halvings[u] > 30:
                    trial.pop(u)
                else:
                    trial[u] = _within(here[u].w - slope[u] / 2 ** halvings[u], bounds)
                continue
            here[u], halvings[u] = Fit(w, float(loss), n), 0
            free = np.ones(len(w), bool)
            if bounds is not None:
                free = ~((w <= bounds[0]) & (g > 0) | (w >= bounds[1]) & (g < 0))
            step = np.zeros(len(w))
            if free.any():
                curve = h[np.ix_(free, free)]
                step[free] = np.linalg.lstsq(curve + 1e-12 * np.trace(curve) * np.eye(free.sum()), g[free], rcond=None)[0]
            step *= min(1.0, 8.0 / max(np.abs(step).max(), 1e-300))
            slope[u] = step
            trial[u] = _within(w - step, bounds)
            if np.abs(trial[u] - w).max() < 1e-9 or (g * step).sum() < 1e-18:
                trial.pop(u)
        trial = {u: w for u, w in trial.items() if u in here}
        if not trial:
            break
    return here


def _within(w: np.ndarray, bounds) -> np.ndarray:
    return w if bounds is None else np.clip(w, *bounds)


def _part(key: str, part: Column) -> Column:
    """The name of a part (fold, threshold) of a unit; keys are strings or whole numbers."""
    return F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.lit("\x1f"), part.cast("string"))


def _part_of(unit, part: int) -> str:
    return f"{chr(0) if unit is None else unit}\x1f{part}"


def vector_scaling(df: DataFrame | Blocks, key: str, k: int) -> dict[object, Fit]:
    """softmax((z + bias) / T) of columns z, y: (log T, bias of each level but the first)."""
    unit_biases = np.concatenate([np.zeros((1, k - 1)), np.eye(k - 1)])

    def design(_, rows):
        z = rows["z"] - rows["z"].mean(axis=1, keepdims=True)
        return np.concatenate([z[:, :, None], np.broadcast_to(unit_biases, (len(z), k, k - 1))], axis=2)

    low = np.r_[np.exp(-LOG_T[1]), np.full(k - 1, -FAR)]
    high = np.r_[np.exp(-LOG_T[0]), np.full(k - 1, FAR)]
    with packed(df, key) as blocks:
        found = minimize(blocks, key, Softmax(design), {u: np.r_[1.0, np.zeros(k - 1)] for u in blocks.units}, bounds=(low, high))
    return {u: Fit(np.r_[-np.log(f.w[0]), f.w[1:] / f.w[0]], f.loss, f.n) for u, f in found.items()}


def temperature(df: DataFrame | Blocks, key: str) -> dict[object, Fit]:
    """softmax(z / T) of columns z, y: (log T,)."""
    with packed(df, key) as blocks:
        found = minimize(blocks, key, Softmax(lambda _, rows: rows["z"][:, :, None]), {u: np.ones(1) for u in blocks.units}, bounds=(np.exp(-np.array(LOG_T[1:])), np.exp(-np.array(LOG_T[:1]))))
    return {u: Fit(-np.log(f.w), f.loss, f.n) for u, f in found.items()}


def mix_two(df: DataFrame, key: str) -> dict[object, Fit]:
    """Log probabilities of z and z1 blended, y: (logit of the weight, log T1, log T2).

    Weight and temperatures enter the blend as w / T1 and (1 - w) / T2 only; of all equal fits the one with T1 = T2 is given.
    """
    design = lambda _, rows: np.stack([log_softmax(rows["z"]), log_softmax(rows["z1"])], axis=2)
    with packed(df, key) as blocks:
        found = minimize(blocks, key, Softmax(design), {u: np.full(2, 0.5) for u in blocks.units}, bounds=(np.full(2, 1e-6), np.full(2, np.exp(-LOG_T[0]))))
    return {u: Fit(np.r_[np.log(f.w[0] / f.w[1]), np.full(2, -np.log(f.w.sum()))], f.loss, f.n) for u, f in found.items()}


def ordinal(df: DataFrame, key: str, k: int) -> dict[object, Fit]:
    """Cumulative link of columns s, y: (slope, k - 1 rising cuts)."""
    start = np.r_[1.0, np.arange(k - 1) - (k - 2) / 2]
    bounds = (np.r_[1e-3, np.full(k - 1, -FAR)], np.full(k, FAR))
    with packed(df, key) as blocks:
        return minimize(blocks, key, Ordinal(), {u: start for u in blocks.units}, bounds=bounds)


@dataclass
class MatrixFit:
    w: np.ndarray  # times the sharpness
    b: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    sharpness: float
    n: int

    def logits(self, z: np.ndarray) -> np.ndarray:
        return (z - self.mean) / self.std @ self.w.T + self.b


def _pools(blocks: Blocks, names: list, parts: Parts) -> dict:
    """name -> (mean, population deviation + 1e-6) of each position of z."""
    first = blocks.sums(names, lambda unit, rows: ((name, np.r_[len(own["z"]), own["z"].sum(axis=0)]) for name, own in parts(unit, rows)))
    mean = {name: v[1:] / v[0] for name, v in first.items() if v[0]}
    off = blocks.sums(mean, lambda unit, rows: ((name, ((own["z"] - mean[name]) ** 2).sum(axis=0)) for name, own in parts(unit, rows) if name in mean))
    return {name: (m, np.sqrt(off[name] / first[name][0]) + 1e-6) for name, m in mean.items()}


def level_counts(df: DataFrame, key: str, k: int) -> dict:
    """unit -> rows of each level; an error where a unit has none of a level, or a level out of range."""
    out: dict = {}
    for r in df.groupBy(key, "y").agg(F.count("*").alias("n")).collect():
        if r["y"] is None or not 0 <= r["y"] < k:
            raise ValueError(f"levels must be integers from 0 to {k - 1}; {r[key]!r} has {r['y']!r}")
        out.setdefault(r[key], [0] * k)[r["y"]] = r["n"]
    for unit, counts in out.items():
        if 0 in counts:
            raise ValueError(f"every level needs a labelled example; counts of {unit!r} by level: {counts}")
    return out


def _penalized(blocks: Blocks, names: list, k: int, l2: float, prior: bool, parts: Parts) -> dict[object, MatrixFit]:
    pool = _pools(blocks, names, parts)
    start, ridge = {}, {}
    for u, (mean, std) in pool.items():
        f = len(mean)
        # the prior is the mean of the members' level logits, in standardized units
        average = np.hstack([np.eye(k)] * (f // k)) / (f // k) if prior else np.zeros((k, f))
        centre = np.r_[(average * std).ravel(), average @ mean]
        start[u], ridge[u] = centre, (np.r_[np.full(k * f, l2), np.zeros(k)], centre)
    found = _descend(blocks, Matrix(k, pool), start, ridge, None, 60, parts)
    # the loss leaves the mean of b open and rounding moves it: it stays that of the start
    bias = {u: f.w[-k:] - f.w[-k:].mean() + start[u][-k:].mean() for u, f in found.items()}
    return {u: MatrixFit(f.w[:-k].reshape(k, -1), bias[u], *pool[u], 1.0, f.n) for u, f in found.items()}


def matrix_scaling(df: DataFrame, key: str, k: int, l2: float = 0.05, rescale: str = "train", tie: str | None = None, prior: bool = False) -> dict[object, MatrixFit]:
    """softmax(s (W x' + b)) of columns z, y on standardized z; W and b by penalized NLL, then the sharpness s without penalty.

    rescale: 'train' fits s on the rows of W and b; 'cv' on held-out folds (by a hash of tie; as many as the rarest level
    has rows, five at most; s = 1 with fewer than two); 'none' leaves s at 1. prior: W shrinks towards the mean of the
    members in z instead of zero.
    """
    if rescale not in ("train", "cv", "none"):
        raise ValueError(f"rescale is train, cv or none, not {rescale!r}")
    folds, rows = {}, df.select(key, "z", "y")
    if rescale == "cv":
        folds = {u: n for u, counts in level_counts(df, key, k).items() if (n := min(5, *counts)) > 1}
        n = F.coalesce(*(F.when(F.col(key).eqNullSafe(F.lit(u)), F.lit(n)) for u, n in folds.items())) if folds else F.lit(None).cast("int")
        rows = df.select(key, "z", "y", F.coalesce(F.pmod(F.xxhash64(tie), n), F.lit(-1)).cast("int").alias("fold"))

    def parts(unit, own):
        """The unit's own fit and, in the same pass, those that leave out a fold each."""
        yield unit, own
        for out in range(folds.get(unit, 0)):
            kept = own["fold"] != out
            yield _part_of(unit, out), {c: v[kept] for c, v in own.items()}

    with packed(rows, key) as blocks:
        found = _penalized(blocks, [*blocks.units, *(_part_of(u, out) for u, n in folds.items() for out in range(n))], k, l2, prior, parts)
        made = {u: found[u] for u in blocks.units}
        if rescale == "none":
            return made

        def design(unit, own):
            if rescale == "train":
                return made[unit].logits(own["z"])[:, :, None]
            out = np.empty((len(own["y"]), k, 1))
            for fold in np.unique(own["fold"]):
                at = own["fold"] == fold
                out[at, :, 0] = found[_part_of(unit, fold)].logits(own["z"][at])
            return out

        units = made if rescale == "train" else folds
        sharp = minimize(blocks, key, Softmax(design), {u: np.ones(1) for u in units}, bounds=(np.exp(np.array(LOG_S[:1])), np.exp(np.array(LOG_S[1:]))))
    for u, f in sharp.items():
        s, m = float(f.w[0]), made[u]
        made[u] = MatrixFit(s * m.w, s * m.b, m.mean, m.std, s, m.n)
    return made


def threshold_platt(df: DataFrame, key: str, k: int) -> dict[object, np.ndarray]:
    """P(y >= j) = sigmoid(a_j c_j + b_j) of k - 1 cumulative logits z: unit -> (a, b) of each threshold."""
    design = lambda _, rows: np.stack([np.zeros((len(rows["z"]), 2)), np.c_[rows["z"], np.ones(len(rows["z"]))]], axis=1)
    each = df.select(key, "y", F.posexplode("z").alias("j", "c")).select(_part(key, F.col("j")).alias("unit"), F.array("c").alias("z"), (F.col("y") > F.col("j")).cast("int").alias("y"))
    units = [r[0] for r in df.select(key).distinct().collect()]
    start = {_part_of(u, j): np.array([1.0, 0.0]) for u in units for j in range(k - 1)}
    found = minimize(each, "unit", Softmax(design), start, bounds=(np.full(2, -FAR), np.full(2, FAR)))
    return {u: np.array([found[_part_of(u, j)].w for j in range(k - 1)]) for u in units}


def params_table(spark, key: str, kind: str, found: dict[object, np.ndarray]) -> DataFrame:
    """key, params of a row for each unit."""
    return spark.createDataFrame([(u, np.asarray(p, float).tolist()) for u, p in found.items()], f"`{key}` {kind}, params array<double>")
