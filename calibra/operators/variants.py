"""Quality of many fits on the same rows: every row is scored under each fit of its group by numpy, and sums leave a task, not a row for each fit.

A row that is copied for each fit costs a pass of wide rows for each; here a block of rows meets one fit after the other.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators import metrics
from calibra.operators.ranks import quantile_cuts, running
from calibra.sources.scratch import cut

#: Rows that a task scores at a time, and units whose sums it holds before it passes them on (0.1 MB each).
BLOCK, UNITS = 32_768, 1024
#: Confidences are counted in billionths. Slots of them: one for rows without any, then metrics.RANGES and confidence 1.
FINE, SLOTS = 1e9, metrics.RANGES + 2
#: Stretches of the ids that order equal confidences: they set how many rows are ranked, not the result.
STRETCHES = 1024
#: The units of each group, with log T and the bias of each level but the first.
Fits = dict[str, list[tuple[int, list[float]]]]


def _score(z: np.ndarray, y: np.ndarray, params: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Confidence in billionths, its slot, whether the first largest level is y, and how far the expected level is off.

    z: levels x rows, all NaN for a row without scores or label.
    """
    e = z.copy()
    e[1:] += np.array(params[1:])[:, None]
    top, best = e[0].copy(), np.zeros(len(y), np.int64)
    for j in range(1, len(e)):
        best[e[j] > top] = j
        np.maximum(top, e[j], out=top)
    e -= top
    e /= np.exp(params[0])
    np.exp(e, out=e)
    total, expected = e[0] + e[1], e[1].copy()
    for j in range(2, len(e)):
        total += e[j]
        expected += j * e[j]
    c = np.rint(FINE * (1 / total))
    slot = np.floor(c / FINE * metrics.RANGES)
    none = np.isnan(slot)
    if none.any():
        slot[none], c[none], best[none] = -1, 0, -1
    return c, slot.astype(np.int64) + 1, best == y, np.abs(expected / total - y)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """group, z (levels x rows), y and ids of the rows of a group, from BLOCK rows or so at a time."""
    held: list[pa.RecordBatch] = []

    def made() -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
        t = pa.Table.from_batches(held)
        held.clear()
        group, ids, z = (t[c].combine_chunks() for c in ("grp", "item_id", "z"))
        z = z.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        y = t["y"].fill_null(0).to_numpy()  # without y there is no z
        group = group.dictionary_encode()
        codes = group.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for i, g in enumerate(group.dictionary.to_pylist()):
            own = np.flatnonzero(codes == i)
            yield g, np.ascontiguousarray(z[own].T), y[own], ids.take(pa.array(own))

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            yield from made()
    if held:
        yield from made()


def sums(rows: DataFrame, fits: Fits) -> DataFrame:
    """unit, off, range, n, c, h: what each task has of each unit, in arrays over the ranges of confidence that occur.

    rows: grp, item_id, y, z. c: the sum of confidences in billionths; h: rows that are right; off: the sum over all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}

        def made() -> Iterator[pa.RecordBatch]:
            for unit, (n, c, off) in total.items():
                n = n.reshape(SLOTS, 2)
                at = np.flatnonzero(n.any(axis=1))
                lists = (at.astype(np.int32) - 1, n[at].sum(axis=1), c[at], n[at, 1])
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([off]), *(pa.array([v]) for v in lists)], names=["unit", "off", "_range", "n", "c", "h"])
            total.clear()

        for g, z, y, _ in _blocks(batches):
            for unit, params in fits.get(g, ()):
                if unit not in total and len(total) >= UNITS:
                    yield from made()
                c, slot, right, off = _score(z, y, params)
                t = total.setdefault(unit, [np.zeros(2 * SLOTS, np.int64), np.zeros(SLOTS), 0.0])
                t[0] += np.bincount(2 * slot + right, minlength=2 * SLOTS)
                t[1] += np.bincount(slot, c, SLOTS)
                t[2] += float(np.nansum(off))
        yield from made()

    return rows.select("grp", "item_id", "y", "z").mapInArrow(run, "unit int, off double, _range array<int>, n array<long>, c array<double>, h array<long>")


def _found(rows: DataFrame, fits: Fits, cuts: list[float], schema: str, give: Callable[..., list]) -> DataFrame:
    """The columns that give makes of unit, slot, confidence, stretch of the ids, right and ids of a block of rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, z, y, ids in _blocks(batches):
            stretch = np.searchsorted(cuts, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            for unit, params in fits.get(g, ()):
                c, slot, right, _ = _score(z, y, params)
                made = give(unit, slot, c, stretch, right, ids)
                if made and len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), unit, np.int32)), *map(pa.array, made)], names=names)

    return rows.select("grp", "item_id", "y", "z").mapInArrow(run, schema)


def _cells(rows: DataFrame, fits: Fits, cuts: list[float], ranges: dict[int, list[int]]) -> DataFrame:
    """unit, _range, v, stretch, n, h: rows by confidence (in billionths) and stretch of the ids, in the ranges given for each unit."""
    asked = {u: np.isin(np.arange(SLOTS) - 1, r) for u, r in ranges.items()}
    width = len(cuts) + 1

    def give(unit, slot, c, stretch, right, ids) -> list:
        if unit not in asked:
            return []
        at = np.flatnonzero(asked[unit][slot])
        key, n = np.unique(((np.where(slot[at] > 0, c[at], -1).astype(np.int64) * width) + stretch[at]) * 2 + right[at], return_counts=True)
        v = key // 2 // width
        return [(np.where(v < 0, -1, np.floor(v / FINE * metrics.RANGES))).astype(np.int32), v, (key // 2 % width).astype(np.int32), n, n * (key % 2)]

    made = _found(rows, fits, cuts, "unit int, _range int, v long, stretch int, n long, h long", give)
    return made.groupBy("unit", "_range", "v", "stretch").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))


def _rows_of(rows: DataFrame, fits: Fits, cuts: list[float], cells: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """unit, v, stretch, h, tie: the rows of the cells given for each unit."""
    width = len(cuts) + 1
    asked = {u: np.array([v * width + s for v, s in some]) for u, some in cells.items()}

    def give(unit, slot, c, stretch, right, ids) -> list:
        if unit not in asked:
            return []
        v = np.where(slot > 0, c, -1).astype(np.int64)
        at = np.flatnonzero(np.isin(v * width + stretch, asked[unit]))
        return [v[at], stretch[at].astype(np.int32), right[at].astype(np.int64), ids.take(pa.array(at))]

    return _found(rows, fits, cuts, "unit int, v long, stretch int, h long, tie long", give)


def _by_unit(found: DataFrame, *columns: str) -> dict[int, list]:
    """The columns of a few rows by unit."""
    out: dict[int, list] = {}
    for unit, *values in found.select("unit", *columns).collect():
        out.setdefault(unit, []).append(values[0] if len(values) == 1 else tuple(values))
    return out


def quality(rows: DataFrame, fits: Fits, parts: int) -> DataFrame:
    """unit, accuracy, mae and ece of each fit on the rows of its group, ece as `metrics.ece` with confidences in billionths.

    rows: grp, item_id (a whole number), y, z; they are kept in order of their ids in so many parts, and lost ones are made
    again. Ranges of confidence are counted first. Of a range that a border of bins cuts, each confidence is counted by
    itself, equal ones by stretches of the ids; only rows of the stretches that hold a border are ranked. So the
    rows are shuffled once, as they are, and after that counts, however many rows are equal. The driver sees some numbers
    for each border.
    """
    rows = rows.select("grp", "item_id", "y", "z").repartitionByRange(parts, "item_id").sortWithinPartitions("item_id").persist()
    found = cut(sums(rows, fits))
    per = found.select("unit", F.inline(F.arrays_zip("_range", "n", "c", "h"))).groupBy("unit", "_range").agg(*(F.sum(c).alias(c) for c in ("n", "c", "h")))
    placed = metrics.placed_ranges(cut(per), ["unit"])
    total = placed.groupBy("unit").agg(F.sum("h").alias("h"), F.sum(F.when(F.col("_range") >= 0, F.col("n"))).alias("n"))
    mean = total.join(found.groupBy("unit").agg(F.sum("off").alias("off")), "unit").select("unit", F.try_divide("h", "n").alias("accuracy"), F.try_divide("off", "n").alias("mae"))
    some = lambda there: F.when(there, F.col("n")).otherwise(0).alias("some")
    parts_ = [placed.filter("bin = last").select("unit", "bin", "n", some(F.col("_range") >= 0), "c", "h")]
    borders = placed.filter("bin <> last").select("unit", "_range", "before", "all")
    if ranges := _by_unit(borders, "_range"):
        cuts = quantile_cuts(rows, F.col("item_id").cast("double"), STRETCHES)
        cells = running(_cells(rows, fits, cuts, ranges), ["unit", "_range"], "v", "stretch", {"upto": F.col("n")}).drop("_n", "_rank")
        cells = cells.join(F.broadcast(borders), ["unit", "_range"]).withColumn("before", F.col("before") + F.col("_upto") - F.col("n"))
        cells = cut(cells.withColumns({"bin": metrics.bin_at(F.col("before"), F.col("all")), "last": metrics.bin_at(F.col("before") + F.col("n") - 1, F.col("all"))}))
        shown = ["unit", "bin", "n", some(F.col("v") >= 0), F.when(F.col("v") >= 0, F.col("v") * F.col("n").cast("double")).otherwise(0.0).alias("c"), "h"]
        parts_.append(cells.filter("bin = last").select(*shown))
        held = cells.filter("bin <> last").select("unit", "v", "stretch", "before", "all")
        if few := _by_unit(held, "v", "stretch"):
            place = F.row_number().over(Window.partitionBy("unit", "v", "stretch").orderBy("tie"))  # a stretch of the ids
            ranked = cut(_rows_of(rows, fits, cuts, few)).withColumn("_r", place).join(F.broadcast(held), ["unit", "v", "stretch"])
            ranked = ranked.withColumns({"n": F.lit(1), "bin": metrics.bin_at(F.col("before") + F.col("_r") - 1, F.col("all"))})
            parts_.append(ranked.select(*shown))
    rows.unpersist()
    bins = parts_[0]
    for p in parts_[1:]:
        bins = bins.unionByName(p)
    bins = bins.groupBy("unit", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "some", "c", "h")))
    gap = F.abs(F.try_divide(F.col("c") / FINE, F.col("some")) - F.try_divide(F.col("h"), F.col("some")))
    return mean.join(bins.groupBy("unit").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece")), "unit")
