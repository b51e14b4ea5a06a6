"""Readouts corrected by pools of unlabelled rows, judged over many draws of pools, even and skewed ones.

A pool's mean (and deviation) of each position of the logits is taken off every row that is judged. Pools are drawn without
replacement: every row has a hashed number for each draw, and those with the smallest of each stratum are taken. Numbers
that are far too large for the size of their stratum are left out at once, so what is sorted is little more than the pools;
a pool that comes out short by that is drawn from all rows. All draws of all settings go in one pass.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.sources.scratch import FEW_ROWS, cut

#: Even pools of so many rows, draws of each; skewed pools, their share of one level, and draws for each level (fixed values).
SIZES, DRAWS = (16, 32, 64), 20
SKEWED, SHARE, SKEWED_DRAWS = 100, 0.7, 5
#: How many deviations above the wanted number a hashed number may lie to be looked at: it sets the work, not the result.
SLACK = 10
#: Judged rows of a unit that a task takes at a time, and those whose logits are corrected together.
PART, CHUNK = 50_000, 2048


def hashed(deal: Column, tie: Column) -> Column:
    """A number in [0, 1) of a row and a deal."""
    return F.pmod(F.xxhash64(deal, tie), F.lit(1 << 53)) / F.lit(float(1 << 53))


def plan(levels: int) -> list[tuple[str, int, int | None, int, int]]:
    """(setting, draw, level or None, rows of the level or of all, rows of the other levels)."""
    even = [(f"even_{n}", d, None, n, 0) for n in SIZES for d in range(DRAWS)]
    own = int(SHARE * SKEWED)
    return even + [("skewed", k * SKEWED_DRAWS + d, k, own, SKEWED - own) for k in range(levels) for d in range(SKEWED_DRAWS)]


def pools(rows: DataFrame, unit: str, tie: str, levels: int, key: Callable[[Column, Column], Column] = hashed) -> DataFrame:
    """unit, setting, draw, tie, x of the rows in each pool; x and level are columns of rows. A pool that cannot be filled is left out."""
    wanted = F.array(*(F.struct(F.lit(i).alias("deal"), F.lit(s).alias("setting"), F.lit(d).alias("draw"), F.lit(k).cast("int").alias("skew"), F.lit(n).alias("n"), F.lit(m).alias("rest")) for i, (s, d, k, n, m) in enumerate(plan(levels))))
    counts = rows.groupBy(unit, "level").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(F.col(unit).alias("_u")).agg(F.map_from_entries(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "c")))).alias("of"), F.sum("c").alias("all"))  # a row for each unit
    sized = rows.select(unit, tie, "x", "level").join(F.broadcast(sizes) if sizes.count() <= FEW_ROWS else sizes, F.col(unit).eqNullSafe(F.col("_u")))
    each = sized.select(unit, tie, "x", "level", "of", "all", F.explode(wanted).alias("p")).select(unit, tie, "x", "level", "of", "all", "p.*")
    own = F.coalesce(F.col("level") == F.col("skew"), F.col("skew").isNull())
    of_level = F.coalesce(F.get(F.map_values(F.map_filter("of", lambda k, _: k == F.col("skew"))), F.lit(0)), F.lit(0))
    stratum = F.when(F.col("skew").isNull(), F.col("all")).when(own, of_level).otherwise(F.col("all") - of_level)
    each = each.withColumns({"own": own, "quota": F.when(own, F.col("n")).otherwise(F.col("rest")), "stratum": stratum, "key": key(F.col("deal"), F.col(tie))}).filter("quota > 0 and stratum >= quota")
    strata = [unit, "setting", "draw", "own"]
    few = each.filter(F.col("key") * F.col("stratum") < F.col("quota") + SLACK * F.sqrt("quota") + SLACK)
    first = F.row_number().over(Window.partitionBy(*strata).orderBy("key", tie))
    cut_ = lambda d: d.withColumn("r", first).filter("r <= quota").select(*strata, tie, "x", "n", "rest", "quota")
    taken = cut(cut_(few))
    full = taken.groupBy(*(F.col(c).alias(f"_{c}") for c in strata), "quota").agg(F.count("*").alias("got")).filter("got = quota")
    every = counts.select(unit).distinct().select(unit, F.explode(wanted).alias("p")).select(unit, "p.*").select(unit, "setting", "draw", F.inline(F.array(F.struct(F.lit(True).alias("own"), F.col("n").alias("quota")), F.struct(F.lit(False).alias("own"), F.col("rest").alias("quota"))))).filter("quota > 0")
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    short = cut(every.join(full.drop("quota"), same, "left_anti").select(*(F.col(c).alias(f"_{c}") for c in strata)))
    if not short.isEmpty():  # too small a stratum, or (hardly ever) too few small numbers
        taken = taken.join(short, same, "left_anti").unionByName(cut_(each.join(F.broadcast(short) if short.count() <= FEW_ROWS else short, same, "left_semi")))
    filled = F.count("*").over(Window.partitionBy(unit, "setting", "draw"))  # at most a pool
    return taken.withColumn("size", filled).filter(F.col("size") == F.col("n") + F.col("rest")).select(unit, "setting", "draw", tie, "x")


def corrections(rows: DataFrame, unit: str, tie: str, levels: int, key=hashed) -> DataFrame:
    """unit, setting, draw, mean, std: those of every pool, and of all rows (setting 'all')."""
    drawn = pools(rows, unit, tie, levels, key).unionByName(rows.select(unit, F.lit("all").alias("setting"), F.lit(0).alias("draw"), tie, "x"))
    flat = drawn.select(unit, "setting", "draw", F.posexplode("x").alias("i", "v")).groupBy(unit, "setting", "draw", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    per = flat.groupBy(unit, "setting", "draw").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("p"))
    return per.select(unit, "setting", "draw", F.col("p.m").alias("mean"), F.transform("p.s", lambda s: s + 1e-6).alias("std"))


def _judge(rows: pa.Table, dealt: pa.Table, levels: int, members: int) -> Iterator[tuple]:
    """variant, setting, draw, rows, and their sums of hits, of distances and of hits within one, for each correction of a unit."""
    width = levels * members
    rows = rows.filter(pc.and_(pc.is_valid(rows["level"]), pc.is_valid(rows["x"])))
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) != len(rows) * width:
        raise ValueError(f"x must have {width} numbers")
    x, y = x.reshape(-1, members, levels), rows["level"].to_numpy()
    given = ~np.isnan(x).any(axis=(1, 2))
    x, y = x[given].transpose(1, 2, 0), y[given]
    many = [("raw", "none", 0, np.zeros((members, levels)), np.ones((members, levels)))]
    for r in dealt.to_pylist():
        mean, std = (np.array(r[c]).reshape(members, levels) for c in ("mean", "std"))
        many += [("centred", r["setting"], r["draw"], mean, np.ones_like(std)), ("scaled", r["setting"], r["draw"], mean, std)]
    sums = np.zeros((len(many), 3))
    for at in range(0, len(y), CHUNK):
        own, label = np.ascontiguousarray(x[:, :, at : at + CHUNK]), y[at : at + CHUNK]
        for i, (variant, _, _, mean, std) in enumerate(many):
            z = own if variant == "raw" else own - mean[:, :, None]
            z = (z / std[:, :, None] if variant == "scaled" else z).sum(axis=0) / members
            z = np.rint(z * 1e9)  # so that no tie hangs on the order in which a pool was summed
            top, best = z.max(axis=0), np.full(len(label), levels - 1)
            for k in range(levels - 2, -1, -1):
                best[z[k] == top] = k
            e = np.exp((z - top) * 1e-9)
            off, far = np.abs(np.arange(levels) @ e / e.sum(axis=0) - label), np.abs(best - label)
            sums[i] += (far == 0).sum(), off.sum(), (far <= 1).sum()
    for (variant, setting, draw, _, _), (hit, off, near) in zip(many, sums.tolist(), strict=True):
        yield variant, setting, draw, len(y), hit, off, near


def tables(pool: DataFrame, judged: DataFrame, unit: str, tie: str, levels: int, members: int, key=hashed) -> DataFrame:
    """unit, variant (raw; centred; scaled), setting, draws, accuracy, mae, within_one, and gain over raw, of the judged rows.

    pool and judged: unit, tie, level and x, the logits of all members, one after the other. Labels of the pool only skew it.
    """
    n = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are narrow and deals cost time: spread the rows
    found = cut(corrections(pool.repartition(n, tie), unit, tie, levels, key))
    sizes = cut(judged.groupBy(F.col(unit).alias("_u")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    if sizes.count() <= FEW_ROWS:
        sizes = F.broadcast(sizes)
    same = F.col(unit).eqNullSafe(F.col("_u"))
    # parts of a unit's rows, each beside the unit's corrections: as many as plan has
    rows = judged.select(unit, tie, "level", "x").join(sizes, same).select(unit, F.pmod(F.xxhash64(tie), "parts").cast("int").alias("part"), "level", "x")
    dealt = found.filter(F.col(unit).isNotNull()).join(sizes, same).select(unit, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "setting", "draw", "mean", "std")
    kind = judged.schema[unit].dataType
    schema = f"`{unit}` {kind.simpleString()}, variant string, setting string, draw int, n long, hit double, off double, near double"

    def run(of: tuple, rows: pa.Table, dealt: pa.Table) -> pa.Table:
        made = list(_judge(rows, dealt, levels, members))
        columns = [pa.array([of[0].as_py()] * len(made), rows.schema.field(unit).type), *(pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 3), strict=True))]
        return pa.table(columns, names=[unit, "variant", "setting", "draw", "n", "hit", "off", "near"])

    sums = rows.groupBy(unit, "part").cogroup(dealt.groupBy(unit, "part")).applyInArrow(run, schema)
    per = sums.groupBy(unit, "variant", "setting", "draw").agg(*(F.try_divide(F.sum(c), F.sum("n")).alias(c) for c in ("hit", "off", "near")))
    tables_ = per.groupBy(unit, "variant", "setting").agg(F.count("*").alias("draws"), F.avg("hit").alias("accuracy"), F.avg("off").alias("mae"), F.avg("near").alias("within_one"))
    raw = F.max(F.when(F.col("variant") == "raw", F.col("accuracy"))).over(Window.partitionBy(unit))  # a row for each setting
    return tables_.withColumn("gain", F.col("accuracy") - raw)
