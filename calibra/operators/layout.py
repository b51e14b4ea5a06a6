"""Layouts of discs without overlap, by rejection sampling: the geometry of the drawn probes, without their pixels.

Each item places its discs, the largest first. A disc takes the first of its tries that keeps its distance from the discs
placed before; if none does, the item starts again with its next attempt. Every number comes from an MD5 of the item, the
attempt, the disc and the try, so an item's layout depends on nothing else: any partitioning gives the same rows. All
lengths are whole thousandths of a pixel, so every engine decides alike. It is one column expression: no shuffle, no
Python, and tries after the accepted one are not made.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.functions.arrays import let
from calibra.operators.ranks import running

#: Frame, range of radii and distances in thousandths of a pixel; tries of a disc and attempts of an item (fixed values).
WIDTH, HEIGHT = 640_000, 480_000
RADIUS = (18_000, 46_000)
GAP, BORDER = 8_000, 12_000
TRIES, ATTEMPTS = 4000, 25
#: Tries that are made together.
BLOCK = 8
_DISC = "struct<disc:int,r:bigint,x:bigint,y:bigint>"


def number(digest: Column, at: int, digits: int = 7) -> Column:
    """A whole number from some hex digits of a digest."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def within(n: Column, low: Column | int, high: Column | int) -> Column:
    """n, a number of 28 bits, carried onto low (included) to high (left out)."""
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return low + F.shiftright(n * (high - low), 28)


def balanced(df: DataFrame, item: str, values: int, key: str = "count") -> DataFrame:
    """item and value from 1 to values, each as often as any other or once more, dealt in the order of an MD5 of the item.

    item is a number; rows with a null item are left out, repeated items get a value each.
    """
    slim = df.filter(F.col(item).isNotNull()).select(item).withColumn("_h", number(F.md5(F.concat_ws(":", item, F.lit(key)).cast("binary")), 1, 13))
    return running(slim, [], "_h", item).select(item, ((F.col("_rank") - 1) % values + 1).cast("int").alias("value"))


def place(item: Column, count: Column) -> Column:
    """struct(attempt, discs) of an item's first attempt that places all its discs; null if none does, or count is null.

    discs: disc (its number from 0), r, x, y, in the order they were placed. A count below 1 gives no discs.
    """
    name = item.cast("string")

    def radii(attempt: Column) -> Column:
        def of(disc: Column) -> Column:
            return F.struct((-within(number(F.md5(F.concat_ws(":", name, attempt, disc).cast("binary")), 1), *RADIUS)).alias("minus"), disc.alias("disc"))

        return F.when(count < 1, F.array().cast("array<struct<minus:bigint,disc:int>>")).otherwise(F.array_sort(F.transform(F.sequence(F.lit(0), count.cast("int") - 1), of)))

    def candidate(attempt: Column, disc: Column, r: Column, k: Column) -> Column:
        def at(digest: Column) -> Column:
            edge = r + BORDER
            return F.struct(disc.alias("disc"), r.alias("r"), within(number(digest, 1), edge, WIDTH - edge).alias("x"), within(number(digest, 8), edge, HEIGHT - edge).alias("y")).cast(_DISC)

        return let(F.md5(F.concat_ws(":", name, attempt, disc, k).cast("binary")), at)

    def apart(a: Column, b: Column) -> Column:
        dx, dy, least = a["x"] - b["x"], a["y"] - b["y"], a["r"] + b["r"] + GAP
        return dx * dx + dy * dy >= least * least

    def first_fit(placed: Column, attempt: Column, wanted: Column) -> Column:
        disc, r = wanted["disc"], -wanted["minus"]

        def block(found: Column, b: Column) -> Column:
            tries = F.transform(F.sequence(b * BLOCK, b * BLOCK + (BLOCK - 1)), lambda k: candidate(attempt, disc, r, k))
            return F.when(found.isNotNull(), found).otherwise(F.get(F.filter(tries, lambda c: F.forall(placed, lambda q: apart(c, q))), F.lit(0)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES // BLOCK - 1)), F.lit(None).cast(_DISC), block)

    def discs(attempt: Column) -> Column:
        """The discs placed, or null once one of them finds no place."""

        def step(placed: Column, wanted: Column) -> Column:
            return F.when(placed.isNull(), placed).otherwise(let(first_fit(placed, attempt, wanted), lambda c: F.when(c.isNotNull(), F.array_append(placed, c))))

        return F.aggregate(radii(attempt), F.array().cast(f"array<{_DISC}>"), step)

    kind = f"struct<attempt:int,discs:array<{_DISC}>>"

    def attempts(done: Column, attempt: Column) -> Column:
        return F.when(done.isNotNull(), done).otherwise(let(discs(attempt), lambda d: F.when(d.isNotNull(), F.struct(attempt.alias("attempt"), d.alias("discs")).cast(kind))))

    return F.when(count.isNotNull() & item.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast(kind), attempts))


def layouts(df: DataFrame, item: str, count: str) -> tuple[DataFrame, DataFrame]:
    """(item, count, attempt, disc, r, x, y: a row for each disc; item, count of what could not be placed).

    A null item or count has no layout and is in neither; repeated items give their layout again.
    """
    made = df.filter(F.col(item).isNotNull() & F.col(count).isNotNull()).select(item, count).withColumn("_made", place(F.col(item), F.col(count)))
    rows = made.select(item, count, F.col("_made.attempt").alias("attempt"), F.explode("_made.discs").alias("d"))
    return rows.select(item, count, "attempt", "d.disc", "d.r", "d.x", "d.y"), made.filter(F.col("_made").isNull()).select(item, count)
