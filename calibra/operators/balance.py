"""A running counter that rows steer by its own sign, over rows in any number of ranges.

Each row changes the counter by one of three numbers: one for a counter below zero, at zero and above. Rows are cut into
ranges of the order. Each range follows the counters from -NEAR to NEAR at once (they soon meet), and, for counters so far
off that they keep their sign through the range, the sum of its changes; chaining these, one small row a range, tells where
each range begins. A beginning that neither covers is followed through its range by itself. Then the ranges are replayed.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.operators.ranks import level_of, quantile_cuts
from calibra.sources.scratch import cut

NEAR = 64
_STEPS = ("below", "zero", "above")


def _follow(batches: Iterator[pa.RecordBatch], begins: dict[int, list[int]] | None) -> Iterator[pa.RecordBatch]:
    """place, begin, end and, of the whole range, the sums and extremes of the changes above and below."""
    state: dict = {}

    def done():
        for end, starts in state["groups"].items():
            for begin in starts:
                yield {"place": state["place"], "begin": begin, "end": end, "down": state["low"], "above": state["up_sum"], "up": state["high"], "below": state["down_sum"]}

    out: list = []
    for batch in batches:
        for place, below, zero, above in zip(*(batch.column(c).to_pylist() for c in ("place", *_STEPS)), strict=True):
            if not state or state["place"] != place:
                if state:
                    out += done()
                groups = {b: [b] for b in (range(-NEAR, NEAR + 1) if begins is None else begins[place])}
                state = {"place": place, "groups": groups, "low": 0, "high": 0, "up_sum": 0, "down_sum": 0}
            state["up_sum"] += above
            state["down_sum"] += below
            state["low"], state["high"] = min(state["low"], state["up_sum"]), max(state["high"], state["down_sum"])
            met: dict[int, list[int]] = {}
            for v, starts in state["groups"].items():
                met.setdefault(v + (above if v > 0 else below if v < 0 else zero), []).extend(starts)
            state["groups"] = met
    if state:
        out += done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.int64()) for c in ("place", "begin", "end", "down", "above", "up", "below")]))


_TRACE = "place long, begin long, end long, down long, above long, up long, below long"


def _replay(batches: Iterator[pa.RecordBatch], begins: dict[int, int]) -> Iterator[pa.RecordBatch]:
    place, v = None, 0
    for batch in batches:
        seen = []
        for p, below, zero, above in zip(*(batch.column(c).to_pylist() for c in ("place", *_STEPS)), strict=True):
            if p != place:
                place, v = p, begins[p]
            seen.append(v)
            v += above if v > 0 else below if v < 0 else zero
        yield batch.append_column("counter", pa.array(seen, pa.int64()))


def counter(df: DataFrame, order: str, tie: str, ranges: int | None = None) -> DataFrame:
    """df (with whole numbers below, zero and above) and `counter`: its value before each row, from 0, by order and then tie.

    order must be a number without nulls. By default four ranges for each shuffle partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.withColumns({c: F.col(c).cast("long") for c in _STEPS}))
    cuts = sorted(set(quantile_cuts(rows, F.col(order).cast("double"), ranges or 4 * n)))
    placed = rows.withColumn("place", level_of(cuts, F.col(order).cast("double")).cast("long"))
    dealt = placed.repartition(n, "place").sortWithinPartitions("place", order, tie)
    narrow = placed.select("place", *dict.fromkeys([order, tie]), *_STEPS).repartition(n, "place").sortWithinPartitions("place", order, tie)
    traced: dict[int, list] = {}
    for r in narrow.mapInArrow(lambda b: _follow(b, None), _TRACE).collect():  # 2 * NEAR + 1 rows for each range
        traced.setdefault(r["place"], []).append(r)
    begins, v = {}, 0
    for place in sorted(traced):
        begins[place], one = v, traced[place][0]
        if v > -one["down"] or v < -one["up"]:
            v += one["above"] if v > 0 else one["below"]
        elif abs(v) <= NEAR:
            v = next(r["end"] for r in traced[place] if r["begin"] == v)
        else:
            asked = {place: [v]}
            v = narrow.filter(F.col("place") == place).mapInArrow(lambda b, a=asked: _follow(b, a), _TRACE).first()["end"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return dealt.mapInArrow(lambda b: _replay(b, begins), f"{fields}, counter long").drop("place")
