"""Removal of byte strings that occur more than once, by a distributed merge sort of suffixes that knows common prefixes.

A string of `length` bytes that also starts anywhere else (in the same document too, overlaps count) is removed
everywhere, all on the input as it is. Bytes of repeated strings of `passage` bytes are counted as well: some fifty
words may have less than `length` bytes. Sorting every suffix would move many times the input, so suffixes are taken at
anchors only: each window of `passage` bytes has one anchor, the leftmost of its SEED-byte seeds with the smallest hash.
Equal windows have equal anchors, so every repeated string is found among the suffixes that start with the same seed.

1. Each document yields its anchors with the run of windows each one stands for, and hashes of the seed and of all bytes
   around (from the first window on, to `length` bytes behind the start of the last). Seeds that occur once go. Copies: anchors whose bytes around
   are all repeated have nothing left to find. One of each such class, and all anchors with a repeated seed, go on.
2. The bytes around them become suffixes. Each task sorts its own, front-codes the sorted run (length of the prefix
   shared with the suffix before, then the rest), and sends one piece per range of seeds.
3. Each range combines its pieces by a loser tree. A suffix carries the length of the prefix it shares with the last
   winner, so no known prefix is compared again, and the order comes with all common-prefix lengths.
4. These decide. A string that begins o bytes before the anchor is repeated if another suffix shares o bytes to the left
   and the rest to the right. The bytes to the left are sorted backwards, also with their common prefixes; for each o the
   two orders fall into classes where a common prefix is too short, and who shares both classes with another has a
   repeat (`_classes`). Groups of up to WALK visit their neighbours by falling common prefix instead (`_walk`).
5. Seeds with more than HOT suffixes are not gathered in one task: their strings are hashed where they are and counted by
   a shuffle.

A null text counts as empty. Texts shorter than `passage` keep all. Repeated rows are repeats of each other. Rows are
told apart by id and text, so shared and null ids are fine. Texts of any length are read whole, in pieces.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm._common import cut, drop, give_back, id_hash, may_hold, members_filter, slices, small_batches, table

LENGTH, PASSAGE, SEED, WALK, HOT = 400, 256, 32, 48, 20_000
#: Bytes of suffixes in a range, which one task merges.
RANGE_BYTES = 6 << 20
#: Window starts of a long text that are looked at together.
PIECE = 1 << 20
_POS = np.uint64((1 << 24) - 1)
_MASK = (1 << 64) - 1


def _seeds(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes from each position, by doubling."""
    h, step = b.astype(np.uint64) + np.uint64(0x51ED270B), 1
    mult = 0x9E3779B97F4A7C15
    while step < SEED:
        h = h[:-step] * np.uint64(mult) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step, mult = step * 2, (mult * mult + 2) % 2**64 | 1
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, from block-wise running minima."""
    n = len(x)
    padded = np.full(-(-n // w) * w, ~np.uint64(0))
    padded[:n] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, length: int = PASSAGE) -> list[tuple[np.ndarray, ...]]:
    """(seed hash, anchor, first window, last window) of a text, in pieces."""
    b, out = np.frombuffer(data, np.uint8), []
    for at in range(0, len(b) - length + 1, PIECE):
        h = _seeds(b[at : at + PIECE + length - 1])
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        place = (_window_min(key, length - SEED + 1) & _POS).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.append(first[1:] - 1, len(place) - 1)
        out.append((h[place[first]], place[first] + at, first + at, last + at))
    return out


def _shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which the first `at` bytes are known."""
    n, step = min(len(a), len(b)), 16
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at = min(at + step, n)
            step *= 2
        elif step == 1:
            return at
        else:
            step = max(1, min(step, n - at) // 2)
    return n


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Prefix lengths shared with the suffix before, and what follows them, of a sorted run."""
    known, rest, before = [], [], b""
    for s in suffixes:
        n = _shared(before, s)
        known.append(n)
        rest.append(s[n:])
        before = s
    return known, rest


class LoserTree:
    """Merges front-coded runs. Each head knows how much it shares with the last winner; only what lies beyond is compared."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.heads: list[bytes | None] = [None] * len(runs)
        self.known = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        for r in range(len(runs)):
            self._advance(r, first=True)
        self.losers = [-1] * self.size
        self.top = self._build(1)

    def _advance(self, r: int, first: bool = False) -> None:
        known, rest = self.runs[r]
        i = self.at[r]
        if i == len(known):
            self.heads[r] = None
            return
        self.heads[r] = rest[i] if first else self.heads[r][: known[i]] + rest[i]
        self.known[r] = 0 if first else known[i]
        self.at[r] = i + 1

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        x = self.heads[a] if a >= 0 and a < len(self.heads) else None
        y = self.heads[b] if b >= 0 and b < len(self.heads) else None
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        n = _shared(x, y, self.known[a])
        winner, loser = (a, b) if n == len(x) or (n < len(y) and x[n] < y[n]) else (b, a)
        self.known[loser] = n
        return winner, loser

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, place in it, prefix shared with the suffix before, suffix) in sorted order."""
        while (r := self.top) < len(self.heads) and self.heads[r] is not None:
            yield r, self.at[r] - 1, self.known[r], self.heads[r]
            self._advance(r)
            winner, node = r, (r + self.size) // 2
            while node:
                winner, self.losers[node] = self._play(winner, self.losers[node])
                node //= 2
            self.top = winner


Reach = dict[int, tuple[int, int]]


def _walk(i: int, known: list[int], lefts: list[bytes], rights: list[bytes], lengths: tuple[int, ...]) -> Reach:
    """How far left and right of anchor i its repeats of each length reach, by length."""
    left, best, least = lefts[i], {}, min(lengths)
    for step in (-1, 1):
        shared, j = len(rights[i]), i
        while 0 <= j + step < len(rights):
            shared = min(shared, known[j] if step < 0 else known[j + 1])
            j += step
            if shared + len(left) < least:
                break
            common = _shared(left, lefts[j])
            for n in lengths:
                if shared + common >= n:
                    l, r = best.get(n, (0, 0))
                    best[n] = max(l, common), max(r, shared)
    return best


def _classes(known: list[int], lefts: list[bytes], lengths: tuple[int, ...]) -> list[Reach]:
    """The same for all members of a group, which come in the order of what follows their anchors.

    For each distance o to the left, two orders are cut where neighbours share less than o bytes to the left, and less
    than the rest to the right; members that are together in both have a repeat that begins at o.
    """
    n = len(lefts)
    by_left = sorted(range(n), key=lefts.__getitem__)
    left = np.array([0, *(_shared(lefts[a], lefts[b]) for a, b in zip(by_left[:-1], by_left[1:], strict=True))])
    right, by_left = np.array(known), np.array(by_left)
    right[0] = left[0] = -1
    most_left, most_right = int(left.max()), int(right.max())
    out: list[Reach] = [{} for _ in range(n)]
    left_class = np.empty(n, np.int64)
    for length in lengths:
        best_l, best_r = np.full(n, -1), np.full(n, -1)
        for o in range(max(0, length - most_right), min(most_left, length) + 1):
            right_class = np.cumsum(right < length - o)
            left_class[by_left] = np.cumsum(left < o)
            some = np.flatnonzero((np.bincount(right_class)[right_class] > 1) & (np.bincount(left_class)[left_class] > 1))
            if not len(some):
                continue
            both = right_class[some] * (n + 1) + left_class[some]
            order = np.argsort(both, kind="stable")
            same = both[order[1:]] == both[order[:-1]]
            hit = np.zeros(len(some), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            who = some[hit]
            best_l[who] = o
            np.maximum.at(best_r, who, length - o)
        for i in np.flatnonzero(best_l >= 0).tolist():
            out[i][length] = int(best_l[i]), int(best_r[i])
    return out


def _anchors(docs: DataFrame, length: int, passage: int) -> DataFrame:
    """d, u, seed, whole (a hash of the bytes around), at, first and last window, end of the bytes around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            cols: list[list] = [[] for _ in range(8)]
            for d, u, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (t or "").encode()
                for seed, at, first, last in anchors(data, passage):
                    end = np.minimum(last + length, len(data))
                    spans = zip(at.tolist(), first.tolist(), end.tolist(), strict=True)
                    whole = [xxhash.xxh3_64_intdigest(data[p:q], seed=a - p) for a, p, q in spans]
                    for c, v in zip(cols, (np.full(len(at), d), np.full(len(at), u), seed.view(np.int64), np.array(whole, np.uint64).view(np.int64), at, first, last, end), strict=True):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["d", "u", "seed", "whole", "at", "first", "last", "end"])
        give_back()

    return docs.mapInArrow(run, _ANCHOR)


_ANCHOR = "d long, u long, seed long, whole long, at long, first long, last long, end long"


def _repeated(found: DataFrame) -> DataFrame:
    """Anchors whose seed occurs again, and some others that a filter of fixed size lets through: the rest need no shuffle."""
    seeds = found.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1")
    held = members_filter(seeds.select(id_hash("seed").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, batch.column(8)))).select(range(8))

    return found.select("*", id_hash("seed").alias("h")).mapInArrow(run, _ANCHOR)


def _spread(seed: int) -> int:
    """A seed's place in the merge. Seeds are the least hashes of their windows, hence small: mixed, they fill the range."""
    x = seed * 0x9E3779B97F4A7C15 & _MASK
    return (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _MASK


def _runs(found: DataFrame, ranges: int) -> DataFrame:
    """found: d, u, text, marks. One front-coded sorted run for each slice of a task and range of seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows = []
            for d, u, t, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (t or "").encode()
                for m in marks:
                    seed = _spread(m["seed"] & _MASK)
                    rows.append((seed * ranges >> 64, seed.to_bytes(8) + data[m["at"] : m["end"]], data[m["first"] : m["at"]][::-1], d, u, m["at"], m["open"]))
            rows.sort(key=lambda r: r[:2])
            for start, end in _bounds([r[0] for r in rows]):
                part = rows[start:end]
                known, rest = front_code([r[1] for r in part])
                yield pa.RecordBatch.from_arrays([pa.array([part[0][0]], pa.int32()), pa.array([known], pa.list_(pa.int32())), pa.array([rest], pa.list_(pa.binary())), *(pa.array([[r[k] for r in part]], pa.list_(kind)) for k, kind in ((2, pa.binary()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64()), (6, pa.bool_())))], names=["range", "known", "rest", "lefts", "d", "u", "at", "open"])
        give_back()

    return found.mapInArrow(run, "range int, known array<int>, rest array<binary>, lefts array<binary>, d array<long>, u array<long>, at array<long>, open array<boolean>")


def _bounds(keys: list[int]) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if keys else []


def _merge(runs: list[tuple], lengths: tuple[int, ...]) -> Iterator[tuple[int, int, int, int, int]]:
    """(d, u, length, first byte, end) of the repeats in the runs of one range."""
    group: list[tuple[int, int, int, bytes]] = []

    def settle() -> Iterator[tuple[int, int, int, int, int]]:
        if len(group) < 2:
            return
        known, lefts = [g[2] - 8 for g in group], [runs[r][2][i] for r, i, _, _ in group]
        if len(group) > WALK:
            reach = _classes(known, lefts, lengths)
        else:
            rights = [g[3][8:] for g in group]
            reach = [_walk(k, known, lefts, rights, lengths) if runs[r][6][i] else {} for k, (r, i, _, _) in enumerate(group)]
        for (r, i, _, _), found in zip(group, reach, strict=True):
            if runs[r][6][i]:
                for n, (left, right) in found.items():
                    yield runs[r][3][i], runs[r][4][i], n, runs[r][5][i] - left, runs[r][5][i] + right

    for r, i, known, suffix in LoserTree([(x[0], x[1]) for x in runs]):
        if group and known < 8:  # the seed hash leads each suffix
            yield from settle()
            group.clear()
        group.append((r, i, known, suffix))
    yield from settle()


def _merged(runs: DataFrame, lengths: tuple[int, ...], ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(_merge(held, lengths)) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], names=["d", "u", "length", "start", "end"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[0].as_py() for c in batch.slice(k, 1).columns]
                if row[0] != current:
                    yield from flush()
                    held, current = [], row[0]
                held.append(row[1:])
        yield from flush()
        give_back()

    dealt = runs.repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "d long, u long, length long, start long, end long")


def _counted_windows(found: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(d, u, length, start, end) for open anchors of hot seeds: each string a row, counted by its hash and distance to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for d, u, t, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (t or "").encode()
                for m in marks:
                    for length in lengths:
                        starts = np.arange(m["first"], min(m["last"], m["end"] - length) + 1)
                        h = np.array([xxhash.xxh3_64_intdigest(data[p : p + length], seed=(m["at"] - p) << 16 | length) for p in starts.tolist()], np.uint64).view(np.int64)
                        n = len(h)
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(n, d)), pa.array(np.full(n, u)), pa.array(np.full(n, length)), pa.array(np.full(n, m["at"])), pa.array(m["at"] - starts), pa.array(np.full(n, m["open"]))], names=["h", "d", "u", "length", "at", "o", "open"])

    windows = cut(found.mapInArrow(run, "h long, d long, u long, length long, at long, o long, open boolean"))
    twice = windows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    hit = windows.filter("open").hint("merge").join(twice, "h", "left_semi").groupBy("d", "u", "length", "at").agg(F.max("o").alias("l"), F.min("o").alias("r"))
    return hit.select("d", "u", "length", (F.col("at") - F.col("l")).alias("start"), (F.col("at") - F.col("r") + F.col("length")).alias("end"))


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (d, u, text) without rows that a filter of fixed size knows not to be in wanted: they need no shuffle."""
    held = members_filter(wanted.select(id_hash("d", "u").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held.value, batch.column(3))))
            if batch.num_rows:
                yield batch.select(["d", "u", "text"])

    return docs.select("d", "u", "text", id_hash("d", "u").alias("h")).mapInArrow(run, "d long, u long, text string")


def repeated_spans(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> tuple[DataFrame, list[DataFrame]]:
    """docs: d, u, text. (d, u, length, start, end) of bytes in repeated strings of `length` and of `passage` bytes; spans may overlap.

    And the tables that these are read from, to be dropped afterwards.
    """
    if not SEED < passage <= length:
        raise ValueError(f"passage must be over {SEED} and at most length")
    lengths = tuple(sorted({length, passage}))
    every = cut(_anchors(docs, length, passage))
    found = cut(_repeated(every))
    drop(every)
    classes = cut(found.groupBy("seed", "whole").agg(F.count("*").alias("n"), F.min(F.struct("d", "u", "at", "first", "last", "end")).alias("m")).select("seed", "whole", "n", "m.*"))
    # none of these tables has a size bound: merge joins, never broadcasts, at every size
    settled = found.hint("merge").join(classes.filter("n > 1").select("seed", "whole"), ["seed", "whole"], "left_semi")
    spans = settled.select("d", "u", F.explode(F.array(F.struct(F.lit(passage).cast("long").alias("length"), (F.col("last") + passage).alias("end")), *([F.struct(F.lit(length).cast("long").alias("length"), "end")] if length > passage else []))).alias("s"), F.col("first").alias("start"))
    settled = spans.select("d", "u", "s.length", "start", "s.end").filter("end - start >= length")
    several = cut(classes.groupBy("seed").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.sum(F.col("end") - F.col("first")).alias("bytes")).filter("k > 1 and least = 1"))
    used = [found, classes, several]
    size = several.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def around(seeds: DataFrame) -> DataFrame:
        marks = classes.join(seeds.select("seed"), "seed", "left_semi").groupBy("d", "u").agg(F.collect_list(F.struct("seed", "at", "first", "last", "end", (F.col("n") == 1).alias("open"))).alias("marks"))
        marks = cut(marks)
        used.append(marks)
        return _only(docs, marks).hint("merge").join(marks, ["d", "u"]).select("d", "u", "text", "marks").dropDuplicates(["d", "u"])

    open_spans = _merged(_runs(around(several.filter(F.col("k") <= HOT)), ranges), lengths, ranges)
    hot = several.filter(F.col("k") > HOT)
    if not hot.isEmpty():
        open_spans = open_spans.unionByName(_counted_windows(around(hot), lengths))
    return settled.unionByName(open_spans), used


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets), kept (bytes, if wanted) and n_passage_bytes for each row.

    n_passage_bytes counts the bytes in strings of `passage` bytes that also start anywhere else.
    """
    small_batches(docs)
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.col(text)).alias("u"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found, used = repeated_spans(base.select("d", "u", "text"), length, passage)
    spans = cut(found.distinct().groupBy("d", "u").agg(F.collect_list(F.struct("length", "start", "end")).alias("spans")))
    drop(*used)
    held = members_filter(spans.select(id_hash("d", "u").alias("h")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            hit = may_hold(held.value, batch.column(4))
            text_ = batch.column(3).to_pylist()
            whole = [None if h else (t or "").encode() for t, h in zip(text_, hit, strict=True)]
            kept = [w if keep_bytes else None for w in whole]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t if h else None for t, h in zip(text_, hit, strict=True)], pa.string()), pa.array(~hit), pa.array([w if w is None else len(w) for w in whole], pa.int64()), pa.array([w if w is None else hashlib.sha256(w).hexdigest() for w in whole], pa.string()), pa.array(kept, pa.binary())], names=["d", "u", "doc_id", "text", "clean", "n", "sha", "whole"])
        give_back()

    def joined_up(spans: list[dict], n: int) -> list[list[int]]:
        merged: list[list[int]] = []
        for start, end in sorted((s["start"], s["end"]) for s in spans if s["length"] == n):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        return merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc, t, clean, n, sha, whole, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if clean:
                    out.append((doc, n, 0, 0, sha, [], whole, 0))
                    continue
                data, merged = (t or "").encode(), joined_up(found or [], length)
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in merged], kept if keep_bytes else None, sum(b - a for a, b in joined_up(found or [], passage))))
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        give_back()

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_passage_bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.int64()]
    parted = base.select("d", "u", F.col("doc_id").cast("long").alias("doc_id"), "text", id_hash("d", "u").alias("h")).mapInArrow(split, "d long, u long, doc_id long, text string, clean boolean, n long, sha string, whole binary")
    joined = parted.hint("merge").join(spans, ["d", "u"], "left").select("doc_id", "text", "clean", "n", "sha", "whole", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary, n_passage_bytes long")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
