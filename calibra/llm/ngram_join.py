"""N-gram Jaccard self-join by T-occurrence search with DivideSkip.

A document's set holds its distinct w-word shingles (words: runs of bytes that are no ASCII white space, A-Z folded).
Two documents link when 100 * |intersection| >= percent * |union|.

Plan: equal sets collapse to one representative. Sets of J >= percent/100 differ in few shingles, so when the shingles
are dealt into more buckets than can differ, some are equal in both: the hash of each bucket is a signature, and
documents that share one fall into one block. There are SLACK more buckets than that takes, so each set leaves out its
emptiest buckets, up to that number, and a common bucket of more shingles still remains. Shingles of passages that many
documents share would tie unrelated documents together, so signatures are made without the FREQUENT most frequent ones
of a sample (sets differ in no more shingles without them); a set with too little left adds the signatures of all its
shingles, for others like it. Any choice of these shingles gives the same links. Within a block an inverted
index is searched for each set: the short lists are merged by a heap, the long ones probed by binary search
(DivideSkip), and the sets that reach the required overlap T are links. Every link is found and counted once, weighted
by the copies of both sets. Blocks of more than BLOCK_SHINGLES are searched by size class (sets link only within a
class or with the next) and classes in parts: each pair of parts is a task of its own, so no task holds an unbounded
group and no link is lost. Counting all links of many different near copies takes time with the square of their number,
as many as there are links; exact copies take none.

Null or empty texts, and texts without words, have empty sets and link with nothing. Fewer than w words make one
shingle of all. Rows with a null id link with nothing and have a null component. Repeated rows link with each other.
Rows that share an id are one node of the components; links between different sets of one id are not counted.
Shingles are compared by 64-bit hashes, whole sets by 128 bits.
"""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm._common import cut, drop, give_back, id_hash, may_hold, members_filter, slices, small_batches, table
from calibra.llm.graph import components

#: Above this sum of set sizes a block is dealt into parts; an index of so many shingles takes some 30 MB.
BLOCK_SHINGLES = 500_000
#: Weight of a probe against a step of the heap, as DivideSkip's tuning constant.
PROBE_WEIGHT = 0.0085
#: Buckets beyond those that may differ, as a share of them; so many of the emptiest give no signature.
SLACK = 0.25
#: So many frequent shingles at most, from one in SAMPLE documents, by a hash of the text.
FREQUENT, SAMPLE = 100_000, 64
_MEMO = 100_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total ^ (total >> np.uint64(29))) * _MIX[0] + h[k : k + n] * _MIX[1] + _MIX[2]
    return np.unique(_mixed(total))


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


class Classes:
    """Size classes: sets that can link are in the same class or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.upper = percent, [1]

    def of(self, size: int) -> int:
        while self.upper[-1] < size:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * 100 // self.percent))
        return int(np.searchsorted(self.upper, size))

    def buckets(self, k: int) -> tuple[int, int]:
        """(buckets, those that a set may leave out): without these still one more than can differ, the smaller set of class k."""
        u, p = self.upper[k], self.percent
        needed = (u + u * 100 // p) * (100 - p) // (100 + p) + 1
        return needed + int(SLACK * needed), int(SLACK * needed)

    def signatures(self, s: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
        """A hash per bucket, for the set's own class and the one below, whose members may be linked as the smaller."""
        k = self.of(len(s))
        rare = None
        if frequent is not None and len(frequent):
            at = np.searchsorted(frequent, s)
            at[at == len(frequent)] = 0
            rare = s[frequent[at] != s]
        out = []
        for c in {k, max(0, k - 1)}:
            whole = rare is None
            if rare is not None:
                found, enough = self._hashed(rare, c, 0)
                out.append(found)
                whole = not enough
            if whole:
                out.append(self._hashed(s, c, 1, empty=True)[0])
        return np.concatenate(out).view(np.int64)

    def _hashed(self, s: np.ndarray, c: int, tag: int, empty: bool = False) -> tuple[np.ndarray, bool]:
        """Bucket hashes without the emptiest buckets, and whether no more than the spare ones were empty.

        Where more are empty, all that hold a shingle are given, and the empty ones too if asked.
        """
        m, spare = self.buckets(c)
        bucket = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with s
        ends = np.searchsorted(bucket, np.arange(m + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s), dtype=np.uint64)])
        own, size = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
        few = np.cumsum(np.bincount(size)) <= spare  # buckets of up to so many shingles may be left out
        level = len(few) if few.all() else int(few.argmin())
        kept = size >= (level if level or empty else 1)
        seed = np.uint64((c + 1 + tag * 1_000_003) * int(_MIX[2]) % 2**64)
        return _mixed(own * _MIX[0] + np.arange(m, dtype=np.uint64) * _MIX[1] + seed)[kept], level > 0


class DivideSkip:
    """An inverted index over sets, which must come by rising size, and its T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.tokens, self.at = np.unique(flat[order], return_index=True)
        self.at = np.append(self.at, len(flat))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, s: np.ndarray, after: int = -1) -> list[int]:
        """The sets behind place `after` that link with s."""
        p, n = self.percent, len(s)
        first = max(after + 1, int(np.searchsorted(self.sizes, -(-p * n // 100))))
        last = int(np.searchsorted(self.sizes, 100 * n // p, side="right"))  # no smaller and no larger set can link
        if first >= last:
            return []
        t = -(-p * (n + int(self.sizes[first])) // (100 + p))
        i = np.searchsorted(self.tokens, s)
        i[i == len(self.tokens)] = 0
        i = i[self.tokens[i] == s]
        lists = [x for x in (self.owner[a:b] for a, b in zip(self.at[i].tolist(), self.at[i + 1].tolist(), strict=True)) if x[-1] >= first]
        lists = [x[x.searchsorted(first) : x.searchsorted(last)] for x in lists]
        lists = sorted((x for x in lists if len(x)), key=len)
        if len(lists) < t:
            return []
        n_long = min(t - 1, int(t / (PROBE_WEIGHT * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        counts = [(d, sum(1 for _ in g)) for d, g in groupby(heapq.merge(*(x.tolist() for x in short)))]
        found, count = (np.array(x, np.int64) for x in zip(*counts, strict=True))
        need = -(-p * (n + self.sizes[found]) // (100 + p))
        for k, x in enumerate(long):
            stay = count + (n_long - k) >= need  # the rest of the long lists may still make up for it
            if not stay.all():
                found, count, need = found[stay], count[stay], need[stay]
            if not len(found):
                return []
            at = x.searchsorted(found)
            at[at == len(x)] = 0
            count += x[at] == found
        return found[count >= need].tolist()


def link_block(members: list[tuple[int, int, np.ndarray]], others: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """(number of the first member of its component, documents it links with) for the members and then the others.

    A member is (id, number of copies, set). Without others all members are compared with each other, else each member
    with each of the others only.
    """
    order = sorted(range(len(members)), key=lambda k: len(members[k][2]))
    both = [*members, *others]
    root, links = list(range(len(both))), [0] * len(both)
    index = DivideSkip([members[k][2] for k in order], percent)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    asks = ((len(members) + k, o[2], -1) for k, o in enumerate(others)) if others else ((k, members[k][2], place) for place, k in enumerate(order))
    for q, s, after in asks:
        for d in index.search(s, after):
            d = order[d]
            links[q] += both[d][1]
            links[d] += both[q][1]
            a, b = find(q), find(d)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(find(k), links[k]) for k in range(len(both))]


def _combined(keys: list[bytes | None], found: list[np.ndarray], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the places of their owners; where several texts of the slice share signatures, one pair stands for all.

    A text that shares signatures with one before it in the slice gives these up for one signature of the pair, which
    the other one gets too. So each signature leaves a slice at most once for itself, however many near copies there are.
    """
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sig, at = np.concatenate(found), np.repeat(owner, [len(f) for f in found])
    _, first, back = np.unique(sig, return_index=True, return_inverse=True)
    leader = at[first][back]
    pairs = np.unique(np.stack([leader, at])[:, leader != at], axis=1)
    head = np.array([int.from_bytes(k[:8]) if k else 0 for k in keys], np.uint64)
    joint = _mixed(head[pairs[0]] * _MIX[0] + head[pairs[1]] * _MIX[1] + _MIX[2])
    alone = leader == at
    return np.concatenate([sig[alone], joint, joint]), np.concatenate([at[alone], pairs[0], pairs[1]])


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, key of the set, and the signatures that stand for the row."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(percent)
        for batch in slices(batches, 1):
            sizes, keys, found, owner, seen = [], [], [], [], set()
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s = shingles(text, width)
                key = set_key(s)
                sizes.append(len(s))
                keys.append(key)
                if doc is not None and key is not None and key not in seen:  # a copy in the same slice adds nothing
                    seen.add(key)
                    found.append(classes.signatures(s, frequent.value).view(np.uint64))
                    owner.append(k)
            sig, at = _combined(keys, found, owner)
            sig, ends = sig[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at, minlength=len(keys)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(sig.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "n_shingles", "key", "sigs"])
        _words.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, sigs array<long>")


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """At most FREQUENT shingles that several texts of a hashed sample hold, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = np.concatenate([np.zeros(0, np.uint64), *(shingles(t, width) for t in batch.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["s"])
        _words.clear()
        give_back()

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = sample.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()
    return np.sort(np.asarray(top["s"], np.int64).view(np.uint64))


def _search(members: DataFrame, docs: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """members: doc_id, key, copies, tasks (task, side). Gives a (a member), key, b (the first of its component in the task), links."""
    wanted = members_filter(members.select(id_hash("doc_id").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            batch = batch.filter(pa.array(may_hold(wanted.value, batch.column(1))))
            found = [shingles(x, width) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "key", "shingles"])
        _words.clear()
        give_back()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in slices(batches, "shingles") for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for task, group in groupby(rows, key=lambda r: r[0]):
            sides, keys = ([], []), ([], [])
            for _, side, doc, key, copies, s in group:
                sides[side == 1].append((doc, copies, np.frombuffer(s, np.uint64)))
                keys[side == 1].append(key)
            if not sides[0] or not sides[1] and "x" in task:
                continue
            ids = [m[0] for side in sides for m in side]
            made = link_block(*sides, percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*keys[0], *keys[1]], pa.binary()), pa.array([ids[r] for r, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())], names=["a", "key", "b", "links"])
        give_back()

    text = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), id_hash(F.col("doc_id").cast("long")).alias("h"), "text")
    sets = text.mapInArrow(run, "doc_id long, key binary, shingles binary").dropDuplicates(["doc_id", "key"])
    # members have no size bound: never broadcast, at no size
    dealt = members.hint("merge").join(sets, ["doc_id", "key"]).select(F.explode("tasks").alias("t"), "doc_id", "key", "copies", "shingles").select("t.task", "t.side", "doc_id", "key", "copies", "shingles").repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(link, "a long, key binary, b long, links long")


def _tasks(blocks: DataFrame, reps: DataFrame, most: int, percent: int) -> DataFrame:
    """doc_id, key, copies, tasks of the members of blocks: what is compared with what.

    A block of up to BLOCK_SHINGLES is one task. A larger one is split by size class and each class into parts of up to
    half of that; each part is compared with itself, with the other parts of its class and with those of the next class.
    """
    classes = Classes(percent)
    classes.of(most)
    upper = F.array(*map(F.lit, classes.upper))
    sized = cut(blocks.join(reps.select(F.col("rep").alias("node"), "key", "n", "copies"), "node").withColumn("c", F.size(F.filter(upper, lambda u: u < F.col("n")))))
    per = sized.groupBy("comp", "c").agg(F.sum("n").alias("n"))
    whole = per.groupBy("comp").agg((F.sum("n") <= BLOCK_SHINGLES).alias("whole"), F.map_from_entries(F.collect_list(F.struct("c", F.ceil(2 * F.col("n") / BLOCK_SHINGLES).cast("int").alias("p")))).alias("p"))  # a map entry for each size class
    parts = cut(sized.join(whole, "comp").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.try_element_at("p", F.col("c"))).cast("int")))
    drop(sized)
    at = lambda d: F.coalesce(F.try_element_at("p", F.col("c") + d), F.lit(0))
    each = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)
    task = lambda c, i, j, side: F.struct(F.concat_ws("x", "comp", c, i, j).alias("task"), side.cast("int").alias("side"))
    alone = lambda name: F.array(F.struct(name.alias("task"), F.lit(0).alias("side")))
    itself = alone(F.concat_ws("-", "comp", "c", "own"))
    within = F.transform(F.filter(each(at(0)), lambda k: k != F.col("own")), lambda k: task(F.col("c"), F.least(k, F.col("own")), F.greatest(k, F.col("own")), k < F.col("own")))
    upward = F.transform(each(at(1)), lambda k: task(F.concat(F.col("c").cast("string"), F.lit("+")), F.col("own"), k, F.lit(0)))
    downward = F.transform(each(at(-1)), lambda k: task(F.concat((F.col("c") - 1).cast("string"), F.lit("+")), k, F.col("own"), F.lit(1)))
    return parts.select(F.col("node").alias("doc_id"), "key", "copies", F.when(F.col("whole"), alone(F.col("comp").cast("string"))).otherwise(F.concat(itself, within, upward, downward)).alias("tasks"))


def link_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included) and n_links for each row of docs.

    n_links counts the other rows that a row links with, copies included.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    small_batches(docs)
    spark = docs.sparkSession
    base = cut(_sets(docs, width, percent))
    reps = base.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    reps = cut(reps)  # so that the join below reads plain exchanges, which Spark splits where a key is hot
    known = cut(base.select("doc_id", "n_shingles", "key").hint("merge").join(reps.select("key", "rep", "copies"), "key", "left"))
    sigs = base.select(F.explode("sigs").alias("sig"), "doc_id")
    stars = sigs.withColumn("a", F.min("doc_id").over(Window.partitionBy("sig")))  # a row for each slice at most
    edges = stars.select("a", F.col("doc_id").alias("b")).filter("a <> b").distinct()
    to_rep = known.filter("rep is not null").select("doc_id", "rep").distinct()
    as_reps = edges.join(to_rep.toDF("a", "ra"), "a").join(to_rep.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b")
    blocks = components(as_reps)
    drop(base)
    most = reps.agg(F.max("n")).first()[0] or 1
    members = cut(_tasks(blocks, reps, most, percent))
    found = cut(_search(members, docs, width, percent, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    linked = components(found.select("a", "b").filter("a <> b"))
    drop(blocks, members)
    links = found.groupBy(F.col("a").alias("rep"), "key").agg(F.sum("links").alias("links"))
    joined = known.join(linked.toDF("rep", "comp"), "rep", "left").join(links, ["rep", "key"], "left")
    own = F.col("doc_id").isNotNull()
    n_links = F.when(own & F.col("key").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    return joined.select("doc_id", "n_shingles", F.when(own, F.coalesce("comp", "rep", "doc_id")).alias("component_id"), n_links.alias("n_links"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), width=3, percent=90)


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
ORACLES = {
    "op9_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM toks a JOIN toks b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, coalesce(l.n, 0) AS n_links
FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON s.doc_id = m.x LEFT JOIN (SELECT x, count(*) AS n FROM pairs GROUP BY x) l ON s.doc_id = l.x
"""
}
