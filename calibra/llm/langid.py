"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text's features are its lower-cased character n-grams (as UTF-8 bytes, words set apart by single spaces), hashed into
a fixed number of buckets. Their embeddings are averaged and classified by a linear softmax. Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows: at most ROWS_PER_LANG of each language and
about SAMPLE_ROWS in all, taken by a hash of the id; every language is learned. A fifth of the sample is kept back: it
sets the temperature that calibrates the probabilities, and what is rejected.

A softmax is sure of texts of languages it never saw, so rejection does not rest on the probability alone. Each language
also has a density: the mean log likelihood ratio of a text's n-grams under the language's smoothed n-gram frequencies
against a uniform choice of buckets. The kept rows are read twice: by the density of their own language, and by the best
density of any other, as if their own were unknown (one language left out at a time). A prediction is rejected if its
density is below the level that stops FOREIGN_STOPPED of the texts so left out, but that level never costs more than
REJECTED_RIGHT of the right predictions; or if its probability is too low.

A null text, or one without a letter (Unicode category L), is `und` with score 0. A rejected text keeps the language that
is most likely, with `rejected` true, as have texts that are `und`. With no labelled row every text is `und`. Texts are
read whole; repeated rows give repeated results; an empty table gives an empty result; other columns are not looked at,
but must not be called lang_pred, score or rejected.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.llm._common import free_name, give_back, slices, small_batches, table

BUCKET_BITS, DIM, EPOCHS, BATCH, RATE = 14, 16, 12, 32, 4.0
#: The bound of the training sample.
ROWS_PER_LANG, SAMPLE_ROWS, LEAST_ROWS = 512, 32_768, 16
#: The share of right calibration predictions that rejection may cost.
REJECTED_RIGHT = 0.001
#: The share of texts of a language left out that rejection is to stop.
FOREIGN_STOPPED = 0.99
UNKNOWN = "und"
_COUNTED = [T.StructField("lang", T.StringType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
#: ASCII that is no letter separates words.
_BYTES = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """How often each bucket occurs among the 3-grams and 4-grams of the whole text."""
    b = _BYTES[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    four = (three[:-1] << 8) | b[3:]
    counts = np.bincount((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
    return counts + np.bincount((four * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Class scores per bucket (embedding times weights: the average and the softmax layer are both linear).

    density: the log likelihood ratios of the buckets by language; least and least_density: what is below is rejected.
    """

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, least: float, density: np.ndarray, least_density: float):
        self.langs, self.scores, self.bias, self.temperature, self.least = langs, scores, bias, temperature, least
        self.density, self.least_density = density, least_density

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The most likely language, its probability, and whether that or its density is too low."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        counts = features(text)
        n = max(1, counts.sum())
        p = _softmax(((counts @ self.scores) / n + self.bias)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least or counts @ self.density[best] / n < self.least_density)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: language, the buckets that occur, how often."""
    langs = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 1.0, np.zeros((0, 1 << BUCKET_BITS), np.float32), -np.inf)
    y = np.array([langs.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), 1 << BUCKET_BITS), np.float32)
        for k, i in enumerate(which):
            x[k, rows[i][1]] = rows[i][2]
        return x / np.maximum(1, x.sum(axis=1, keepdims=True))

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    train = np.flatnonzero(~held)
    share = np.bincount(y[train], minlength=len(langs))
    weight = (len(train) / len(langs) / np.maximum(1, share)).astype(np.float32)
    steps = EPOCHS * -(-len(train) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            x, rate = dense(part), RATE * (1 - done / steps)
            mean = x @ emb
            g = _softmax(mean @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g *= weight[y[part]][:, None] / len(part)
            step_emb = x.T @ (g @ w.T)
            w -= rate * (mean.T @ g)
            bias -= 0.01 * rate * g.sum(axis=0)
            emb -= rate * 50 * step_emb
            done += 1
    scores = emb @ w
    held_rows = np.flatnonzero(held) if held.any() else train
    z = np.concatenate([dense(held_rows[i : i + 256]) @ scores + bias for i in range(0, len(held_rows), 256)]).astype(np.float64)
    truth = y[held_rows]
    chance = 1 / len(langs)
    # a label is taken as right but for one in as many rows as there are, so that texts that are easily told apart do not push the temperature to 0
    doubt = 1 / (len(truth) + 2)
    target = np.full(z.shape, doubt * chance)
    target[np.arange(len(truth)), truth] += 1 - doubt
    temperature = min(np.geomspace(0.02, 5, 100), key=lambda t: -(target * np.log(_softmax(z / t) + 1e-300)).sum(axis=1).mean())
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    least = 0.0 if len(langs) == 1 else float(np.clip(np.quantile(right, REJECTED_RIGHT) * 0.8 if len(right) else 1, chance + 0.1 * (1 - chance), 0.5))
    density, least_density = _densities(rows, y, train, held_rows, len(langs))
    return Model(langs, scores.astype(np.float32), bias.astype(np.float64), float(temperature), least, density, least_density)


def _densities(rows: list[tuple[str, np.ndarray, np.ndarray]], y: np.ndarray, train: np.ndarray, held: np.ndarray, langs: int) -> tuple[np.ndarray, float]:
    """Log likelihood ratios by language and bucket, and the least density that is no rejection (none for one language)."""
    seen = np.full((langs, 1 << BUCKET_BITS), 0.5)
    for i in train:
        seen[y[i], rows[i][1]] += rows[i][2]
    density = np.log(seen / seen.sum(axis=1, keepdims=True) * (1 << BUCKET_BITS)).astype(np.float32)
    if langs == 1:
        return density, -np.inf
    of = np.array([density[:, rows[i][1]] @ rows[i][2] / max(1, rows[i][2].sum()) for i in held])
    at = np.arange(len(held)), y[held]
    own = of[at].copy()
    of[at] = -np.inf
    return density, float(min(np.quantile(of.max(axis=1), FOREIGN_STOPPED), np.quantile(own, REJECTED_RIGHT)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [features(t) for t in batch.column("text").to_pylist()]
        at = [np.flatnonzero(f).astype(np.int32) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array([f[i].astype(np.int32) for f, i in zip(found, at, strict=True)], pa.list_(pa.int32()))], names=["doc_id", "lang", "buckets", "counts"])


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the text and lang of docs alone; the driver gets counts of a bounded sample, no texts.

    All rows of a language are counted first; a hash of the id then lets about four times the wanted number through, so
    that no language's rows meet in one task before they are few.
    """
    small_batches(docs)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_all"))
    langs = sizes.count()
    if not langs:
        return fit([])
    wanted = min(rows_per_lang, max(LEAST_ROWS, sample_rows // langs))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))
    # sizes has a row a language, far smaller than the model; a shuffle by lang would put all rows of a language in one task
    few = labelled.select("doc_id", "lang", place.alias("_place")).join(F.broadcast(sizes), "lang").filter(F.col("_place") < F.lit(4.0 * wanted * (1 << 52)) / F.col("_all")).select("doc_id", "lang", "_place")
    order = Window.partitionBy("lang").orderBy("_place", "doc_id")
    picked = few.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= wanted).select("doc_id", "lang")  # at most wanted rows a language
    sample = labelled.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"])
    schema = T.StructType([sample.schema["doc_id"], *_COUNTED])
    got = sample.mapInArrow(_counted, schema).toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    rows = zip(got["lang"].to_pylist(), got["buckets"], got["counts"], strict=True)
    return fit([(a, np.asarray(b.values), np.asarray(c.values)) for a, b, c in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; the model's size is that of buckets times languages."""
    free_name(docs, "lang_pred", "score", "rejected")
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            found = [model.predict(t) for t in batch.column(text).to_pylist()]
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lang_pred", "score", "rejected"])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def held_out(col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.filter(~F.col("held_out")))
    found = predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
