"""Language identification by averaged hashed subword embeddings and a linear softmax.

The classifier is trained in numpy by stochastic gradient descent on a bounded sample of labelled
rows: at most ``per_label`` documents of each label (default 800), the ones with the smallest hash
of id and text. One fifth of them is set aside to fit the softmax temperature and the rejection
threshold. Prediction reads every whole text; since the model is linear, a word adds the same
vector wherever it stands, so each distinct word is hashed once per worker.

Edge cases: null text or text without a letter gives ``und`` with score 0; rows with a null label
are not learned from; with no labelled row at all every document is ``und``; ties between labels go
to the smaller label; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm._common import held, held_out, load, parts, ship, words

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
SLICE_BITS = 12
CACHE = 250_000
AT_ONCE = 1_000_000
_NEARLY = re.compile(r"[^\W\d_]")
_POWERS = np.array([1, 0x01000193, 0x0193_2D4F, 0x9E3779B1], np.uint32)


def subwords(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words one after the other, and their number by word.

    A word's subwords are the n-grams of its bytes between two marks, and the word itself.
    """
    joined = np.frombuffer(b"<" + b"><".join(some) + b">", np.uint8).astype(np.uint32)
    length = np.fromiter(map(len, some), np.int64, len(some)) + 2
    end = np.repeat(np.cumsum(length), length)
    word = np.repeat(np.arange(len(some)), length)
    at = np.arange(len(joined))
    buckets, owner = [np.fromiter(map(zlib.crc32, some), np.uint32, len(some))], [np.arange(len(some))]
    with np.errstate(over="ignore"):
        for n in ORDERS:
            start = at[: len(at) - n + 1]
            start = start[start + n <= end[start]]
            h = np.full(len(start), n, np.uint32)
            for j in range(n):
                h = h * _POWERS[1] + joined[start + j] * _POWERS[j]
            h ^= h >> np.uint32(15)
            h *= _POWERS[3]
            buckets.append(h >> np.uint32(8))
            owner.append(word[start])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(buckets)[order] % np.uint32(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(some))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, buckets, weights): the averaged bag of each whole text."""
    for b in batches:
        ids, weights = [], []
        for text in b.column(1).cast(pa.binary()).to_pylist():
            w = words(text)
            own, n = np.unique(subwords(w)[0] if w else np.empty(0, np.int64), return_counts=True)
            ids.append(own.astype(np.int32))
            weights.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], ["label", "ids", "weights"])


def has_letter(text: str) -> bool:
    """Whether any character is a letter (numerals such as one half are none)."""
    return any(m.group().isalpha() for m in _NEARLY.finditer(text))


class Model:
    """labels, logits per bucket, temperature and the score below which a prediction is rejected."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.labels, self.table, self.bias, self.temperature, self.threshold = labels, table, bias, temperature, threshold

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


def train(labels: list[str], bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 4, rate: float = 8.0, reject: float = 0.001, seed: int = 7) -> Model:
    """SGD on the bags; every fifth (in a seeded order) only calibrates."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    order = rng.permutation(len(bags))
    fit, hold = (order[len(order) // 5 :], order[: len(order) // 5]) if len(order) >= 5 else (order, order)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            ids, w = bags[i]
            h = w @ emb[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= 0.1 * lr * np.outer(h, p)
            bias -= 0.01 * lr * p
            emb[ids] -= lr * w[:, None] * back[None, :]
    table = (emb @ out).astype(np.float32)
    mean = np.array([bags[i][1] @ table[bags[i][0]] if len(bags[i][0]) else np.zeros(len(labels)) for i in hold])
    model = Model(labels, table, bias, 1.0, 0.0)
    if len(hold):
        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(model.probabilities(mean)[np.arange(len(hold)), y[hold]] + 1e-12).mean())

        model.temperature = min(np.geomspace(0.3, 20, 60), key=loss)
        p = model.probabilities(mean)
        right = np.sort(p.max(1)[p.argmax(1) == y[hold]])
        if len(right):
            model.threshold = float(min(0.5, right[int(reject * len(right))]))
    return model


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 800) -> Model | None:
    """A model from the labelled rows of docs, or None when there is none."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h")).filter("label IS NOT NULL AND text IS NOT NULL")
    # the per_label-th hash of each label, from hashes alone; texts are read once it is known. Counts by
    # slices of the hash say which slice it lies in, so only the hashes up to there are ranked
    hashes = rows.select("label", "h", F.shiftright("h", 64 - SLICE_BITS).alias("slice")).distinct()
    before = Window.partitionBy("label").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    upto = hashes.groupBy("label", "slice").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = upto.filter(F.col("before") < per_label).groupBy("label").agg(F.max("slice").alias("edge"))
    low = hashes.join(F.broadcast(edge), "label").filter("slice <= edge")
    cuts = low.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h"))).filter(F.col("n") <= per_label).groupBy("label").agg(F.max("h").alias("cut"))
    sample = rows.join(F.broadcast(cuts), "label").filter("h <= cut").dropDuplicates(["label", "h"])
    bags = sample.select("label", "text").mapInArrow(_features, "label string, ids array<int>, weights array<float>").toArrow()
    if not bags.num_rows:
        return None
    names = bags.column("label").to_pylist()
    labels = sorted(set(names))
    pairs = [(np.asarray(i.values, np.int32), np.asarray(w.values, np.float32)) for i, w in zip(bags.column("ids"), bags.column("weights"), strict=True)]
    order = sorted(range(len(names)), key=lambda k: (names[k], len(pairs[k][0]), pairs[k][0][:8].tobytes(), pairs[k][1][:8].tobytes()))
    return train(labels, [pairs[k] for k in order], np.array([labels.index(names[k]) for k in order]))


class _Scorer(dict):
    """Numbers of words, and sums of bucket logits and counts by number, for up to CACHE words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.rows = np.zeros((1024, len(model.labels) + 1), np.float32)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def _numbers(self, some: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        before = len(self)
        out = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
        if self.new:
            if len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self) + CACHE // 4, self.rows.shape[1]), np.float32)])
            buckets, n = subwords(self.new)
            starts = np.cumsum(n) - n
            self.rows[before : len(self), :-1] = np.add.reduceat(self.model.table[buckets], starts)
            self.rows[before : len(self), -1] = n
            self.new = []
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(label, score, accepted) of each text."""
        readable = [t if t is not None and has_letter(t) else "" for t in texts]
        split = [words(t.encode()) for t in readable]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        total = np.zeros((len(split), self.rows.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            number = self._numbers(list(chain.from_iterable(split)))
            total[some] = np.add.reduceat(self.rows[number], (np.cumsum(counts) - counts)[some], dtype=np.float64)
        p = self.model.probabilities(total[:, :-1] / np.maximum(1, total[:, -1:]))
        best = p.argmax(1)
        return [(self.model.labels[k], float(q[k]), bool(q[k] >= self.model.threshold)) if t else ("und", 0.0, False) for t, q, k in zip(readable, p, best, strict=True)]


def _scorer(model: Model | None):
    """The model's scorer in this worker process, so that later tasks find known words."""
    if model is None:
        return lambda texts: [("und", 0.0, False)] * len(texts)
    return held(model, lambda: _Scorer(model))


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs plus the predicted label, its calibrated probability and whether it clears the threshold.

    Columns of docs that bear one of the three new names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in into]
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for whole in batches:
            for b in parts(whole, whole.num_columns - 1, AT_ONCE):
                got = scorer(b.column(b.num_columns - 1).to_pylist())
                new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], *into])

    frame = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType()), T.StructField(into[2], T.BooleanType())])
    return frame.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", spread=True)
    out = held_out("doc_id", 4)
    model = fit(docs.filter(~out & F.col("lang").isNotNull()))
    lean = docs.select("doc_id", out.alias("held_out"), "text")
    return predict(lean, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
