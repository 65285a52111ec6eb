"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network with a calibrated temperature."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, output, sampled, saved, slices, table, texts

#: Words are hashed into so many rows of vectors, so that tables of vectors have one size whatever the corpus.
BUCKETS, DIM, NONZERO = 1 << 14, 32, 6
#: Neighbours on either side that a word's context vector sums.
REACH = 2
#: Labelled rows, those with the least hash of doc_id, that the network is fitted on.
TRAIN_ROWS = 20_000
FOLDS, HELD_FOLD = 3, 1
#: Tokens whose vectors are held at a time.
RUN = 1 << 17

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n|[^\s\w]")
_MOST_WORDS = 1 << 19


def index_vectors() -> np.ndarray:
    """A sparse random vector of -1, 0 and 1 for each bucket; bucket 0, between documents, is all 0."""
    rng = np.random.default_rng(20240)
    out = np.zeros((BUCKETS, DIM), dtype=np.int16)
    for row in out[1:]:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1, 1), NONZERO)
    return out


class Words:
    """Buckets of tokens: words, and one each for numbers, words in capitals, line ends and every mark."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _bucket(self, token: bytes) -> int:
        if len(self.known) > _MOST_WORDS:
            self.known.clear()
        shape = b"\x01number" if token.isdigit() else b"\x01capitals" if len(token) > 1 and token.isupper() else token.lower()
        found = self.known[token] = xxhash.xxh3_64_intdigest(shape) % (BUCKETS - 1) + 1
        return found

    def __call__(self, text: bytes) -> list[int]:
        get, new = self.known.get, self._bucket
        return [get(t) or new(t) for t in _TOKEN.findall(text)]


def _contexts(column: str):
    schema = pa.schema([("bucket", pa.int32())] + [(f"d{i}", pa.int64()) for i in range(DIM)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors, total = Words(), index_vectors(), np.zeros((BUCKETS, DIM), dtype=np.int64)
        gap = [0] * REACH
        for part in slices(batches, column, 1 << 20):
            every = np.array([*gap, *[x for t in texts(part, column) for x in (*words(t), *gap)]], dtype=np.int32)
            for at in range(REACH, len(every) - REACH, RUN):  # runs with REACH neighbours on either side
                ids = every[at - REACH : min(at + RUN, len(every) - REACH) + REACH]
                own = vectors[ids]
                near = np.zeros_like(own)
                for r in range(1, REACH + 1):
                    near[r:] += own[:-r]
                    near[:-r] += own[r:]
                ids, near = ids[REACH : len(ids) - REACH], near[REACH : len(ids) - REACH]
                order = np.argsort(ids, kind="stable")
                which, first = np.unique(ids[order], return_index=True)
                total[which] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
        total[0] = 0
        used = np.flatnonzero(total.any(axis=1))
        yield output({"bucket": used.astype(np.int32)} | {f"d{i}": total[used, i] for i in range(DIM)}, schema)

    return run


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket its own index vector and its context vector, both of length 1, from all documents.

    Every task sums the index vectors of neighbours for BUCKETS rows and Spark adds these up, so that what moves is one small table
    for each task, and what comes to the driver is BUCKETS rows.
    """
    named = docs.select(text).mapInArrow(_contexts(text), "bucket int, " + ", ".join(f"d{i} long" for i in range(DIM)))
    sums = named.groupBy("bucket").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(DIM)]).toPandas().sort_values("bucket")
    own, context = index_vectors().astype(np.float64), np.zeros((BUCKETS, DIM))
    context[sums["bucket"].to_numpy()] = sums[[f"d{i}" for i in range(DIM)]].to_numpy()
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.hstack([unit(own), unit(context)]).astype(np.float32)


def _pool(column: str, vectors):
    schema = pa.schema([("doc_id", pa.int64()), ("pooled", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table_ = Words(), vectors.value
        for part in slices(batches, column, 1 << 20):
            rows = []
            for t in texts(part, column):
                ids = np.array(words(t), dtype=np.int32)
                sums = sum((table_[ids[i : i + RUN]].sum(axis=0, dtype=np.float64) for i in range(0, len(ids), RUN)), np.zeros(table_.shape[1]))
                mean = (sums / max(1, len(ids))).astype(np.float32)
                rows.append(np.append(mean, np.float32(np.log1p(len(ids)))))
            yield output({"doc_id": part.column("doc_id"), "pooled": rows}, schema)

    return run


@dataclass
class Network:
    """Standardised input, one hidden layer of tanh, a logit, and the temperature that divides it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean())


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 5e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on four fifths of the rows; on the last fifth the temperature of least log loss. Fewer than two classes: the share of ones, for all."""
    rng = np.random.default_rng(seed)
    d = x.shape[1] if x.size else 2 * DIM + 1
    if len(set(y.tolist())) < 2:
        p = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    place = rng.permutation(len(y))
    held, used = place[: len(y) // 5], place[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    params = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            w1, b1, w2, b2 = params
            inside = (x[batch] - mean) / scale
            h = np.tanh(inside @ w1 + b1)
            e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - y[batch]) / len(batch)
            back = np.outer(e, w2) * (1 - h * h)
            slopes = [inside.T @ back + decay * w1, back.sum(axis=0), h.T @ e + decay * w2, np.array([e.sum()])]
            t += 1
            for i, g in enumerate(slopes):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held):
        z = net.logits(x[held])
        net.temperature = float(min(np.geomspace(0.25, 16, 97), key=lambda k: _loss(z / k, y[held])))
    return net


def _score(net):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.array(part.column("pooled").to_pylist(), dtype=np.float64).reshape(part.num_rows, 2 * DIM + 1)
            scores = net.value.scores(x) if len(x) else np.empty(0)
            yield output({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}, schema)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out (crc32 of doc_id modulo 3 is 1), score (0 to 1) and predicted (1 from 0.5 on).

    Word vectors come from all texts. The network learns from `most` labelled rows at most, none of them held out. Only the text is
    an input of a score.

    Null or empty text: scored as a text without words. doc_id is read as a long. Null doc_id, or no number: hashed as an empty text, never labelled. Null labels and
    labels other than 0 and 1 don't count; several labels of one document are a row each. No labels, or of one class only: all
    scores are that class's share. Repeated rows: each scored. Other columns are not read. Empty table: empty.
    """
    ids = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(text).alias(text))
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(ids, text))
    pooled = saved(ids.mapInArrow(_pool(text, vectors), "doc_id long, pooled array<float>"), "pooled")
    marked = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)").filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_FOLD)
    sample = pooled.join(sampled(marked, most, F.col("doc_id"), F.lit("sample")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("pooled")).limit(most).toPandas()
    x = np.array(sample["pooled"].tolist(), dtype=np.float64).reshape(len(sample), 2 * DIM + 1)
    net = context.broadcast(fit(x, sample["label"].to_numpy(dtype=np.float64)))
    rows = pooled.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_FOLD)
    return rows.mapInArrow(_score(net), "doc_id long, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
