"""LM scoring: unigram pieces of an existing vocabulary; a text's probability is the sum over all its segmentations."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, output, saved, slices, table, texts

FOLDS, HELD_FOLD = 7, 2
#: Words, the most frequent first, whose figures every task gets; all others meet theirs in a join.
HEAD_WORDS = 1 << 17
#: Distinct words that a task counts before it hands them on.
FLUSH_WORDS = 1 << 18
#: Added to every piece's expected count, spread by the vocabulary's own scores.
PRIOR = 1000.0

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK = 0x2581
_SLICE = 1 << 14


class Lattice:
    """All segmentations of words into pieces, a word being led by the vocabulary's word mark; a character that is no piece is its bytes."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.size, self.end = model.get_piece_size(), model.eos_id()
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        found: dict[int, list[tuple[int, int]]] = {}
        scores = np.array([model.get_score(i) for i in range(self.size)])
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) and scores[i] > -1e8 for i in range(self.size)]
        for i in np.flatnonzero(normal).tolist():
            points = np.array([ord(c) for c in model.id_to_piece(i)], dtype=np.uint64)
            found.setdefault(len(points), []).append((int((points * self._powers(len(points))).sum(dtype=np.uint64)), i))
        self.longest, self.single = max(found), {ord(model.id_to_piece(i)) for _, i in found.get(1, [])}
        self.pieces = {}
        for length, rows in found.items():
            rows.sort()
            keys, ids = np.array([k for k, _ in rows], dtype=np.uint64), np.array([i for _, i in rows])
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[keys >> np.uint64(44)] = True
            self.pieces[length] = keys, ids, sieve
        # The file's scores are ranks; Zipf's law makes probabilities of them. Bytes and the end come last.
        rank = np.full(self.size, float(self.size))
        rank[normal] = -scores[normal]
        self.prior = 1 / (rank + 2.7)
        self.prior[[i for i in range(self.size) if not normal[i] and i not in set(self.bytes.tolist()) and i != self.end]] = 0
        self.prior /= self.prior.sum()

    @staticmethod
    @cache
    def _powers(n: int) -> np.ndarray:
        return np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))

    def edges(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For words of one length, as rows of code points: length of piece, rows, places and ids of all pieces in them."""
        hashes = np.zeros(points.shape, dtype=np.uint64)
        for length in range(1, min(self.longest, points.shape[1]) + 1):
            ends = points.shape[1] - length + 1
            hashes = hashes[:, :ends] + points[:, length - 1 :] * self._powers(length)[-1]
            if length in self.pieces:
                keys, ids, sieve = self.pieces[length]
                row, place = np.nonzero(sieve[hashes >> np.uint64(44)])
                wanted = hashes[row, place]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                yield length, row[hit], place[hit], ids[at[hit]]

    def byte_logs(self, points: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The log probability of every character as its bytes; only what is no piece itself may be read so."""
        own, which = np.unique(points, return_inverse=True)
        each = [-np.inf if int(p) in self.single else float(logs[self.bytes[list(chr(int(p)).encode("utf-8", "replace"))]].sum()) for p in own]
        return np.array(each)[which].reshape(points.shape)

    def forward(self, points: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
        """Log-space forward recursion over words of one length: alphas, the scores of edges by length, byte scores."""
        n, m = points.shape
        bytes_ = self.byte_logs(points, logs)
        score = {1: bytes_.copy()}
        for length, row, place, ids in self.edges(points):
            if length == 1:
                score[1][row, place] = np.logaddexp(score[1][row, place], logs[ids])
            else:
                score[length] = np.full((n, m - length + 1), -np.inf)
                score[length][row, place] = logs[ids]
        alpha = np.full((n, m + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, m + 1):
            ways = np.stack([alpha[:, end - k] + score[k][:, end - k] for k in score if k <= end])
            top = ways.max(axis=0)
            alpha[:, end] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha, score, bytes_

    def expected(self, points: np.ndarray, weights: np.ndarray, logs: np.ndarray, into: np.ndarray) -> None:
        """Adds to `into` how often each piece is expected in words that occur `weights` times."""
        alpha, score, bytes_ = self.forward(points, logs)
        n, m = points.shape
        beta = np.full((n, m + 1), -np.inf)
        beta[:, m] = 0
        for start in range(m - 1, -1, -1):
            ways = np.stack([beta[:, start + k] + score[k][:, start] for k in score if start + k <= m])
            top = ways.max(axis=0)
            beta[:, start] = top + np.log(np.exp(ways - top).sum(axis=0))
        total = alpha[:, m]
        for length, row, place, ids in self.edges(points):
            share = np.exp(alpha[row, place] + logs[ids] + beta[row, place + length] - total[row]) * weights[row]
            into += np.bincount(ids, weights=share, minlength=self.size)
        share = np.exp(alpha[:, :-1] + bytes_ + beta[:, 1:] - total[:, None]) * weights[:, None]
        own, which = np.unique(points, return_inverse=True)
        sums = np.bincount(which.reshape(-1), weights=share.reshape(-1), minlength=len(own))
        for p, s in zip(own.tolist(), sums.tolist(), strict=True):
            np.add.at(into, self.bytes[list(chr(p).encode("utf-8", "replace"))], s)


@cache
def _lattice(file: str) -> Lattice:
    return Lattice(file)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words in runs of one length: their places in the list, and rows of code points led by the word mark."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == length)
        step = max(1, _SLICE * 8 // (length + 1))
        for i in range(0, len(of), step):
            at = of[i : i + step]
            flat = "".join(words[k] for k in at.tolist()).encode("utf-32-le", "replace")
            points = np.full((len(at), length + 1), _MARK, dtype=np.uint64)
            points[:, 1:] = np.frombuffer(flat, dtype=np.uint32).reshape(len(at), length)
            yield at, points


def _count(column: str):
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        return output({"word": [w.decode("utf-8", "replace") for w in counts], "c": list(counts.values())}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, others, ends = Counter(), set(), 0
        for part in slices(batches, column):
            for text, held in zip(texts(part, column), part.column("held_out").to_pylist(), strict=True):
                words = text.lower().split()
                if held:
                    others.update(words)
                else:
                    learnt.update(words)
                    ends += 1
            if len(learnt) + len(others) > FLUSH_WORDS:
                yield out(learnt | Counter())
                yield out(Counter(dict.fromkeys(others - learnt.keys(), 0)))
                learnt, others = Counter(), set()
        learnt.update(dict.fromkeys(others - learnt.keys(), 0))
        learnt[b""] = ends
        yield out(learnt)

    return run


def _expect(file: str):
    schema = pa.schema([("piece", pa.int32()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(file)
        logs, total = np.log(np.maximum(lattice.prior, 1e-300)), np.zeros(lattice.size)
        for part in slices(batches, "word", 1 << 18):
            words, weights = part.column("word").to_pylist(), np.array(part.column("c").to_pylist(), dtype=np.float64)
            for at, points in by_length(words):
                if points.shape[1] > 1:
                    lattice.expected(points, weights[at], logs, total)
                else:
                    total[lattice.end] += weights[at].sum()
        used = np.flatnonzero(total)
        yield output({"piece": used.astype(np.int32), "expected": total[used]}, schema)

    return run


def _value(file: str, logs, tokens: int, distinct: int):
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(file)
        for part in slices(batches, "word", 1 << 18):
            words, c = part.column("word").to_pylist(), np.array(part.column("c").to_pylist(), dtype=np.float64)
            model = np.zeros(len(words))
            for at, points in by_length(words):
                model[at] = lattice.forward(points, logs.value)[0][:, -1] if points.shape[1] > 1 else logs.value[lattice.end]
            yield output({"word": part.column("word"), "c": part.column("c"), "base": np.log10((c + 1) / (tokens + distinct + 1)), "model": model / math.log(10)}, schema)

    return run


def _sum(column: str, head):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text_hash", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("rows", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = pickle.loads(head.value)
        get = figures.get
        for part in slices(batches, column):
            rows = []
            for doc_id, held, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts(part, column), strict=True):
                key = doc_id, held, xxhash.xxh3_64_intdigest(text) - (1 << 63)
                known, base, model, rest = 0, 0.0, 0.0, Counter()
                words = text.lower().split()
                for w, f in zip([*words, b""], map(get, [*words, b""]), strict=True):
                    if f is None:
                        rest[w] += 1
                    else:
                        known += f[0]
                        base += f[1]
                        model += f[2]
                rows.append((*key, None, len(words) + 1, 1, known, base, model))
                rows += [(*key, w.decode("utf-8", "replace"), n, 0, 0, 0.0, 0.0) for w, n in rest.items()]
            yield output(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return run


def _frequent(words: DataFrame, most: int = HEAD_WORDS) -> DataFrame:
    """The most frequent words (column `c`), `most` at most: all whose count reaches a bound, found from how many words have which size of count.

    Sizes are counts to eight leading bits, some thousands of classes at most, so that no task sends words of its own to be ranked.
    """
    bits = F.length(F.bin("c"))
    size = bits * 256 + F.expr("shiftright(c, greatest(length(bin(c)) - 8, 0))")
    classes = words.select(size.alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    total, least = 0, None
    for r in classes:
        total += r["n"]
        if total > most:
            break
        least = r["size"]
    return words.filter(size >= least) if least is not None else words.limit(0)


def score_texts(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Words, A-Z lower-cased, and one end are the tokens. All documents that are not held out give the counts of words. The base score
    is add-one smoothed over these. The model has the pieces of `file`, a sentencepiece vocabulary: its scores are the first
    probabilities of pieces, under which one pass of expectation over all counted words gives how often each piece occurs, and these
    give the probabilities that score. score is the log10 probability of the text, summed over all segmentations of its words, and
    the end.

    Figures of a word are made once, in the table of words. The HEAD_WORDS most frequent go to every task; the rest of a text's
    words meet theirs in a join on the word, which holds no hot word any more, and come back as sums.

    Null or empty text: the end alone. doc_id is read as a long. Null doc_id, or no number: hashed as an empty text. Rows with the same doc_id and text: summed together,
    then each returned. Other columns are not read. Empty table: empty.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(text).alias(text)).withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == HELD_FOLD)
    counted = rows.select(text, "held_out").mapInArrow(_count(text), "word string, c long")
    words = saved(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    lattice = _lattice(file)
    expected = words.filter("c > 0").mapInArrow(_expect(file), "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).toPandas()
    weight = lattice.prior * PRIOR
    weight[expected["piece"].to_numpy()] += expected["expected"].to_numpy()
    logs = context.broadcast(np.log(np.maximum(weight / weight.sum(), 1e-300)))
    figures = saved(words.mapInArrow(_value(file, logs, tokens, distinct), "word string, c long, base double, model double"), "figures")

    frequent = _frequent(figures).toPandas()
    known = dict(zip((w.encode() for w in frequent["word"]), zip((frequent["c"] > 0).astype(int).tolist(), frequent["base"].tolist(), frequent["model"].tolist(), strict=True), strict=True))
    parts = rows.mapInArrow(_sum(text, context.broadcast(pickle.dumps(known))), "doc_id long, held_out boolean, text_hash long, word string, n long, rows long, known long, base double, model double")
    parts = saved(parts, "parts")
    rare = figures.select("word", F.col("c").alias("w_c"), F.col("base").alias("w_base"), F.col("model").alias("w_model"))
    joined = parts.filter("word is not null").join(rare, "word").select("doc_id", "held_out", "text_hash", F.lit(0).cast("long").alias("n"), "rows", (F.col("n") * (F.col("w_c") > 0).cast("long")).alias("known"), (F.col("n") * F.col("w_base")).alias("base"), (F.col("n") * F.col("w_model")).alias("model"))
    sums = parts.filter("word is null").select(*joined.columns).unionAll(joined).groupBy("doc_id", "held_out", "text_hash").agg(*[F.sum(c).alias(c) for c in ("n", "rows", "known", "base", "model")])
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(
        "doc_id", "held_out", F.expr("n div rows").alias("n_tokens"), F.expr("known div rows").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"), (F.col("model") / F.col("rows")).alias("score"),
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
