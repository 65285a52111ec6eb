"""Learnt scores held against all segmentations written out; what learning changes against the file's own scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from adjudex.llm import lm_score
from adjudex.llm.queries import QUERIES

from ..conftest import SF


@pytest.fixture(scope="module")
def file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text, ids, lattice):
    """All ways to read a text, each as a list of piece ids."""
    if not text:
        return [[]]
    ways = [[ids[text[:n]], *rest] for n in range(1, len(text) + 1) if text[:n] in ids and lattice.prior[ids[text[:n]]] > 0 for rest in segmentations(text[n:], ids, lattice)]
    if ord(text[0]) not in lattice.single:
        own = [int(lattice.bytes[b]) for b in text[0].encode()]
        ways += [[*own, *rest] for rest in segmentations(text[1:], ids, lattice)]
    return ways


def test_whole_scores_equal_all_segmentations(spark, file):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    ids, lattice = {model.id_to_piece(i): i for i in range(model.get_piece_size())}, lm_score.Lattice(file)
    texts = {i: " ".join(("the cat", "été né", "sat on", "漢字", "THE end", "x9 zq")[(i + k) % 6] for k in range(i % 4)) for i in range(40)} | {90: None, 91: "", 92: "ça ß"}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*(w.decode() for w in (t or "").encode().lower().split()), ""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    prior = lattice.prior
    weight = prior * lm_score.PRIOR
    ways = {w: [[lattice.end]] if not w else segmentations("▁" + w, ids, lattice) for ws in tokens.values() for w in ws}
    for w, n in counts.items():
        p = np.array([math.prod(prior[i] for i in way) for way in ways[w]])
        for way, share in zip(ways[w], p / p.sum(), strict=True):
            for i in way:
                weight[i] += n * share
    learnt = weight / weight.sum()
    score = {w: math.log10(math.fsum(math.prod(learnt[i] for i in way) for way in some)) for w, some in ways.items()}
    assert len(ways["the"]) > 3 and any(held.values()) and not all(held.values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for r in lm_score.score_texts(docs, file).collect():
        assert r["score"] == pytest.approx(sum(score[w] for w in tokens[r["doc_id"]]), rel=1e-9)


def test_learning_gains_on_the_files_own_scores(spark, file):
    lattice = lm_score.Lattice(file)
    logs = np.log(np.maximum(lattice.prior, 1e-300))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own, learnt, tokens = 0.0, 0.0, 0
    for r in QUERIES["op10_lm_score"](spark, SF).filter("held_out").collect():
        words = [w.decode() for w in docs[r["doc_id"]].encode().lower().split()]
        own += logs[lattice.end]
        for _, points in lm_score.by_length(words):
            own += lattice.forward(points, logs)[0][:, -1].sum()
        learnt += r["score"] * math.log(10)
        tokens += r["n_tokens"]
    print(f"log10 probability of a held-out token: {own / tokens / math.log(10):.3f} by the file's own scores, {learnt / tokens / math.log(10):.3f} learnt")
    assert learnt > own + 0.1 * tokens
