"""Packing held against the library, window by window; encoders against each other."""

import random
import zlib

import numpy as np
import pytest

from adjudex.llm import packing
from adjudex.llm.packing import Encoder, pack, sequences
from adjudex.llm.queries import QUERIES

from ..conftest import SF


@pytest.fixture(scope="module")
def file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def held(rows, texts, library, window):
    """Every sequence is filled without a gap, every id of every document lies in one piece, and the numbers are the library's."""
    filled, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    assert sorted(filled) == list(range(len(filled)))
    for k, places in filled.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == window or (k == len(filled) - 1 and at < window)


def test_query_packs_the_librarys_ids(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held(QUERIES["op11_packing"](spark, SF).collect(), docs, library, 1024)


def test_odd_texts_over_many_tasks(spark, file, library):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: " \n\t ", 5: "a<|endoftext|> b<|endoftext|>", 6: "x" * 30000, 7: "l'été où on va   \n\n 12,5", 8: "東京 " * 900, None: "no id"}
    docs = spark.createDataFrame([(k, v, 7, "kept") for k, v in texts.items()], "doc_id long, text string, start int, other string").repartition(5)
    got = pack(docs, file, window=64)
    assert got.columns.count("start") == 1 and {r["other"] for r in got.collect()} == {"kept"}
    held(got.collect(), texts, library, 64)


def test_repeated_rows_and_empty_table(spark, file):
    docs = spark.createDataFrame([(1, "the same text")] * 40, "doc_id long, text string").repartition(3)
    got = pack(docs, file, window=32).collect()
    assert sum(r["length"] for r in got) == 40 * got[0]["doc_tokens"] and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    empty = pack(docs.limit(0), file)
    assert empty.count() == 0 and sequences(empty).count() == 0


def test_sequences_hold_the_pieces(spark, file, library):
    texts = {i: "some words of text " * i for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["sequence_id"]: r for r in sequences(pack(docs, file, window=128), 128).collect()}
    parts = {}
    for k, r in sorted(rows.items()):
        assert len(r["ids"]) == 128 or (len(r["ids"]) == r["length"] and r["length"].bit_count() == 1)
        assert set(r["ids"][r["length"] :]) <= {0} and sum(p["length"] for p in r["pieces"]) == r["length"]
        for p in r["pieces"]:
            parts.setdefault(p["doc_id"], []).extend(r["ids"][p["offset"] : p["offset"] + p["length"]])
    assert parts == {k: [*library.encode(v, add_special_tokens=False).ids, 0] for k, v in texts.items()}


def test_parts_of_long_texts_change_no_id(file, library, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(packing, "PART_CHARS", 7)
    encoder = Encoder(file)
    assert encoder.parted and len(encoder.parts("one two three four")) > 1
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", " ", "  ", "'s", "'", "\n", "7", ".", "<|endoftext|>", "don't go", "́"]) for _ in range(40))
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    text = "Some words. " * 50
    encoder = Encoder(file)
    assert not encoder.parted and encoder.ids(text).tolist() == Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids
