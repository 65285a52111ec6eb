"""Packing by concatenate and cut: prefix sums over the tasks' token totals place every document, fixed windows cut the whole."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, prefix_sums, saved, slices, table, texts
from .token_count import _alphabet

WINDOW = 1024
#: The id that ends every document.
END = 0
#: Characters of text that the library takes at a time, where its splitter lets a text be parted.
PART_CHARS = 1 << 18
#: Bytes of text, and of ids, that a worker holds at a time; a longer document stands alone.
PASS_BYTES = 1 << 20

#: The splitter of byte-level files, a fixed value.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between two ASCII letters the byte-level splitter begins a new word at a space, whatever stands around.
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts as the `tokenizers` library gives them for its file.

    A byte-level BPE whose tokens are numbered as they are merged is run by `tiktoken`, which is given the file's own vocabulary and
    splitter and gives the same ids at a quarter of the cost; all other files are run by the library itself. Long texts go in
    parts wherever the splitter makes the parts' ids those of the whole.
    """

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        model, split, added = made["model"], made.get("pre_tokenizer") or {}, made["added_tokens"]
        plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and " " not in t["content"] for t in added)
        self.parted = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if self.parted and model["type"] == "BPE" and not any(model.get(x) for x in options) and self._by_rank(model):
            import tiktoken

            byte = _alphabet()
            special = {t["content"]: t["id"] for t in added}
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self._ids = partial(tiktoken.Encoding(file, pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy, allowed_special="all")
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(file)
            self._ids = lambda x: library.encode(x, add_special_tokens=False).ids

    @staticmethod
    def _by_rank(model: dict) -> bool:
        """Whether ids are 256 bytes, then the merges in their order."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and {model["vocab"].get(c) for c in _alphabet()} == set(range(256))

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.parted and len(text) - at > PART_CHARS:
            seam = _SEAM.search(text, at + PART_CHARS)
            if not seam:
                break
            out.append(text[at : seam.start()])
            at = seam.start()
        return [*out, text[at:]]

    def ids(self, text: str) -> np.ndarray:
        found = [np.asarray(self._ids(p), dtype="<u4") for p in self.parts(text)]
        return np.concatenate(found) if len(found) > 1 else found[0]


_encoders: dict[str, Encoder] = {}


def _encode(schema: T.StructType, column: str, file: str, end: int, n: dict[str, str]):
    """Adds ids (with the end), their number, the task, and the task's tokens before the row."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _encoders:
            _encoders[file] = Encoder(file)
        encoder, before = _encoders[file], 0
        task, last = TaskContext.get().partitionId(), np.array([end], dtype="<u4")
        for part in slices(batches, column, PASS_BYTES):
            ids = [np.append(encoder.ids(x.decode("utf-8", "replace")), last) for x in texts(part, column)]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            made = {n["ids"]: pa.array([x.tobytes() for x in ids], pa.binary()), n["tokens"]: pa.array(sizes), n["task"]: pa.array([task] * len(ids), pa.int32()), n["before"]: pa.array(starts)}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else part.column(x) for x in names], names=names)

    return run


def _cut(schema: T.StructType, kept: list[str], n: dict[str, str], window: int, with_ids: bool):
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, n["ids"], PASS_BYTES):
            at = np.asarray(part.column(n["before"]))
            sizes = np.asarray(part.column(n["tokens"]))
            first, last = at // window, (at + sizes - 1) // window
            of = np.repeat(np.arange(len(at)), last - first + 1)
            sequence = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[of]
            start = np.maximum(sequence * window - at[of], 0)
            stop = np.minimum((sequence + 1) * window - at[of], sizes[of])
            whole = [memoryview(x) for x in part.column(n["ids"]).to_pylist()]
            pieces = [whole[d][4 * a : 4 * b] for d, a, b in zip(of.tolist(), start.tolist(), stop.tolist(), strict=True)]
            made = {
                "start": pa.array(start), "length": pa.array(stop - start), "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()), "doc_tokens": pa.array(sizes[of]),
                "sequence_id": pa.array(sequence), "offset": pa.array(at[of] + start - sequence * window),
            }
            if with_ids:
                made["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in pieces], pa.list_(pa.int32()))
            rows = {x: part.column(x).take(pa.array(of)) for x in kept}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else rows[x] for x in names], names=names)

    return run


def pack(docs: DataFrame, file: str, text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents, laid end to end and cut every `window` tokens: one row for each window that a document touches.

    A piece has the document's columns but its text, the boundary record (`start`, tokens of its document before it, `length`,
    `doc_tokens`, `sequence_id`, `offset` in the sequence), `ids_crc32` of its ids as little-endian unsigned 32-bit numbers, and,
    if wanted, `ids`. All sequences but the last are full.

    The first pass turns texts into ids once, as the library does with the tokenizer `file`, a path that every worker can read, without
    special tokens but with `end` behind each document, and saves them with each row's place among the tokens of its task. Prefix
    sums over one total per task then place every task's tokens; the second pass adds them and cuts, with no shuffle. The order is
    that of the saved rows: a task that is lost and run again can change neither.

    Null or empty text: the end alone. Very long texts: whole; the library gets them in parts where that changes no id. Repeated
    rows: each packed. Columns named like the new ones are replaced. Empty table: no pieces.
    """
    new = {f.name for f in T.StructType.fromDDL(_PIECE)} | {"ids", text.lower()}
    kept = [c for c in docs.columns if c.lower() not in new]
    n = {c: free_name(docs, f"pack_{c}") for c in ("text", "ids", "tokens", "task", "before")}
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(n["text"]))
    own = T.StructType([f for f in rows.schema.fields if f.name != n["text"]])
    placed = T.StructType(own.fields + list(T.StructType.fromDDL(f"`{n['ids']}` binary, `{n['tokens']}` long, `{n['task']}` int, `{n['before']}` long")))
    encoded = saved(rows.mapInArrow(_encode(placed, n["text"], file, end, n), placed), "encoded")
    totals = encoded.groupBy(n["task"]).agg(F.sum(n["tokens"]).alias("total"))
    offset = free_name(encoded, "pack_offset")
    tasks = prefix_sums(totals, [F.col(n["task"])], {offset: F.col("total")}, spread=False).select(n["task"], offset)
    # One row of a number per task of the first pass.
    rows = encoded.join(F.broadcast(tasks), n["task"]).withColumn(n["before"], F.col(n["before"]) + F.col(offset)).drop(n["task"], offset)
    schema = T.StructType(own.fields + list(T.StructType.fromDDL(_PIECE + (", ids array<int>" if with_ids else ""))))
    return rows.mapInArrow(_cut(schema, kept, n, window, with_ids), schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = END, key: str = "doc_id") -> DataFrame:
    """From pieces with `ids` to one row a sequence: `sequence_id`, `ids`, `length` before padding, and `pieces`, its boundary records.

    Ids are padded to `window`, but for a sequence whose length is a power of two. A sequence has `window` pieces at most. Null
    keys stay null. Empty table: empty.
    """
    one = F.struct("offset", F.col(f"`{key}`").alias("key"), "start", F.col("length").alias("length"), "doc_tokens", "ids")
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p"), F.sum("length").alias("length"))
    size: Column = F.col("length").cast("int")
    ids = F.flatten(F.col("p.ids"))
    padded = F.when(F.bit_count(size) == 1, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), F.lit(window) - size)))
    return got.select("sequence_id", padded.alias("ids"), "length", F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["key"].alias(key), x["start"].alias("start"), x["length"].alias("length"), x["doc_tokens"].alias("doc_tokens"))).alias("pieces"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
