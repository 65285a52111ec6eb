"""Quality rules: figures of each text, and lines that recur across the documents of a host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, output, saved, slices, table, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: A line is removed when more documents of its host than this have it.
MOST_DOCUMENTS = 20
#: A document is rejected when less than this share of its words is left.
LEAST_LEFT = 0.3
MIN_WORDS = 50
#: Removed lines that are broadcast (8 bytes each); more of them go to the texts by joins.
MOST_LINES = 1 << 20
#: Deals of a line in that join.
DEALS = 16

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def normalised(line: bytes) -> bytes:
    """Lower-cased, white space squeezed, digits as 0; empty if the line has no word."""
    return re.sub(rb"[0-9]", b"0", b" ".join(line.lower().split()))


def line_keys(host: str | None, text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text and a 64-bit key of each, from host and normalised line; 0 for lines without a word."""
    lines = text.split(b"\n")
    at = b"\x00" if host is None else b"\x01" + host.encode() + b"\n"
    keys = [(xxhash.xxh3_64_intdigest(at + n) or 1) if (n := normalised(x)) else 0 for x in lines]
    return lines, np.array(keys, dtype=np.uint64).view(np.int64)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    k = len(ids)
    pairs = np.unique(a[:-1] * k + a[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * k + a[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    hit = np.zeros(n, dtype=bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = len(text.translate(None, SPACES).decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def _text_key(text: bytes) -> int:
    """Of a whole text, as it stands: only copies share one."""
    return _signed(xxhash.xxh3_64_intdigest(text))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _lines_of(column: str, host: str):
    schema = pa.schema([("line", pa.int64()), ("document", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            lines, documents = [], []
            for h, text in zip(part.column(host).to_pylist(), texts(part, column), strict=True):
                keys = line_keys(h, text)[1]
                own = np.unique(keys[keys != 0])
                lines.append(own)
                documents.append(np.full(len(own), _text_key(text), dtype=np.int64))
            yield output({"line": np.concatenate(lines), "document": np.concatenate(documents)}, schema)

    return run


def lines_of(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(`line`, `document`): each line of a document once, both as keys; exact copies within a host are one document."""
    return docs.select(F.col(f"`{text}`"), F.col(f"`{host}`").cast("string").alias(f"{host}")).mapInArrow(_lines_of(text, host), "line long, document long").distinct()


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", most: int = MOST_DOCUMENTS) -> DataFrame:
    """`line`: keys of lines that more than `most` distinct documents of their host have.

    Documents of a host with the same text are one; near copies, and pages that differ in a number, each count. Both counts are aggregated before they are shuffled, and cover all
    documents and lines.
    """
    return lines_of(docs, text, host).groupBy("line").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > most).select("line")


def _judge(schema: T.StructType, column: str, host: str, gone: str | None, known, least: float, min_words: int):
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = np.sort(np.frombuffer(known.value, dtype=np.int64)) if known else None
        for part in slices(batches, column):
            rows, left = [], []
            own = part.column(gone).to_pylist() if gone else [None] * part.num_rows
            for h, text, some in zip(part.column(host).to_pylist(), texts(part, column), own, strict=True):
                lines, keys = line_keys(h, text)
                listed = np.sort(np.array(some or [], dtype=np.int64)) if everywhere is None else everywhere
                at = np.minimum(np.searchsorted(listed, keys), max(len(listed) - 1, 0))
                out = (listed[at] == keys) & (keys != 0) if len(listed) else np.zeros(len(keys), dtype=bool)
                clean = b"\n".join(x for x, o in zip(lines, out.tolist(), strict=True) if not o)
                rows.append((*base_figures(text), len(clean.split())))
                left.append(clean.decode("utf-8", "replace"))
            n, chars, symbols, dup, repeat, rest = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            failed = (n < min_words) | (100 * repeat > 50 * n)
            made = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_words_left": rest, "base_failed": failed, "kept": ~failed & (rest >= least * n)}
            made = {k: pa.array(v) for k, v in made.items()} | {"clean_text": pa.array(left, pa.string())}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else part.column(x) for x in names], names=names)

    return run


def judge_lines(docs: DataFrame, text: str = "text", host: str = "source", most: int = MOST_DOCUMENTS, least: float = LEAST_LEFT, min_words: int = MIN_WORDS, most_lines: int = MOST_LINES) -> DataFrame:
    """`docs` with figures of each whole text, `clean_text` (without the lines above the limit), `n_words_left`, `base_failed` and `kept`.

    kept is false if base_failed (under `min_words` words, or more than half of them in repeated windows of three), or if less than
    `least` of the words is left. Up to `most_lines` removed lines are broadcast as keys of 8 bytes, and no text is shuffled. Where
    there are more, each text gets its own removed lines by a join on the line, dealt DEALS times against hot lines, and one on
    the text's key.

    Null or empty text: no words, fails the base rule, clean_text empty. Null host: a host of its own. Repeated rows: each judged;
    they count as one document for their lines. Columns named like the new ones are replaced, all others pass through. Empty
    table: empty.
    """
    new = ["clean_text", "n_words_left", "base_failed", "kept"] + [x.split()[0] for x in _BASE.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in new]
    name, document, gone = (free_name(docs, c) for c in ("host_name", "document", "gone"))
    source = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{host}`").cast("string").alias("h"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{host}`").cast("string").alias(name))
    if text not in kept:
        raise ValueError(f"the text column cannot be named {text}")
    found = saved(frequent_lines(source, "t", "h", most), "lines")
    known = None
    if found.count() <= most_lines:
        known = docs.sparkSession.sparkContext.broadcast(found.toPandas()["line"].to_numpy(np.int64).tobytes())
    else:
        each = found.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        pairs = lines_of(source, "t", "h").withColumn("deal", F.pmod("document", F.lit(DEALS)).cast("int"))
        own = saved(pairs.join(each, ["line", "deal"]).groupBy(F.col("document").alias(document)).agg(F.collect_list("line").alias(gone)), "gone")
        rows = rows.mapInArrow(_with_key(rows.schema, text, document), T.StructType([*rows.schema.fields, T.StructField(document, T.LongType())]))
        rows = rows.join(own.hint("merge"), document, "left").drop(document)
    out = T.StructType([f for f in rows.schema.fields if f.name not in (name, gone)] + list(T.StructType.fromDDL(f"{_BASE}, n_words_left long, base_failed boolean, kept boolean, clean_text string")))
    return rows.mapInArrow(_judge(out, text, name, None if known else gone, known, least, min_words), out)


def _with_key(schema: T.StructType, column: str, document: str):
    """Adds the text's key; a text without words has none of the lines, so it gets a number of its own instead of one key for all."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = count(TaskContext.get().partitionId() << 40)
        for part in slices(batches, column):
            keys = [_text_key(t) if t and not t.isspace() else next(own) for t in texts(part, column)]
            yield pa.RecordBatch.from_arrays([*[part.column(x) for x in names], pa.array(keys, pa.int64())], names=[*names, document])

    return run


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *[x.split()[0] for x in _BASE.split(", ")], "base_failed", "kept", "n_words_left")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
ln AS (SELECT r, source, unnest(string_split(text, chr(10))) AS raw FROM d),
lw AS (SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lws FROM ln),
lk AS (SELECT r, source, raw, len(lws) AS n, regexp_replace(array_to_string(lws, ' '), '[0-9]', '0', 'g') AS line FROM lw WHERE len(lws) > 0),
freq AS (SELECT source, line FROM (SELECT DISTINCT lk.source, line, md5(text) AS document FROM lk JOIN d USING (r)) GROUP BY source, line HAVING count(*) > 20),
gone AS (SELECT r, sum(n) AS words FROM lk JOIN freq ON lk.line = freq.line AND lk.source IS NOT DISTINCT FROM freq.source GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n_dup FROM lk GROUP BY r),
wd AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
tri AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM wd WINDOW o AS (PARTITION BY r ORDER BY i)),
triw AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM triw WHERE c > 1) GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(words, 0))::BIGINT AS n_words_left
  FROM d LEFT JOIN gone USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 0.3 * n_words AS kept FROM f
"""
