"""A corpus written with its manifest in one commit, and files read against a lock of their digests: Python data sources."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST, LOCK = "manifest.json", "source-lock.json"
#: Bytes read at a time, and bytes of small files that one task reads.
CHUNK, TASK_BYTES = 4 << 20, 64 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, as far as Arrow knows it, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


# --- writing ---------------------------------------------------------------------------------------------------------------------


@dataclass
class Part:
    """A file that a task has written: its split, name, rows, bytes, digest, groups, and the sums of its rows' counts."""

    split: str
    file: str
    rows: int
    bytes: int
    sha256: str
    groups: int
    counts: dict


@dataclass
class Parts(WriterCommitMessage):
    parts: list


class CorpusWriter(DataSourceArrowWriter):
    """Tasks write lines into files that nobody looks for; the driver's commit names those of the tasks that count in one manifest."""

    def __init__(self, path: str, extra: str, overwrite: bool):
        self.path, self.extra, self.overwrite, self.job = path, json.loads(extra), overwrite, uuid.uuid4().hex
        fs, root = _place(path)
        if not overwrite and fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{path} has a manifest already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        """Rows come in order of split and group. A failed attempt removes what it has written."""
        fs, root = _place(self.path)
        task, attempt = TaskContext.get().partitionId() if TaskContext.get() else 0, uuid.uuid4().hex[:12]
        parts, out, digest, group = [], None, None, None
        try:
            for batch in iterator:
                for split, own, record, counts in zip(*[batch.column(c).to_pylist() for c in ("split", "group_id", "record", "counts")], strict=True):
                    if not parts or parts[-1].split != split:
                        if out:
                            out.close()
                            parts[-1].sha256 = digest.hexdigest()
                        folder = f"data/{self.job}/{split}"
                        fs.create_dir(f"{root}/{folder}", recursive=True)
                        parts.append(Part(split, f"{folder}/part-{task:05d}-{attempt}.jsonl", 0, 0, "", 0, Counter()))
                        out, digest, group = fs.open_output_stream(f"{root}/{parts[-1].file}", buffer_size=CHUNK), hashlib.sha256(), None
                    line, part = record.encode() + b"\n", parts[-1]
                    out.write(line)
                    digest.update(line)
                    part.rows += 1
                    part.bytes += len(line)
                    part.groups += group != (own,)
                    group = (own,)
                    for name, n in counts or ():
                        part.counts[name] += n
            if out:
                out.close()
                parts[-1].sha256 = digest.hexdigest()
        except BaseException:
            if out and not out.closed:
                out.close()
            for part in parts:
                if fs.get_file_info(f"{root}/{part.file}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{root}/{part.file}")
            raise
        return Parts(parts)

    def commit(self, messages: list) -> None:
        """Writes the manifest beside its place, then renames it; removes files of attempts that don't count, and data that no manifest names any more."""
        fs, root = _place(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.split, p.file))
        splits = {}
        for p in parts:
            s = splits.setdefault(p.split, {"rows": 0, "bytes": 0, "groups": 0, "counts": Counter(), "parts": []})
            s["rows"], s["bytes"], s["groups"] = s["rows"] + p.rows, s["bytes"] + p.bytes, s["groups"] + p.groups
            s["counts"].update(p.counts)
            s["parts"].append({"name": p.file, "rows": p.rows, "bytes": p.bytes, "sha256": p.sha256})
        for s in splits.values():
            s["sha256"] = hashlib.sha256("".join(p["sha256"] for p in s["parts"]).encode()).hexdigest()
        fs.create_dir(f"{root}/data", recursive=True)
        text, beside = json.dumps({**self.extra, "splits": splits}, ensure_ascii=False, indent=1, sort_keys=True), f"{root}/{MANIFEST}.{self.job}.partial"
        with fs.open_output_stream(beside) as out:
            out.write(text.encode())
        if not self.overwrite and fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} has got a manifest meanwhile")
        fs.move(beside, f"{root}/{MANIFEST}")
        named = {f"{root}/{p.file}" for p in parts}
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/data", recursive=True)):
            if info.is_file and info.path not in named and (self.overwrite or f"/data/{self.job}/" in info.path):
                fs.delete_file(info.path)

    def abort(self, messages: list) -> None:
        fs, root = _place(self.path)
        for place in (f"{root}/data/{self.job}", f"{root}/{MANIFEST}.{self.job}.partial"):
            kind = fs.get_file_info(place).type
            if kind == pafs.FileType.Directory:
                fs.delete_dir(place)
            elif kind == pafs.FileType.File:
                fs.delete_file(place)


class CorpusSource(DataSource):
    """Format `adjudex_corpus`: option `path`, and `extra`, JSON that goes into the manifest."""

    @classmethod
    def name(cls) -> str:
        return "adjudex_corpus"

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options["path"], self.options.get("extra", "{}"), overwrite)


def corpus_faults(rows: DataFrame) -> DataFrame:
    """What keeps rows (`id`, `split`, `group_id`, `contexts`) from being a corpus: (`fault`, `what`) for repeated or null ids, and groups or contexts in two splits."""
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select(F.lit("repeated id").alias("fault"), F.col("id").cast("string").alias("what"))
    two = lambda df, column, fault: df.groupBy(column).agg(F.min("split").alias("x"), F.max("split").alias("y")).filter("x <> y").select(F.lit(fault).alias("fault"), F.col(column).cast("string").alias("what"))
    contexts = rows.select("split", F.explode("contexts").alias("context"))
    return ids.unionAll(two(rows, "group_id", "group in two splits")).unionAll(two(contexts, "context", "context in two splits"))


def write_corpus(rows: DataFrame, path: str, parts: int, extra: dict | None = None, overwrite: bool = False) -> None:
    """Writes rows (`id`, `split`, `group_id`, `contexts` array, `record` a line of JSON, `counts` map of names to numbers) and their manifest.

    All faults of the whole table come first, see `corpus_faults`; with any, nothing is written. Rows go to `parts` tasks by group and lie
    in order of split, group and id, so the same rows give the same bytes and digests. Each task hands back rows, bytes, digest, number of groups
    and summed counts of its files; the commit puts these into `manifest.json` and publishes it in one rename. Until then readers see the old
    corpus or none. Files of lost attempts go with the commit, all files of a failed job with its abort. A digest of a split is
    that of its parts' digests in order. A null record is an error of its task; null counts count nothing. Empty table: a manifest without splits.

    `path` must be one that all executors can write by Arrow: a shared folder, or an object store.
    """
    fault = corpus_faults(rows).first()
    if fault:
        raise ValueError(f"not written: {fault['fault']}: {fault['what']}")
    rows.sparkSession.dataSource.register(CorpusSource)
    dealt = rows.select("id", "split", "group_id", "record", "counts").repartition(parts, "group_id").sortWithinPartitions("split", "group_id", "id")
    dealt.write.format("adjudex_corpus").option("path", path).option("extra", json.dumps(extra or {})).mode("overwrite" if overwrite else "append").save()


def manifest(path: str) -> dict:
    """The manifest of a corpus."""
    fs, root = _place(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


# --- reading -----------------------------------------------------------------------------------------------------------------------


def locked_entries(path: str) -> list[dict]:
    """`name`, `sha256` and, where known, `bytes` of a folder's lock file, or of a corpus's manifest."""
    fs, root = _place(path)
    for name in (LOCK, MANIFEST):
        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
            continue
        with fs.open_input_stream(f"{root}/{name}") as f:
            lock = json.loads(f.read())
        return lock["files"] if name == LOCK else [p for s in lock["splits"].values() for p in s["parts"]]
    raise ValueError(f"{path} has neither {LOCK} nor {MANIFEST}")


@dataclass
class Files(InputPartition):
    entries: list


class _Digested(io.RawIOBase):
    """A stream that digests what is read from it."""

    def __init__(self, source):
        self.source, self.digest, self.bytes = source, hashlib.sha256(), 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.source.read(len(buffer))
        buffer[: len(got)] = got
        self.digest.update(got)
        self.bytes += len(got)
        return len(got)


class LockedReader(DataSourceReader):
    """Plans tasks from the lock's entries; each file is digested while its rows are read, and a task with a wrong file fails by its name."""

    def __init__(self, path: str, kind: str, sep: str):
        self.path, self.kind, self.sep = path, kind, sep

    def partitions(self) -> list[Files]:
        fs, root = _place(self.path)
        tasks, held = [], 0
        for entry in locked_entries(self.path):
            info = fs.get_file_info(f"{root}/{entry['name']}")
            if not info.is_file:
                raise ValueError(f"{entry['name']} is locked and missing")
            if not tasks or held + info.size > TASK_BYTES:
                tasks.append(Files([]))
                held = 0
            tasks[-1].entries.append(entry)
            held += info.size
        return tasks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _place(self.path)
        for entry in partition.entries:
            name = entry["name"]
            with fs.open_input_file(f"{root}/{name}") as source:
                whole = _Digested(source)
                stream = io.BufferedReader(whole, CHUNK)
                if self.kind == "zip":  # the archive's table stands at its end, so its bytes are gone through first
                    while stream.read(CHUNK):
                        pass
                    self._check(name, entry, whole)
                    source.seek(0)
                    with zipfile.ZipFile(source) as archive:
                        for member in sorted(archive.namelist()):
                            if not member.endswith("/"):
                                with archive.open(member) as inner:
                                    yield from _batches(name, self._fields(name, member, inner), FIELDS)
                    continue
                yield from _batches(name, self._fields(name, None, stream), FIELDS) if self.kind == "csv" else _batches(name, self._lines(name, stream), LINES)
                while stream.read(CHUNK):
                    pass
                self._check(name, entry, whole)

    @staticmethod
    def _check(name: str, entry: dict, read: _Digested) -> None:
        if read.digest.hexdigest() != entry["sha256"].lower() or entry.get("bytes", read.bytes) != read.bytes:
            raise ValueError(f"{name} is not the locked file: {read.bytes} bytes, sha256 {read.digest.hexdigest()}")

    @staticmethod
    def _lines(name: str, stream) -> Iterator[tuple]:
        for n, line in enumerate(stream):
            try:
                yield n, line.rstrip(b"\r\n").decode()
            except UnicodeDecodeError as error:
                raise ValueError(f"{name}, line {n}: {error}") from None

    def _fields(self, name: str, member: str | None, stream) -> Iterator[tuple]:
        """Rows by the names of the header. A row with more or fewer fields than that is an error that names its place."""
        text = io.TextIOWrapper(stream, "utf-8-sig", newline="")
        rows = csv.reader(text, delimiter=self.sep, strict=True)
        header = next(rows, None)
        where = name if member is None else f"{name}, {member}"
        if not header or len(set(header)) != len(header):
            raise ValueError(f"{where}: no header, or names twice")
        n = 0
        for row in rows:
            if not row:
                continue
            if len(row) != len(header):
                raise ValueError(f"{where}, line {rows.line_num}: {len(row)} fields for {len(header)} names")
            yield member, n, list(zip(header, row, strict=True))
            n += 1
        text.detach()  # whoever opened the stream reads on


LINES = pa.schema([("file", pa.string()), ("line", pa.int64()), ("value", pa.string())])
FIELDS = pa.schema([("file", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])


def _batches(name: str, rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a file's rows, of `most` rows or about CHUNK bytes."""
    held, size = [], 0
    for row in rows:
        held.append((name, *row))
        size += len(row[-1]) if isinstance(row[-1], str) else sum(len(v) for _, v in row[-1])
        if len(held) == most or size >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class LockedSource(DataSource):
    """Format `adjudex_locked`: options `path`, `kind` (lines, csv or zip) and `sep`."""

    @classmethod
    def name(cls) -> str:
        return "adjudex_locked"

    def schema(self) -> str:
        return "file string, line long, value string" if self.options.get("kind", "lines") == "lines" else "file string, member string, line long, fields map<string,string>"

    def reader(self, schema) -> LockedReader:
        return LockedReader(self.options["path"], self.options.get("kind", "lines"), self.options.get("sep", ","))


def read_locked(spark: SparkSession, path: str, kind: str = "lines", sep: str = ",") -> DataFrame:
    """The rows of all files that a folder's lock (or a corpus's manifest) names, and of no others.

    kind `lines`: `file`, `line` from 0, `value`. `csv`: `file`, `line` of the rows from 0, `fields` by the header's names, `member` null. `zip`: the same
    of every member of ZIP files, in order of names. A locked file that is missing, or whose bytes aren't those of its digest, is an error that names it.
    Files are streamed, so one larger than memory is read; one file is read by one task, as its digest runs through it, small files together.
    An empty file has no rows; without a header, csv and zip say so.
    """
    spark.dataSource.register(LockedSource)
    return spark.read.format("adjudex_locked").option("path", path).option("kind", kind).option("sep", sep).load()
