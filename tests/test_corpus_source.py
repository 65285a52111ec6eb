"""The corpus writer leaves a whole corpus with its manifest or nothing; the locked reader gives the locked bytes or an error."""

import hashlib
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from adjudex.sources import corpus


def rows_of(spark, n=60, **change):
    rows = [{"id": i, "split": ("train", "test")[i % 3 == 0], "group_id": i - i % 6 + (i % 3 == 0), "contexts": [f"c{i}"], "record": json.dumps({"id": i, "t": "é\n" * (i % 5)}, ensure_ascii=False), "counts": {"examples": i % 4, f"source/{i % 2}": 1}} for i in range(n)]
    for i, values in change.get("change", {}).items():
        rows[i] |= values
    return spark.createDataFrame(rows, "id long, split string, group_id long, contexts array<string>, record string, counts map<string,long>")


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def recount(rows, path):
    """The manifest agrees with the rows, and with the bytes that lie there; no other file does."""
    found = corpus.manifest(path)
    assert files(path) == sorted([corpus.MANIFEST, *(p["name"] for s in found["splits"].values() for p in s["parts"])])
    for split, s in found["splits"].items():
        own = rows.filter(F.col("split") == split)
        lines = [r["record"] for r in own.collect()]
        parts = [open(os.path.join(path, p["name"]), "rb").read() for p in s["parts"]]
        assert sorted(b"".join(parts).decode().split("\n")[:-1]) == sorted(lines)
        assert (s["rows"], s["bytes"], s["groups"]) == (len(lines), sum(map(len, parts)), own.select("group_id").distinct().count())
        assert [(p["rows"], p["bytes"], p["sha256"]) for p in s["parts"]] == [(x.count(b"\n"), len(x), hashlib.sha256(x).hexdigest()) for x in parts]
        counts = {}
        for r in own.collect():
            for k, v in (r["counts"] or {}).items():
                counts[k] = counts.get(k, 0) + v
        assert s["counts"] == counts
    return found


def test_manifest_is_a_recount_and_reruns_agree(spark, tmp_path):
    rows, digests = rows_of(spark), []
    for name in "ab":
        path = str(tmp_path / name)
        corpus.write_corpus(rows.repartition(7), path, 3, {"version": 2})
        found = recount(rows, path)
        assert found["version"] == 2
        digests.append({k: s["sha256"] for k, s in found["splits"].items()})
    with pytest.raises(Exception, match="manifest already"):
        corpus.write_corpus(rows, str(tmp_path / "a"), 3)
    recount(rows, str(tmp_path / "a"))
    corpus.write_corpus(rows.limit(20), str(tmp_path / "a"), 2, overwrite=True)
    recount(rows.limit(20), str(tmp_path / "a"))
    corpus.write_corpus(rows.limit(0), str(tmp_path / "c"), 2)
    assert corpus.manifest(str(tmp_path / "c"))["splits"] == {}


@pytest.mark.parametrize("what, said", [({5: {"id": 4}}, "repeated id: 4"), ({5: {"id": None}}, "repeated id"), ({1: {"split": "test"}}, "group in two splits"), ({3: {"contexts": ["c1"]}}, "context in two splits: c1")])
def test_faults_leave_nothing(spark, tmp_path, what, said):
    with pytest.raises(ValueError, match=said):
        corpus.write_corpus(rows_of(spark, change=what), str(tmp_path / "x"), 2)
    assert files(tmp_path) == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="encode"):
        corpus.write_corpus(rows_of(spark, change={30: {"record": None}}), str(tmp_path / "x"), 3)
    assert files(tmp_path) == []


RETRY = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from adjudex.sources import corpus
from tests.test_corpus_source import rows_of
spark = SparkSession.builder.master("local[3,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
write = corpus.CorpusWriter.write
def once_killed(self, iterator):
    done = write(self, iterator)
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() != 1:
        raise OSError("killed after the last line")
    return done
corpus.CorpusWriter.write = once_killed
corpus.write_corpus(rows_of(spark), sys.argv[1], 3)
"""


def test_killed_tasks_and_retries_leave_no_trace(spark, tmp_path):
    path = str(tmp_path / "x")
    subprocess.run([sys.executable, "-c", RETRY, path], check=True, timeout=240, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True)
    recount(rows_of(spark), path)


def lock(folder, entries=None):
    names = entries or [f for f in files(folder)]
    (folder / corpus.LOCK).write_text(json.dumps({"files": [{"name": n, "sha256": hashlib.sha256((folder / n).read_bytes()).hexdigest()} for n in names]}))


def test_locked_lines_and_fields(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\r\n\n{"y": "é"}')
    (tmp_path / "empty.jsonl").write_text("")
    lock(tmp_path)
    (tmp_path / "not_locked.jsonl").write_text("no\n")
    got = corpus.read_locked(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("a.jsonl", 0, '{"x": 1}'), ("a.jsonl", 1, ""), ("a.jsonl", 2, '{"y": "é"}')]


def test_locked_csv_and_zip(spark, tmp_path):
    (tmp_path / "c").mkdir(), (tmp_path / "z").mkdir()
    (tmp_path / "c" / "a.csv").write_text('﻿x,y\n1,"two\nlines, ""quoted"""\n\n2,\n')
    lock(tmp_path / "c")
    got = [(r["line"], r["fields"]) for r in corpus.read_locked(spark, str(tmp_path / "c"), "csv").collect()]
    assert got == [(0, {"x": "1", "y": 'two\nlines, "quoted"'}), (1, {"x": "2", "y": ""})]
    with zipfile.ZipFile(tmp_path / "z" / "w.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("white.csv", "a;b\n3;z\n")
        z.writestr("red.csv", "a;b\n1;x\n2;y\n")
    lock(tmp_path / "z")
    got = [(r["member"], r["line"], r["fields"]["a"]) for r in corpus.read_locked(spark, str(tmp_path / "z"), "zip", ";").collect()]
    assert got == [("red.csv", 0, "1"), ("red.csv", 1, "2"), ("white.csv", 0, "3")]


@pytest.mark.parametrize("kind, name, good, bad, said", [
    ("lines", "a.jsonl", b"one\ntwo\n", b"one\ntwO\n", "a.jsonl is not the locked file"), ("lines", "a.jsonl", b"one\n", b"one\nmore\n", "a.jsonl is not the locked file"),
    ("csv", "a.csv", b"x,y\n1,2\n", b"x,y\n1,3\n", "a.csv is not the locked file"), ("csv", "a.csv", b"x,y\n1,2,3\n", None, "a.csv, line 2: 3 fields"), ("csv", "a.csv", b"x,x\n1,2\n", None, "names twice"),
    ("lines", "a.jsonl", b"\xff\n", None, "a.jsonl, line 0"),
])
def test_wrong_bytes_are_named(spark, tmp_path, kind, name, good, bad, said):
    (tmp_path / name).write_bytes(good)
    lock(tmp_path)
    if bad:
        (tmp_path / name).write_bytes(bad)
    with pytest.raises(Exception, match=said):
        corpus.read_locked(spark, str(tmp_path), kind).count()


def test_missing_files_and_locks(spark, tmp_path):
    with pytest.raises(Exception, match="neither"):
        corpus.read_locked(spark, str(tmp_path)).count()
    (tmp_path / "a.txt").write_text("x")
    lock(tmp_path)
    (tmp_path / "a.txt").unlink()
    with pytest.raises(Exception, match="a.txt is locked and missing"):
        corpus.read_locked(spark, str(tmp_path)).count()


def test_files_are_streamed(monkeypatch):
    """However long a file, what is held of it is a chunk."""
    monkeypatch.setattr(corpus, "CHUNK", 1 << 16)
    line, n = b"x" * 999 + b"\n", 20000

    class Long:
        def __init__(self):
            self.left, self.most = n * 1000, 0

        def read(self, size):
            self.most = max(self.most, size)
            take = min(size, self.left)
            at = -self.left % 1000
            self.left -= take
            return (line * (take // 1000 + 2))[at : at + take]

    import io

    source = Long()
    stream = corpus._Digested(source)
    batches = corpus._batches("f", corpus.LockedReader._lines("f", io.BufferedReader(stream, corpus.CHUNK)), corpus.LINES)
    sizes = [b.nbytes for b in batches]
    assert stream.bytes == n * 1000 and stream.digest.hexdigest() == hashlib.sha256(line * n).hexdigest()
    assert source.most <= 1 << 16 and max(sizes) < 1 << 18


def test_a_corpus_is_read_by_its_manifest(spark, tmp_path):
    rows, path = rows_of(spark), str(tmp_path / "x")
    corpus.write_corpus(rows, path, 3)
    assert sorted(r["value"] for r in corpus.read_locked(spark, path).collect()) == sorted(r["record"] for r in rows.collect())
