import json
import zipfile

import pytest

from adjudex.sources import readers as S


def put(path, text):
    path.write_text(text)
    return str(path)


def test_delimited_and_finite(spark, tmp_path):
    rows = S.delimited(spark, put(tmp_path / "a.tsv", "file\twords\tx\na\t3\t0.5\nb\t0\t1\nc\t2\tNaN\n"), "file string, words int, x double", "\t")
    assert [r["file"] for r in S.finite_rows(rows, ["x"]).collect()] == ["a"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("red.csv", "a;b\n1;x\n2;y\n")
        z.writestr("white.csv", "a;b\n3;z\n")
    got = S.zipped_csv(spark, str(tmp_path / "w.zip"), "a int, b string").collect()
    assert sorted((r["member"], r["line"], r["a"], r["b"]) for r in got) == [("red.csv", 0, 1, "x"), ("red.csv", 1, 2, "y"), ("white.csv", 0, 3, "z")]


def test_arrays_by_split(spark, tmp_path):
    got = S.arrays_by_split(spark, put(tmp_path / "a.json", json.dumps({"train": [["hi", "greet"], ["bye", "part"]], "oos_test": [["x", "oos"]]}))).collect()
    assert sorted((r["split"], r["place"], r["label"], r["rejected"]) for r in got) == [("oos_test", 0, "oos", True), ("train", 0, "greet", False), ("train", 1, "part", False)]


def test_bundles_name_what_is_wrong(spark, tmp_path):
    assert S.bundles(spark, put(tmp_path / "ok.jsonl", '{"id": "a"}\n{"id": "b"}\n')).count() == 2
    for name, text, said in (("x", '{"id": "a"}\n{"id": \n', "no JSON"), ("y", '{"id": "a"}\n{"id": "a"}\n', "2 times"), ("z", "", "empty"), ("d", '{"id": "a", "id": "b"}\n', "no JSON")):
        with pytest.raises(ValueError, match=said):
            S.bundles(spark, put(tmp_path / f"{name}.jsonl", text))


def test_suites_and_results(spark, tmp_path):
    path = put(tmp_path / "s.json", json.dumps({"schema": {"f": {"type": "boolean"}}, "cases": [{"id": "1", "context": "c"}, {"id": "2", "context": "d"}]}))
    got = S.suites(spark, path, "id:string,context:string").collect()
    assert len(got) == 2 and len(got[0]["digest"]) == 64 and json.loads(got[0]["schema"]) == {"f": {"type": "boolean"}}
    (tmp_path / "r").mkdir()
    put(tmp_path / "r" / "c1.narrow.0.json", '{"seconds": 1.5}')
    put(tmp_path / "r" / "c2.broad.1.json", "cut off")
    assert [tuple(r) for r in S.case_results(spark, str(tmp_path / "r"), "seconds double").collect()] == [("c1", "narrow", "0", 1.5)]


def test_snapshots(spark):
    inner = {"cases": [{"id": "c", "workflow": "w", "nodes": [{"id": "n", "status": "ran", "document": 1, "question": 0}, {"id": "m", "status": "skipped", "document": 0, "question": 0}]}], "documents": ["x", "y"], "questions": ["q"]}
    rows = spark.createDataFrame([(f"__DATA__(`{json.dumps(inner)}`);",), ("__DATA__(`{}`) more",)], "text string")
    got = S.wrapped_snapshot(rows, "text").collect()
    assert got[0]["json"] is not None and got[1]["json"] is None
    flat = S.flattened_snapshot(spark.createDataFrame([(json.dumps(inner),)], "text string"), "text").collect()
    assert [tuple(r) for r in flat] == [("w", "c", "n", "y", "q")]


def test_text_samples_and_locks(spark, tmp_path):
    put(tmp_path / "a.txt", "x\r\ny")
    put(tmp_path / "readme.txt", "no")
    assert [tuple(r) for r in S.text_samples(spark, str(tmp_path)).collect()] == [("a.txt", "x\ny")]
    lock = spark.createDataFrame([("a.txt", "0" * 64), ("b.txt", "1")], "file string, sha256 string")
    assert {r["file"]: r["status"] for r in S.locked_files(spark, str(tmp_path), lock).collect()} == {"a.txt": "changed", "readme.txt": "unknown", "b.txt": "missing"}


def test_article_candidates(spark):
    rows = spark.createDataFrame([("h", f"u{i % 4}", 7000 if i % 4 != 1 else 10, i) for i in range(12)] + [("h", "tag/x", 7000, 0)], "host string, url string, length int, place int")
    assert sorted(r["url"] for r in S.article_candidates(rows, "^tag/", limit=2).collect()) == ["u0", "u2"]


def test_reports_say_what_they_leave_out(spark):
    from adjudex.sources import writers as W

    df = spark.range(12).toDF("n")
    assert W.markdown(df, 5).endswith("| 4 |\n\n7 more rows") and "more rows" not in W.markdown(df, 12)
    page = W.html_report({"t": df}, "r", 10)
    assert "<td>9</td>" in page and "<td>10</td>" not in page and "<p>2 more rows</p>" in page


def test_appended_lines_and_csv_reports(spark, tmp_path):
    from adjudex.sources import writers as W

    for i in range(2):
        W.append(spark.createDataFrame([(i, "é")], "i int, s string"), str(tmp_path / "a"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "a")).collect())) == [(0, "é"), (1, "é")]
    W.csv_report(spark.createDataFrame([(1, None), (2, ""), (3, 'x,"y"')], "i int, s string"), str(tmp_path / "c"))
    (part,) = (p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv")
    assert part.read_text().split("\n") == ["i,s", "1,", "2,", '3,"x,\\"y\\""', ""]
