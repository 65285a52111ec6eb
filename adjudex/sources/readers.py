"""Readers that check what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as VARIANT `json`, and `valid`: false for syntax errors, repeated keys, NaN and infinities."""
    parsed = F.try_parse_json(F.col(column))
    return lines.withColumn("json", parsed).withColumn("valid", parsed.isNotNull() | (F.trim(F.col(column)) == "null"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    return strict_json(spark.read.text(path))


def text_samples(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder with `file` and `text`, newlines made plain; readmes and lists of sources left out."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    return rows.filter(F.col("file").endswith(".txt") & ~F.col("file").rlike("(?i)^(readme|sources)"))


def locked_files(spark: SparkSession, path: str, lock: DataFrame) -> DataFrame:
    """Files with their digest held against a table of `file` and `sha256`: ok, changed, missing or unknown."""
    have = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return have.join(lock, "file", "full_outer").select("file", status.alias("status"))


def wrapped_snapshot(rows: DataFrame, column: str, name: str = r"\w+") -> DataFrame:
    """The JSON in name(`...`), nothing before or after it; `json` is null otherwise."""
    inner = F.regexp_extract(F.col(column), rf"(?s)^\s*{name}\(`(.*)`\);?\s*$", 1)
    return rows.withColumn("json", F.try_parse_json(F.nullif(inner, F.lit(""))))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header, columns by name and type; a line that doesn't fit is an error. A missing path is an error too."""
    return spark.read.csv(path, header=True, sep=sep, schema=schema, mode="FAILFAST", enforceSchema=False)


def finite_rows(rows: DataFrame, features: list[str], words: str = "words") -> DataFrame:
    """Rows whose features are finite numbers and that have words."""
    ok = F.col(words) > 0
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))
    return rows.filter(ok)


_TEXTS = T.ArrayType(T.StructType([T.StructField("member", T.StringType()), T.StructField("text", T.StringType())]))


@F.udf(returnType=_TEXTS, useArrow=True)
def _members(content: bytes):
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [{"member": n, "text": archive.read(n).decode()} for n in archive.namelist() if not n.endswith("/")]


def zipped_csv(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """CSV members of ZIP files, each with a header line: `member`, `line` from 0 and the columns."""
    files = spark.read.format("binaryFile").load(path).select(F.inline(_members("content")))
    lines = files.select("member", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")).alias("line", "value")).filter("line > 0")
    return lines.select("member", (F.col("line") - 1).alias("line"), F.from_csv("value", schema, {"sep": sep, "mode": "FAILFAST"}).alias("r")).select("member", "line", "r.*")


def arrays_by_split(spark: SparkSession, path: str, rejected: str = r"^oos_") -> DataFrame:
    """From {"split": [[text, label], ..]}: split, place, text, label; `rejected` is true for splits whose name says so."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("split", "rows"))
    each = whole.select("split", F.posexplode("rows").alias("place", "row"))
    return each.select("split", "place", F.col("row")[0].alias("text"), F.col("row")[1].alias("label"), F.col("split").rlike(rejected).alias("rejected"))


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an `id` each, as VARIANT `json` and `id`. A line that isn't strict JSON, an empty file or a repeated id is an error that names it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    bad = strict_json(rows).filter("not valid").select("file", F.substring("value", 1, 80).alias("line")).first()
    if bad:
        raise ValueError(f"{bad['file']}: no JSON: {bad['line']}")
    parsed = rows.select(F.parse_json("value").alias("json")).withColumn("id", F.try_variant_get("json", "$.id", "string"))
    twice = parsed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").first()
    if twice:
        raise ValueError(f"id {twice['id']} stands {twice['n']} times")
    if parsed.isEmpty():
        raise ValueError(f"{path} is empty")
    return parsed


def suites(spark: SparkSession, path: str, case_schema: str) -> DataFrame:
    """Files {"schema": {..}, "cases": [..]}: each case with its file, the file's digest and schema. Repeated ids are an error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("value"))
    cases = files.select("file", "digest", F.get_json_object("value", "$.schema").alias("schema"), F.explode(F.from_json(F.get_json_object("value", "$.cases"), f"array<struct<{case_schema}>>")).alias("c")).select("file", "digest", "schema", "c.*")
    twice = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"case {twice['id']} stands {twice['n']} times")
    return cases


def case_results(spark: SparkSession, path: str, schema: str, parts: tuple[str, ...] = ("case", "judge", "sample")) -> DataFrame:
    """One JSON file for each result, `case.judge.sample.json`: the parts of the name and the columns; files that aren't JSON are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("json"))
    bits = F.split(F.regexp_replace("file", r"\.json$", ""), r"\.")
    return rows.filter("json is not null").select(*[F.get(bits, i).alias(p) for i, p in enumerate(parts)], "r.*")


def article_candidates(rows: DataFrame, excluded: str, least: int = 6000, most: int = 90000, limit: int = 12, by: str = "host") -> DataFrame:
    """Per host the first `limit` distinct URLs, in order of `place`, with a length in bounds and a path that isn't excluded."""
    fit = rows.filter(F.col("length").between(least, most) & ~F.col("url").rlike(excluded))
    firsts = fit.groupBy(by, "url").agg(F.min("place").alias("place"))
    return firsts.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("place", "url"))).filter(F.col("r") <= limit).drop("r")


def flattened_snapshot(rows: DataFrame, column: str) -> DataFrame:
    """From a snapshot {"cases": [{"id", "workflow", "nodes": [{"id", "status", "document", "question"}]}], "documents": [..], "questions": [..]}: nodes that ran, with the documents and questions that they name by place."""
    schema = "cases array<struct<id:string,workflow:string,nodes:array<struct<id:string,status:string,document:int,question:int>>>>, documents array<string>, questions array<string>"
    snap = rows.select(F.from_json(column, schema).alias("s"))
    nodes = snap.select("s.documents", "s.questions", F.explode("s.cases").alias("c")).select("documents", "questions", F.col("c.id").alias("case_id"), F.col("c.workflow").alias("workflow"), F.explode("c.nodes").alias("n"))
    ran = nodes.filter("n.status = 'ran'")
    return ran.select("workflow", "case_id", F.col("n.id").alias("node_id"), F.get("documents", F.col("n.document")).alias("document"), F.get("questions", F.col("n.question")).alias("question")).dropDuplicates(["workflow", "case_id", "node_id"])
