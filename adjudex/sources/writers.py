"""Writers: once only, appended, checked before they publish."""

from __future__ import annotations

import hashlib
import html
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def publish_once(df: DataFrame, path: str) -> None:
    """Refuses to replace what is there."""
    df.write.mode("errorifexists").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def checked(df: DataFrame, path: str, checks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Writes if every check gives no row; returns a manifest of the number of rows by split."""
    for name, violations in checks.items():
        if not violations(df).isEmpty():
            raise ValueError(f"not written: {name}")
    publish_once(df, path)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def csv_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file, null as an empty cell."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def _shown(df: DataFrame, most: int) -> tuple[list, str | None]:
    """The first `most` rows, and what to say of those left out."""
    rows = df.limit(most + 1).collect()
    return rows[:most], f"{df.count() - most} more rows" if len(rows) > most else None


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report of `most` rows at most as a Markdown table; a line below says how many are left out, if any."""
    rows, left_out = _shown(df, most)
    cell = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows), *(["", left_out] if left_out else [])])


def replace_text(spark: SparkSession, text: str, path: str) -> None:
    """Puts a small text, such as a manifest, at `path` of any file system: written beside it, then renamed over it, so that readers see the old or the new one whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.partial")
    out = target.getFileSystem(conf).create(beside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, how)


def html_report(tables: dict[str, DataFrame], title: str, most: int = 1000) -> str:
    """A report of small tables, `most` rows of each at most, as one page of HTML; a line below a table says how many rows are left out, if any."""
    cell = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else html.escape(str(v))
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{v}</{tag}>" for v in values) + "</tr>"
    parts = [f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        found, left_out = _shown(df, most)
        rows = [row("td", map(cell, r)) for r in found]
        parts += [f"<h2>{html.escape(name)}</h2><table>", row("th", map(html.escape, df.columns)), *rows, "</table>", *([f"<p>{left_out}</p>"] if left_out else [])]
    return "\n".join([*parts, "</body></html>"])


def prepared(df: DataFrame, root: str, fingerprint: list[str], length: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of a `length` of `most` or less, the others with `reason`), kept under `root` by the digest of `fingerprint` and `most`.

    What an earlier call has written whole is read, not made again. Rows of null length are rejected too. Nothing left is an error.
    """
    spark = df.sparkSession
    key = hashlib.sha256("\x1f".join([*fingerprint, str(most)]).encode()).hexdigest()
    places = [f"{root.rstrip('/')}/{key}/{part}" for part in ("kept", "rejected")]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS") for p in places]
    if not all(p.getFileSystem(conf).exists(p) for p in done):
        fits = F.coalesce(length <= most, F.lit(False))
        df.filter(~fits).withColumn("reason", F.concat(F.lit(f"longer than {most}: "), F.coalesce(length.cast("string"), F.lit("unknown")))).write.mode("overwrite").parquet(places[1])
        df.filter(fits).write.mode("overwrite").parquet(places[0])
    kept, rejected = (spark.read.parquet(p) for p in places)
    if kept.isEmpty():
        raise ValueError(f"no rows of {most} or less")
    return kept, rejected
