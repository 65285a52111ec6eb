"""From documents to a training mix: quality rules, near-dedup, decontamination, surrogates for personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudex.llm.common import saved, table
from adjudex.llm.decontaminate import find_benchmark
from adjudex.llm.mixing import emit, mix
from adjudex.llm.near_dedup import drop_near_duplicates
from adjudex.llm.pii import QUERY_KEY, replace_entities
from adjudex.llm.quality_rules import judge_lines

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with `text` as their text and n_chars counted anew where it has changed."""
    new = F.col(text)
    length = F.col("n_chars") if text == "text" else F.when(new.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.char_length(new).cast("long"))
    return rows.select("doc_id", new.alias("text"), "lang", "source", length.alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject; lines above the limit go from the others.

    Null or empty text: rejected. Null source: a host of its own. Repeated rows: each judged. Empty table: empty.
    """
    return _documents(judge_lines(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null or empty text and null doc_id: stay. Rows that share a doc_id go or stay together. Empty table: empty.
    """
    return _documents(drop_near_duplicates(docs.select(*COLUMNS)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs.

    Null or empty text: stays. Repeated rows: each searched. Empty table: empty.
    """
    return _documents(find_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter("not contaminated"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data under the key in spark.adjudex.surrogate.key, or that of the query.

    Null or empty text: as it is. Repeated rows: each replaced alike. Empty table: empty.
    """
    before = docs.select(*COLUMNS)
    return _documents(replace_entities(before, spark.conf.get("spark.adjudex.surrogate.key", QUERY_KEY)).withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target weight asks, with `size`, `source_size` and `target`.

    Null or empty text: size 0, taken by the same rate. Null source: a source of its own. Repeated rows: each sampled. Empty table: empty.
    """
    return emit(mix(docs.select(*COLUMNS)), [*COLUMNS, "size", "source_size", "target"])


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mix_sources", mix_sources)]

#: Near-duplicates of five words and keyed surrogates have no SQL of a sensible size. Tests hold quality rules, decontamination and the mix
#: against the operators' SQL, near-duplicates against all pairs, and surrogates against all spellings of made-up entities.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written as Parquet and read again by the next.

    Columns of documents beyond the five named are not carried on, whatever their names. No documents: no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
