"""Scores of text chunks from signals, and of samples from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import round3, sigmoid, unit

# Weights, thresholds and the order of verdicts.
INTERCEPT, WEIGHTS = -7.8, {"ai_written": 7.85, "tells": 6.32, "staging": 2.91, "specifics": -2.54}
VERY, LIKELY, HUMAN, RESIDUE, SHORT, TOO_SHORT = 0.9, 0.75, 0.3, 0.9, 100, 40
VERDICTS = ("very_likely_ai", "likely_ai", "unclear", "likely_human", "too_short")


def chunk_probability(ai_written: Column, tells: Column, staging: Column, specifics: Column, residue: Column) -> Column:
    """Logistic in four signals (`tells` from 0 to 3); what is left of a chat lifts it to 0.9."""
    z = INTERCEPT + WEIGHTS["ai_written"] * unit(ai_written) + WEIGHTS["tells"] * unit(tells / 3) + WEIGHTS["staging"] * unit(staging) + WEIGHTS["specifics"] * unit(specifics)
    p = sigmoid(z)
    return F.when(unit(residue) >= RESIDUE, F.greatest(p, F.lit(0.9))).otherwise(p)


def verdict_of(p: Column) -> Column:
    return F.when(p >= VERY, "very_likely_ai").when(p >= LIKELY, "likely_ai").when(p < HUMAN, "likely_human").otherwise("unclear")


def confidence_of(p: Column, words: Column) -> Column:
    v = verdict_of(p)
    margin = F.when(p >= LIKELY, p - LIKELY).otherwise(HUMAN - p)
    return F.when((words < SHORT) | (v == "unclear"), "low").when(margin >= 0.15, "high").otherwise("medium")


def score_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (words and signals) with probability (three decimals; null under 40 words), verdict and confidence."""
    p = chunk_probability(*[F.col(c) for c in ("ai_written", "tells", "staging", "specifics", "chat_residue")])
    rows = chunks.withColumn("__p", p)
    residue, confidence = unit(F.col("chat_residue")) >= RESIDUE, confidence_of(F.col("__p"), F.col("words"))
    confidence = F.when(residue, "high").otherwise(confidence)
    verdict = F.when((verdict_of(F.col("__p")) == "very_likely_ai") & (confidence == "low"), "likely_ai").otherwise(verdict_of(F.col("__p")))
    long_ = F.col("words") >= TOO_SHORT
    return rows.select(*chunks.columns, F.when(long_, round3(F.col("__p"))).alias("probability"), F.when(long_, verdict).otherwise("too_short").alias("verdict"), F.when(long_, confidence).otherwise("low").alias("confidence"))


LEVELS = ("low", "medium", "high")


def score_samples(chunks: DataFrame, sample: str) -> DataFrame:
    """Samples from scored chunks: `words`, `chunks` judged, `probability`, `mixed`, `verdict` and `confidence`.

    The verdict is that of the word-weighted mean of the chunks' rounded probabilities, itself not rounded. Mixed is a sample with a
    likely AI chunk and a human one: it is never human, and its confidence is low, as of all unclear ones. Else confidence is the
    word-weighted mean level, rounded; a low one takes back the strongest verdict. Without judged chunks: too_short, low.
    """
    p = F.col("probability")
    w = F.when(p.isNotNull(), F.col("words"))
    level = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    mixed = F.coalesce(F.bool_or(p >= LIKELY) & F.bool_or(p < HUMAN), F.lit(False))
    rows = chunks.groupBy(sample).agg(F.sum("words").alias("words"), F.count(p).alias("chunks"), (F.sum(p * w) / F.sum(w)).alias("p"), mixed.alias("mixed"), F.floor(F.sum(level * w) / F.sum(w) + 0.5).alias("level"))
    plain = verdict_of(F.col("p"))
    plain = F.when(F.col("p").isNull(), "too_short").when(F.col("mixed") & (plain == "likely_human"), "unclear").otherwise(plain)
    rows = rows.withColumn("plain", plain).withColumn("level", F.when(F.col("p").isNull() | F.col("mixed") | (F.col("plain") == "unclear"), 0).otherwise(F.col("level")).cast("int"))
    verdict = F.when((F.col("level") == 0) & (F.col("plain") == "very_likely_ai"), "likely_ai").otherwise(F.col("plain"))
    return rows.select(sample, "words", "chunks", round3(F.col("p")).alias("probability"), "mixed", verdict.alias("verdict"), F.array(*[F.lit(x) for x in LEVELS])[F.col("level")].alias("confidence"))


TELL_THRESHOLD = 0.6


def tells(strengths: dict[str, Column]) -> Column:
    """The tells of a chunk as array of (family, strength): strengths of three decimals, 0.6 at least, the strongest first, then in the order given."""
    each = F.array(*[F.struct(F.lit(k).alias("family"), round3(unit(v)).alias("strength"), F.lit(-i).alias("place")) for i, (k, v) in enumerate(strengths.items())])
    ordered = F.reverse(F.array_sort(F.transform(F.filter(each, lambda t: t["strength"] >= TELL_THRESHOLD), lambda t: F.struct(t["strength"], t["place"], t["family"]))))
    return F.transform(ordered, lambda t: F.struct(t["family"].alias("family"), t["strength"].alias("strength")))


def sample_tells(chunks: DataFrame, sample: str, tells_: str = "tells") -> DataFrame:
    """(`sample`, `family`, `strength`): the strongest of each family over a sample's judged chunks; none for samples that read human."""
    verdicts = score_samples(chunks, sample).filter("verdict <> 'likely_human'").select(sample)
    each = chunks.filter("probability is not null").select(sample, F.inline(tells_)).groupBy(sample, "family").agg(F.max("strength").alias("strength"))
    return each.join(verdicts, sample, "left_semi")


def cached(requests: DataFrame, cache: DataFrame, parts: list[str], value: str = "value") -> DataFrame:
    """`requests` with `cache_key`, the digest of `parts` joined by newlines, and the cached `value`, null where there is none; `hit` says which."""
    rows = requests.withColumn("cache_key", F.sha2(F.concat_ws("\n", *[F.col(c) for c in parts]), 256))
    have = cache.select("cache_key", F.col(value), F.lit(True).alias("hit")).dropDuplicates(["cache_key"])
    return rows.join(have, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def failures(chunks: DataFrame, sample: str, status: str = "status", fatal: tuple[str, ...] = ("unauthorized", "bad_request")) -> DataFrame:
    """Per sample: chunks that are `ok`, those that `failed`, and the `outcome`: ok, partial, or failed if a status is fatal or none is ok."""
    ok = F.count_if(F.col(status) == "ok")
    rows = chunks.groupBy(sample).agg(ok.alias("ok"), (F.count(F.lit(1)) - ok).alias("failed"), F.count_if(F.col(status).isin(*fatal)).alias("fatal"))
    outcome = F.when((F.col("fatal") > 0) | (F.col("ok") == 0), "failed").when(F.col("failed") > 0, "partial").otherwise("ok")
    return rows.select(sample, "ok", "failed", outcome.alias("outcome"))


def threshold_sweep(rows: DataFrame, label: str, p: str, thresholds: tuple[float, ...]) -> DataFrame:
    """At each threshold: negatives at or above it, positives below it."""
    each = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return each.groupBy("threshold").agg(F.count_if((F.col(label) == 0) & (F.col(p) >= F.col("threshold"))).alias("flagged"), F.count_if((F.col(label) == 1) & (F.col(p) < F.col("threshold"))).alias("missed"))
