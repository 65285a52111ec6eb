"""Questions to scoring units, scores to answers, answers to predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P


def assemble(units: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One answer per question (`request`, `question`) from units (`place`, `option`, `logit`, `primitive`).

    A yes/no question has one unit. Of options with the same probability the first by name wins. The units of a question are as many
    as its options, 255 at most.
    """
    rows = units.groupBy("request", "question", "primitive").agg(F.sort_array(F.collect_list(F.struct("place", "option", "logit"))).alias("u"))
    z = F.transform("u", lambda x: x["logit"])
    yes = P.sigmoid(z[0] / temperature)
    p = F.when(F.col("primitive") == "noul", F.array(yes, 1 - yes)).otherwise(P.softmax(z, temperature))
    rows = rows.withColumn("p", p).withColumn("options", F.transform("u", lambda x: x["option"]))
    top = F.array_max("p")
    winner = F.array_min(F.filter(F.zip_with("options", "p", lambda o, v: F.when(v == top, o)), lambda o: o.isNotNull()))
    level = F.when(F.col("primitive") == "score", P.expected_level(F.col("p")))
    confidence = F.when(F.col("primitive") == "score", P.score_confidence(F.col("p"))).otherwise(P.choice_confidence(F.col("p")))
    return rows.select("request", "question", "primitive", F.when(F.col("primitive") == "choice", winner).alias("choice"), level.alias("level"), F.col("p").alias("probabilities"), confidence.alias("confidence"))


def predictions(answers: DataFrame, probabilities: str = "probabilities", gold: str = "gold") -> DataFrame:
    """`answers` with predicted (null on a tie), correct, ambiguous_top, nll, brier and max_probability."""
    p, g = F.col(probabilities), F.col(gold)
    rows = answers.withColumn("predicted", P.unique_winner(p))
    return rows.withColumns({
        "correct": F.coalesce(F.col("predicted") == g, F.lit(False)), "ambiguous_top": F.col("predicted").isNull(),
        "nll": P.floored_nll(F.get(p, g)), "brier": P.brier(p, g), "max_probability": F.array_max(p),
    })


def average_orders(a: Column, b: Column) -> Column:
    """Mean of a vector and of one asked in reverse order."""
    return F.zip_with(a, F.reverse(b), lambda x, y: (x + y) / 2)


def identical_requests(requests: DataFrame, payload: str = "payload", case: str = "case_id") -> DataFrame:
    """One row per distinct request: its digest, its number of cases and the first of them."""
    return requests.groupBy(F.sha2(payload, 256).alias("request")).agg(F.count(F.lit(1)).alias("cases"), F.min(case).alias("first_case"))


def cases_of_requests(requests: DataFrame, payload: str = "payload", case: str = "case_id") -> DataFrame:
    """Each case with the digest of its request, and `first` true for the one that is sent on behalf of all others. Null payloads have no digest; they are none's.

    The list of a request's cases is rows, as one request can be that of most cases.
    """
    rows = requests.select(F.sha2(payload, 256).alias("request"), F.col(case))
    return rows.join(identical_requests(requests, payload, case).select("request", "first_case"), "request", "left").select("request", case, F.coalesce(F.col(case) == F.col("first_case"), F.lit(False)).alias("first"))
