"""Folds, weights and temperatures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import probability as P
from .shared import free_name, saved


def folds(families: DataFrame, strata: list[str], family: str, n: int) -> DataFrame:
    """A fold for each family: hash order within its stratum, modulo n. Labels play no part."""
    order = Window.partitionBy(*strata).orderBy(F.sha2(F.col(family).cast("string"), 256), family)
    return families.select(*strata, family).distinct().withColumn("fold", (F.row_number().over(order) - 1) % n)


def balanced_weights(rows: DataFrame, origin: str, kind: str) -> DataFrame:
    """Each origin's kinds weigh alike and sum to half of all."""
    counts = rows.groupBy(origin, kind).agg(F.count(F.lit(1)).alias("__n"))
    kinds = counts.groupBy(origin).agg(F.count(F.lit(1)).alias("__k"))
    return rows.join(counts, [origin, kind]).join(kinds, origin).withColumn("weight", 1 / (2 * F.col("__k") * F.col("__n"))).drop("__n", "__k")


def fit_temperatures(rows: DataFrame, by: list[str], logits: str = "logits", gold: str = "gold", weight: str | None = None, low: float = 0.05, high: float = 100.0, rounds: int = 8, steps: int = 17) -> DataFrame:
    """Per group (`by`): the `temperature` in [low, high] that divides logits for the least weighted loss, its `objective`, and the `identity_objective` of 1.

    `logits` are vectors and `gold` is a place in them, from 0; rows weigh alike without `weight`. The loss falls to one minimum in log
    T. A grid over it is narrowed round by round around its best point, each round one aggregate over all rows, so groups of any size
    are fitted without bringing them together; bounds and 1 are tried too, and of equal losses the one nearest 1 wins.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    each = rows.select(*by, F.col(logits).alias("z"), F.col(gold).alias("y"), w.alias("w"))
    total = each.groupBy(*by).agg(F.sum("w").alias("all"))
    bounds = total.withColumns({"lo": F.lit(math.log(low)), "hi": F.lit(math.log(high))})

    def losses(bounds_: DataFrame, tried: Column) -> DataFrame:
        """(`by`, `all`, `lo`, `hi`, `log_t`, `loss`) for each log temperature of the array `tried`."""
        rows_ = each.join(bounds_, by).withColumn("log_t", F.explode(tried))
        loss = F.col("w") / F.col("all") * P.class_loss(F.transform("z", lambda v: v / F.exp("log_t")), F.col("y"))
        return rows_.groupBy(*by, "all", "lo", "hi", "log_t").agg(F.sum(loss).alias("loss"))

    for _ in range(rounds):
        width = (F.col("hi") - F.col("lo")) / (steps - 1)
        sums = losses(bounds, F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("lo") + i * width))
        best = sums.groupBy(*by, "all", "lo", "hi").agg(F.min_by("log_t", F.struct("loss", F.abs("log_t"))).alias("best"))
        bounds = saved(best.select(*by, "all", F.greatest("lo", F.col("best") - width).alias("lo"), F.least("hi", F.col("best") + width).alias("hi")), "temperatures")
    last = losses(bounds, F.array(F.lit(math.log(low)), F.lit(0.0), F.lit(math.log(high)), (F.col("lo") + F.col("hi")) / 2))
    best = F.min(F.struct("loss", F.abs("log_t").alias("off"), "log_t"))
    return last.groupBy(*by).agg(best.alias("best"), F.min(F.when(F.col("log_t") == 0, F.col("loss"))).alias("one")).select(*by, F.exp("best.log_t").alias("temperature"), F.col("best.loss").alias("objective"), F.col("one").alias("identity_objective"))


def apply_temperature(rows: DataFrame, logits: str = "logits", temperature: str = "temperature") -> DataFrame:
    """`rows` with `probabilities` of the divided logits, and `kept_winner`: whether the unique winner, or the tie, is the same as before."""
    z = F.col(logits)
    out = rows.withColumn("probabilities", P.softmax(z, F.col(temperature)))
    return out.withColumn("kept_winner", P.unique_winner(P.softmax(z)).eqNullSafe(P.unique_winner(F.col("probabilities"))))


def fit_left_out_temperatures(rows: DataFrame, fold: str, by: list[str] | None = None, logits: str = "logits", gold: str = "gold", weight: str | None = None, low: float = 0.05, high: float = 100.0, rounds: int = 8, steps: int = 17) -> DataFrame:
    """For each fold (of each group of `by`) what `fit_temperatures` gives on the rows of all other folds: `temperature`, `objective`, `identity_objective`.

    Each pass sums the losses of every fold's own rows, and a fit's loss is the total less its fold's own, so no row is copied or joined with other
    folds. All fits try temperatures of one lattice, made finer round by round; as they lie close together, most of what one of them tries the others
    do too, and a row's loss is computed once for all of them. A fold that is alone in its group has nothing to be fitted on and no row here.
    """
    keys, w = [f"by_{i}" for i in range(len(by or []))] or ["by_all"], F.col(weight) if weight else F.lit(1.0)
    own_keys = [F.col(c).alias(k) for c, k in zip(by or [], keys, strict=False)] or [F.lit(0).alias("by_all")]
    each = rows.select(*own_keys, F.col(fold).alias("own"), F.col(logits).alias("z"), F.col(gold).alias("y"), w.alias("w"))
    sizes = saved(each.groupBy(*keys, "own").agg(F.sum("w").alias("own_w"), F.count(F.lit(1)).alias("n")), "fold-sizes")
    totals = sizes.groupBy(*keys).agg(F.sum("own_w").alias("all_w"), F.count(F.lit(1)).alias("folds"))
    fits = sizes.join(totals, keys).filter("folds > 1").select(*keys, F.col("own").alias("held"), (F.col("all_w") - F.col("own_w")).alias("w"))
    start, width = math.log(low), (math.log(high) - math.log(low)) / (steps - 1)

    def losses(tried: DataFrame) -> DataFrame:
        """`tried` (keys, `held`, `w`, `log_t`) with the `loss` on all folds but the held one."""
        points = tried.groupBy(*keys).agg(F.collect_set("log_t").alias("points"))
        loss = F.col("w") * P.class_loss(F.transform("z", lambda v: v / F.exp("log_t")), F.col("y"))
        sums = saved(each.join(points, keys).withColumn("log_t", F.explode("points")).groupBy(*keys, "own", "log_t").agg(F.sum(loss).alias("own_loss")), "fold-losses")
        total = sums.groupBy(*keys, "log_t").agg(F.sum("own_loss").alias("total"))
        mine = sums.withColumnRenamed("own", "held")
        return tried.join(total, [*keys, "log_t"]).join(mine, [*keys, "held", "log_t"]).withColumn("loss", (F.col("total") - F.col("own_loss")) / F.col("w"))

    best = fits.withColumn("k", F.lit(0).cast("long"))
    for r in range(rounds):
        span, fine = steps // 2, width / (steps // 2) ** r
        last = (steps - 1) * span**r
        ks = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")) if not r else F.sequence(F.greatest(F.lit(0), F.col("k") * span - span), F.least(F.lit(last), F.col("k") * span + span))
        tried = best.withColumn("k", F.explode(ks)).withColumn("log_t", F.lit(start) + F.col("k") * F.lit(fine))
        best = saved(losses(tried).groupBy(*keys, "held", "w").agg(F.min_by("k", F.struct("loss", F.abs("log_t"))).alias("k")), "temperatures")
    points = F.array(F.lit(math.log(low)), F.lit(0.0), F.lit(math.log(high)), F.lit(start) + F.col("k") * F.lit(fine))
    end = losses(best.withColumn("log_t", F.explode(F.array_distinct(points))))
    chosen = end.groupBy(*keys, "held").agg(F.min(F.struct("loss", F.abs("log_t").alias("off"), "log_t")).alias("best"), F.min(F.when(F.col("log_t") == 0, F.col("loss"))).alias("one"))
    named = [F.col(k).alias(c) for c, k in zip(by or [], keys, strict=False)]
    return chosen.select(*named, F.col("held").alias(fold), F.exp("best.log_t").alias("temperature"), F.col("best.loss").alias("objective"), F.col("one").alias("identity_objective"))


def crossfit(rows: DataFrame, by: list[str] | None = None, fold: str = "fold", **how) -> DataFrame:
    """`rows` calibrated with temperatures fitted on all other folds, for all rows together or for each group (`by`)."""
    fits = fit_left_out_temperatures(rows, fold, by, **how).select(fold, *(by or []), "temperature")
    return apply_temperature(rows.join(fits, [fold, *(by or [])]), how.get("logits", "logits"))


#: Bounds of scale and offset, and the weight of their squared distance from 1 and 0.
SCALE, OFFSET, RIDGE = (0.001, 20.0), (-20.0, 20.0), 1e-4


def fit_affine(rows: DataFrame, logit: str = "logit", y: str = "y", weight: str = "weight", affine: bool = True, tolerance: float = 1e-8, passes: int = 60) -> dict:
    """The scale `a` and, if `affine`, the offset `b` that make sigmoid(a * logit + b) fit `y` best, within bounds and with a small ridge.

    Newton's steps on a strictly convex loss: each pass is one aggregate of a few sums per tried step (whole, half, ... 1/64), which is
    all that comes to the driver. Null or infinite logits and empty tables are errors, as is no convergence. Also given: `temperature`,
    `threshold`, `objective`, `identity_objective`, `gradient`.
    """
    z, p = F.col(logit), lambda a, b: P.sigmoid(a * F.col(logit) + b)

    def sums(points: list[tuple[float, float]]) -> list[tuple]:
        """Per point: the loss, its gradient and its second derivatives, ridge included."""
        w = F.col(weight)
        columns = [F.count_if(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))).alias("bad"), F.count(F.lit(1)).alias("n")]
        for i, (a, b) in enumerate(points):
            off, bend = w * (p(a, b) - F.col(y)), w * p(a, b) * (1 - p(a, b))
            columns += [F.sum(v).alias(f"{k}{i}") for k, v in {"loss": w * P.binary_loss(a * z + b, F.col(y)), "ga": off * z, "gb": off, "haa": bend * z * z, "hab": bend * z, "hbb": bend}.items()]
        r = rows.agg(*columns).first()
        if r["bad"] or not r["n"]:
            raise ValueError("logits must be finite, and there must be some")
        return [
            (r[f"loss{i}"] + RIDGE / 2 * ((a - 1) ** 2 + b**2), np.array([r[f"ga{i}"] + RIDGE * (a - 1), r[f"gb{i}"] + RIDGE * b]),
             np.array([[r[f"haa{i}"] + RIDGE, r[f"hab{i}"]], [r[f"hab{i}"], r[f"hbb{i}"] + RIDGE]]))
            for i, (a, b) in enumerate(points)
        ]

    low, high = np.array([SCALE[0], OFFSET[0]]), np.array([SCALE[1], OFFSET[1]])
    at = np.array([1.0, 0.0])
    loss, slope, bend = sums([tuple(at)])[0]
    identity = loss
    for _ in range(passes):
        free = ~(((at <= low) & (slope > 0)) | ((at >= high) & (slope < 0))) & np.array([True, affine])
        gradient = float(np.abs(slope[free]).max(initial=0.0))
        if gradient <= tolerance:
            a, b = map(float, at)
            return {"a": a, "b": b, "temperature": 1 / a, "threshold": -b / a, "objective": loss, "identity_objective": identity, "gradient": gradient}
        step = np.zeros(2)
        step[free] = -np.linalg.solve(bend[np.ix_(free, free)], slope[free])
        points = [np.clip(at + step / 2**i, low, high) for i in range(7)]
        found = sums([tuple(map(float, x)) for x in points])
        best = min(range(len(points)), key=lambda i: (found[i][0], i))
        if abs(found[0][0] - found[best][0]) <= 1e-15 * abs(found[best][0]):
            best = 0  # so near the minimum that losses are alike, whole steps converge best
        at, (loss, slope, bend) = points[best], found[best]
    raise RuntimeError(f"not converged: gradient {gradient}")


def binary_metrics(rows: DataFrame, by: list[str], logit: str = "logit", y: str = "y") -> DataFrame:
    """Of binary logits, 0 and above being yes: n, accuracy, recall of both classes, loss, Brier score over both classes."""
    yes, one, p = F.col(logit) >= 0, F.col(y) == 1, P.sigmoid(F.col(logit))
    rate = lambda hit, of: F.when(F.count_if(of) > 0, F.count_if(hit & of) / F.count_if(of))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((yes == one).cast("double")).alias("accuracy"), rate(yes, one).alias("recall"), rate(~yes, ~one).alias("specificity"),
        F.avg(P.binary_loss(F.col(logit), F.col(y))).alias("loss"), F.avg(2 * F.pow(p - F.col(y), F.lit(2))).alias("brier"))


def case_weights(rows: DataFrame, case: str) -> DataFrame:
    """`rows` with `weight`: cases weigh alike and sum to 1, the rows of a case share its weight."""
    per = rows.groupBy(case).agg(F.count(F.lit(1)).alias("of_case"))
    n = per.agg(F.count(F.lit(1)).alias("cases"))
    return rows.join(per, case).join(F.broadcast(n)).withColumn("weight", 1 / (F.col("cases") * F.col("of_case"))).drop("cases", "of_case")


#: Fits that one pass keeps sums of.
MOST_FITS = 4096


def fit_left_out_logistic(rows: DataFrame, group: str, features: list[str], label: str, weight: str, penalty: float = 0.0, n: int | None = None, passes: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """For each group what logistic regression with an L2 penalty gives on the rows of all others: (`held_out`, `rows`, `intercept`, `coefficients`, `gradient`).

    With `n`, one of n shares of groups by hash is left out instead of one group. All fits take Newton's steps together: a pass goes over the
    rows once, and a task's sums leave a row out of its own group's fit. So rows are neither copied nor joined; what moves is a few numbers for
    each fit and task. A step that doesn't lower a fit's loss is halved. The loss is the weighted mean plus penalty / 2 * |coefficients|^2.

    Rows with a null feature, label, weight or group count nowhere. A fit that doesn't converge, as with classes that a plane parts and no penalty, is an
    error, as are more than MOST_FITS fits. Fewer than two groups: no rows.
    """
    key = F.pmod(F.xxhash64(group), F.lit(n)).cast("string") if n else F.col(group).cast("string")
    each = rows.filter(F.col(group).isNotNull()).select(key.alias("held_out"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    each = each.filter(F.col("y").isNotNull() & F.col("w").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    sizes = each.groupBy("held_out").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).orderBy("held_out").limit(MOST_FITS + 1).collect()
    if len(sizes) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} fits: leave out shares of groups with n")
    schema = "held_out string, rows long, intercept double, coefficients array<double>, gradient double"
    if len(sizes) < 2:
        return rows.sparkSession.createDataFrame([], schema)
    names, d = {r["held_out"]: i for i, r in enumerate(sizes)}, len(features) + 1
    left_w = sum(r["w"] for r in sizes) - np.array([r["w"] for r in sizes])
    left_n = sum(r["n"] for r in sizes) - np.array([r["n"] for r in sizes])
    ridge = np.append(0.0, np.full(d - 1, penalty))

    def sums(at: np.ndarray):
        """Loss, gradient and second derivatives of every fit at its own coefficients."""
        at_, fits = at, len(names)

        def run(batches):
            total = np.zeros((fits, 1 + d + d * d))
            for batch in batches:
                own = np.array([names[x] for x in batch.column("held_out").to_pylist()], dtype=np.int64)
                x = np.hstack([np.ones((len(own), 1)), np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(len(own), d - 1)])
                y, w = (batch.column(c).to_numpy() for c in ("y", "w"))
                for k in range(0, len(own), 4096):
                    part = slice(k, k + 4096)
                    z = x[part] @ at_.T
                    weights = np.repeat(w[part, None], fits, axis=1)
                    weights[np.arange(len(z)), own[part]] = 0.0
                    p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
                    total[:, 0] += (weights * (np.maximum(z, 0) - z * y[part, None] + np.log1p(np.exp(-np.abs(z))))).sum(axis=0)
                    total[:, 1 : 1 + d] += (weights * (p - y[part, None])).T @ x[part]
                    total[:, 1 + d :] += (weights * p * (1 - p)).T @ (x[part, :, None] * x[part, None, :]).reshape(len(z), d * d)
            yield pa.RecordBatch.from_pydict({"fit": np.arange(fits), "sums": list(total)}, schema=pa.schema([("fit", pa.int64()), ("sums", pa.list_(pa.float64()))]))

        parts = each.mapInArrow(run, "fit long, sums array<double>").select("fit", F.posexplode("sums").alias("i", "v"))
        got = np.zeros((fits, 1 + d + d * d))
        for r in parts.groupBy("fit", "i").agg(F.sum("v").alias("v")).collect():
            got[r["fit"], r["i"]] = r["v"]
        got /= left_w[:, None]
        loss = got[:, 0] + (ridge * at**2).sum(axis=1) / 2
        return loss, got[:, 1 : 1 + d] + ridge * at, got[:, 1 + d :].reshape(fits, d, d) + np.diag(ridge)

    at = np.zeros((len(names), d))
    loss, slope, bend = sums(at)
    size = np.ones(len(names))
    for _ in range(passes):
        steep = np.abs(slope).max(axis=1)
        if (steep <= tolerance).all():
            found = [(k, int(left_n[i]), float(at[i, 0]), at[i, 1:].tolist(), float(steep[i])) for k, i in names.items()]
            return rows.sparkSession.createDataFrame(found, schema)
        step = -np.stack([np.linalg.lstsq(h, g, rcond=None)[0] for h, g in zip(bend, slope, strict=True)])
        tried = at + size[:, None] * step
        new = sums(tried)
        better = new[0] <= loss + 1e-14 * np.abs(loss)
        at[better] = tried[better]
        loss, slope, bend = (np.where(better.reshape(-1, *[1] * (old.ndim - 1)), now, old) for now, old in zip(new, (loss, slope, bend), strict=True))
        size = np.where(better, 1.0, size / 2)
    raise RuntimeError(f"not converged: gradient {float(np.abs(slope).max())}")


def left_out_scores(rows: DataFrame, fits: DataFrame, group: str, features: list[str], n: int | None = None) -> DataFrame:
    """`rows` with `score`, the probability of label 1 by the fit that their group was left out of; null without such a fit."""
    key = F.pmod(F.xxhash64(group), F.lit(n)).cast("string") if n else F.col(group).cast("string")
    name = free_name(rows, "held_out_of")
    of = fits.select(F.col("held_out").alias(name), "intercept", "coefficients")
    z = F.col("intercept")
    for i, c in enumerate(features):
        z = z + F.col("coefficients")[i] * F.col(c)
    return rows.join(of, key == F.col(name), "left").withColumn("score", P.sigmoid(z)).drop(name, "intercept", "coefficients")


def fit_logistic(rows: DataFrame, features: list[str], label: str, weight: str, penalty: float = 0.0):
    """Logistic regression with an L2 penalty by Spark ML; features as they are. The model's `coefficients` and `intercept`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="features_vector", handleInvalid="skip").transform(rows.withColumn(label, F.col(label).cast("double")))
    return LogisticRegression(featuresCol="features_vector", labelCol=label, weightCol=weight, regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(ready)


def _beta_tail(x: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(at most k of n at rate x), by the continued fraction of the incomplete beta function (modified Lentz), all rows at once."""
    a, b, y = n - k, k + 1.0, 1 - x  # P = I_{1-x}(n - k, k + 1)
    swap = y > (a + 1) / (a + b + 2)
    a, b, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(y) + b * np.log1p(-y)) / a
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (a + b) * y / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.where(swap, 1 - front * h, front * h)


@F.pandas_udf(T.DoubleType())
def upper_bound(k: pd.Series, n: pd.Series) -> pd.Series:
    """One-sided 95 % upper bound of a share (Clopper and Pearson): closed form for none, 1 for all, else bisection over the incomplete beta function."""
    k, n = k.to_numpy(np.float64), n.to_numpy(np.float64)
    out = np.where(k <= 0, 1 - 0.05 ** (1 / np.maximum(n, 1)), 1.0)
    out[(n <= 0) | (k >= n)] = 1.0
    some = (k > 0) & (k < n)
    k, n = k[some], n[some]
    lo, hi = k / n, np.ones(len(k))
    for _ in range(60):
        p = (lo + hi) / 2
        above = _beta_tail(p, k, n) > 0.05
        lo, hi = np.where(above, p, lo), np.where(above, hi, p)
    out[some] = (lo + hi) / 2
    return pd.Series(out)
