"""Functions of logits and probability vectors, as columns. Vectors are ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once, where a lambda would compute it for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    """Null and empty vectors: null."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    up = let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp((v - top) / t)))
    return F.when(F.size(z) > 0, let(up, lambda u: let(total(u), lambda s: F.transform(u, lambda v: v / s))))


def log_sum_exp(z: Column) -> Column:
    return let(F.array_max(z), lambda top: top + F.ln(total(F.transform(z, lambda v: F.exp(v - top)))))


def class_loss(z: Column, gold: Column) -> Column:
    """-ln of the softmax at `gold` (from 0), from logits."""
    return log_sum_exp(z) - F.get(z, gold)


def display_rounded(p: Column) -> Column:
    """A vector of values in [0, 1] that misses a sum of 1 by 0.05 at most, divided by its sum; null for others."""
    ok = F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    return F.when(ok, let(total(p), lambda s: F.when((s > 0) & (F.abs(s - 1) <= 0.05), F.transform(p, lambda v: v / s))))


def mean_within(p: Column, reported: Column, on_grid: Column) -> Column:
    """Whether a reported mean level fits its vector: within 0.005001, and 0.005 more for each level's distance if the vector is in hundredths."""
    return let(expected_level(p), lambda m: F.abs(reported - m) <= 0.005001 + F.when(on_grid, 0.005 * total(F.transform(p, lambda v, i: F.abs(i - m)))).otherwise(0.0))


def mixture_loss(p: Column, gold: Column, teacher: Column, alpha: float, weight: float) -> Column:
    """(1 - alpha) of the gold answer's loss and alpha of the cross entropy with a teacher's vector, plus `weight` times the Brier score."""
    soft = total(F.zip_with(teacher, p, lambda q, x: q * floored_nll(x)))
    return (1 - alpha) * floored_nll(F.get(p, gold)) + alpha * soft + weight * brier(p, gold)


def consistency(p: Column, q: Column) -> Column:
    """Half the squared distance of two vectors over one answer space."""
    return total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y))) / 2


def binary_loss(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def floored_nll(p: Column) -> Column:
    """-ln p with p at least 1e-12; without the floor, ln 0 would be null."""
    return -F.ln(F.greatest(p, F.lit(FLOOR)))


def brier(p: Column, gold: Column) -> Column:
    """Sum of squares over classes; `gold` counts from 0."""
    return total(F.transform(p, lambda v, i: F.pow(v - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2))))


def variation(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2


def unique_winner(p: Column) -> Column:
    """Place (from 0) of the only value within 1e-12 of the largest; null on a tie."""
    near = let(F.array_max(p), lambda top: F.filter(F.transform(p, lambda v, i: F.when(F.abs(v - top) <= FLOOR, i)), lambda i: i.isNotNull()))
    return let(near, lambda n: F.when(F.size(n) == 1, n[0]))


def choice_confidence(p: Column) -> Column:
    k = F.size(p)
    return F.when(k == 1, 1.0).otherwise((F.array_max(p) - 1 / k) / (1 - 1 / k))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda v, i: v * i))


def score_confidence(p: Column) -> Column:
    """1 less the mean distance from the mode, as a share of a uniform vector's; 0 at least."""
    mode = F.array_position(p, F.array_max(p)) - 1
    spread = total(F.transform(p, lambda v, i: v * F.abs(i - mode)))
    even = total(F.transform(p, lambda v, i: F.abs(i - mode).cast("double"))) / F.size(p)
    return F.when(even == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - spread / even))


def band(x: Column, thresholds: list[float]) -> Column:
    """Number of thresholds that are not above x."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= x))


def cent_grid(p: Column) -> Column:
    """A vector that sums to 1, or one in hundredths that misses it by 0.02 at most, divided by its sum; null for others."""
    s = total(p)
    grid = F.forall(p, lambda v: (v >= 0) & (F.abs(v * 100 - F.round(v * 100)) <= 1e-9))
    return F.when(F.abs(s - 1) <= 1e-6, p).when((F.abs(s - 1) <= 0.020000001) & grid, F.transform(p, lambda v: v / s))


def round3(x: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def unit(x: Column) -> Column:
    """Within 0 and 1; 0.5 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
