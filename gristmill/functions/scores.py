"""Scores, grades and vector measures as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least score of each letter, and the global opportunity curve.
GRADES = [(97.5, "A+"), (92.5, "A"), (87.5, "A-"), (82.5, "B+"), (77.5, "B"), (72.5, "B-"), (67.5, "C+"), (62.5, "C"), (57.5, "C-"), (52.5, "D+"), (47.5, "D"), (42.5, "D-")]
CURVE, POWER = 3.0273, 0.6034
BASE, STEP, LEAST_SIGMA = 75.0, 10.0, 0.5


def opportunity(pa: Column, da: Column) -> Column:
    """How far pa lies over the global curve of da; null where da is negative or either is missing."""
    return F.when(da >= 0, F.bround(pa - CURVE * F.pow(da, F.lit(POWER)), 3))


def grade(score: Column) -> Column:
    """The letter of an unrounded score; null for null."""
    out = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for least, letter in GRADES:
        out = out.when(score >= least, F.lit(letter))
    return out.otherwise(F.lit("F"))


def grade_tier(letter: Column) -> Column:
    """A+, A and A- each for itself, then by first letter."""
    return F.when(letter.isin("A+", "A", "A-"), letter).otherwise(F.substring(letter, 1, 1))


def predicted(model: Column, coefficients: Column, da: Column) -> Column:
    """A stored fit's value at da. Null where the model is unknown or has too few coefficients; a power fit is 0 at da <= 0."""
    c = lambda i: F.get(coefficients, F.lit(i))
    power = F.when(c(1).isNull(), F.lit(None).cast("double")).when(da <= 0, F.lit(0.0)).otherwise(c(0) * F.pow(da, c(1)))
    return F.when(model == "linear", c(0) * da + c(1)).when(model == "quadratic", c(0) * da * da + c(1) * da + c(2)).when(model == "power", power)


def residual_score(residual: Column, sigma: Column) -> Column:
    """75, and 10 more for each sigma above the fit; null where sigma is missing or not positive."""
    return F.when(sigma > 0, residual / sigma * STEP + BASE)


def exceptionalism(pa: Column, da: Column, fit: Column) -> Column:
    """score, grade and basis against a stored fit: struct with model, coefficients, sigma_effective, sigma_observed, n."""
    score = residual_score(pa - predicted(fit["model"], fit["coefficients"], da), fit["sigma_effective"])
    basis = F.struct(fit["model"].alias("model"), F.bround(fit["sigma_effective"], 4).alias("sigma_effective"), fit["n"].alias("n"), fit["sigma_observed"].alias("sigma_observed"))
    return F.when(score.isNotNull(), F.struct(F.bround(score, 2).alias("score"), grade(score).alias("grade"), basis.alias("basis")))


def attention(status: Column, r2: Column) -> Column:
    """Whether a fit needs a look, by its R squared."""
    return F.when((status != "graded") | r2.isNull(), F.lit("attention")).when(r2 >= 0.75, F.lit("strong")).when(r2 >= 0.6, F.lit("ok")).when(r2 >= 0.45, F.lit("weak")).otherwise(F.lit("attention"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def cosine_of_l2(distance: Column) -> Column:
    """For unit vectors."""
    return 1 - distance * distance / 2
