"""Regressions by group, without UDFs: sums from one pass over the points and algebra on them; power fits alone take a second look at the points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scores import LEAST_SIGMA, grade, residual_score

LEAST_N = 25


def fit_groups(points: DataFrame, keys: list[str], da: str = "da", pa: str = "pa", least_n: int = LEAST_N, models: tuple[str, ...] = ("linear", "quadratic", "power")) -> DataFrame:
    """A fit for each group: keys, n, used, reason, model, coefficients, r2_linear, r2_quadratic, r2_power, r2, sigma_observed, sigma_effective.

    Rows without da or pa take no part. Groups of fewer than least_n points, or whose da are all equal, are not used, and say why. The
    model is the one of the highest R squared on the original scale, the simplest of equals; power needs least_n points with both
    positive. The sums are combined before the shuffle and a group comes back as one row, so a group of any size works.
    """
    x, y = F.col(da).cast("double"), F.col(pa).cast("double")
    p = points.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, x.alias("x"), y.alias("y"))
    if tuple(models) == ("linear",):
        return _linear(p, keys, least_n)
    positive = (F.col("x") > 0) & (F.col("y") > 0)
    lx, ly = F.when(positive, F.ln("x")), F.when(positive, F.ln("y"))
    first = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        # all of these are merged around the means of what they have seen, so nothing large cancels out
        F.regr_sxx("y", "x").alias("s2"), F.regr_syy("y", "x").alias("tot"), F.regr_sxy("y", "x").alias("sxy"), F.skewness("x").alias("_skew"), F.kurtosis("x").alias("_kurt"), F.covar_pop(F.col("x") * F.col("x"), "y").alias("_c2"),
        F.count_if(positive).alias("n_power"), F.regr_slope(ly, lx).alias("b"), F.regr_intercept(ly, lx).alias("ln_a"),
    )
    n = F.col("n").cast("double")
    f = first.withColumn("s3", F.coalesce(F.col("_skew") * F.pow("s2", F.lit(1.5)) / F.sqrt(n), F.lit(0.0))).withColumn("s4", F.coalesce((F.col("_kurt") + 3) * F.col("s2") * F.col("s2") / n, F.lit(0.0))).withColumn("sxxy", n * F.col("_c2") - 2 * F.col("mx") * F.col("sxy"))
    # in centred x and y, v = a u^2 + b u + c with sums of u and v zero: c = -a s2 / n
    s4c = F.col("s4") - F.col("s2") * F.col("s2") / n
    det = F.col("s2") * s4c - F.col("s3") * F.col("s3")
    a = F.when(F.abs(det) > 1e-12 * F.col("s2") * s4c, (F.col("s2") * F.col("sxxy") - F.col("s3") * F.col("sxy")) / det)
    b = F.when(a.isNotNull(), (F.col("sxy") - a * F.col("s3")) / F.col("s2"))
    f = f.withColumn("qa", a).withColumn("qb0", b).withColumn("qb", F.col("qb0") - 2 * F.col("qa") * F.col("mx")).withColumn("qc", F.col("my") - F.col("qa") * F.col("s2") / n - F.col("qb0") * F.col("mx") + F.col("qa") * F.col("mx") * F.col("mx"))
    f = f.withColumn("used", (F.col("n") >= least_n) & (F.col("hi") > F.col("lo"))).withColumn("pa_", F.when((F.col("n_power") >= least_n), F.exp("ln_a"))).withColumn("pb", F.when(F.col("n_power") >= least_n, F.col("b")))
    names = [m for m in ("linear", "quadratic", "power") if m in models]
    rest = lambda explained: F.greatest(F.col("tot") - explained, F.lit(0.0))
    f = f.withColumn("ss_linear", F.when(F.col("slope").isNotNull(), rest(F.col("slope") * F.col("sxy")))).withColumn("ss_quadratic", F.when(F.col("qa").isNotNull(), rest(F.col("qa") * F.col("sxxy") + F.col("qb0") * F.col("sxy"))))
    for m in ("linear", "quadratic"):  # residuals of a least-squares fit have mean zero
        f = f.withColumn(f"sd_{m}", F.sqrt(F.col(f"ss_{m}") / n))
    if "power" in names:
        own = f.where("pa_ is not null and used").select(*keys, "pa_", "pb")
        error = F.col("y") - F.when(F.col("x") > 0, F.col("pa_") * F.pow("x", F.col("pb"))).otherwise(F.lit(0.0))
        spread = p.join(own, keys).groupBy(*keys).agg(F.sum(error * error).alias("ss_power"), F.stddev_pop(error).alias("sd_power"))
        f = f.join(spread, keys, "left")
    for m in ("linear", "quadratic", "power"):
        r2 = F.when(F.col("used"), F.when(F.col("tot") > 0, 1 - F.col(f"ss_{m}") / F.col("tot")).otherwise(F.when(F.col(f"ss_{m}").isNotNull(), F.lit(0.0)))) if m in names else F.lit(None).cast("double")
        f = f.withColumn(f"r2_{m}", r2)
    best = F.greatest(*[F.col(f"r2_{m}") for m in names]) if len(names) > 1 else F.col(f"r2_{names[0]}")
    f = f.withColumn("r2", best)
    # what the curve explains beyond the line, by itself: the difference of two R squared is lost in their rounding
    gain = F.coalesce(F.when((F.col("s2") > 0) & (F.col("tot") > 0), F.col("qa") * (F.col("sxxy") - F.col("s3") * F.col("sxy") / F.col("s2")) / F.col("tot")), F.lit(0.0)) if "quadratic" in names else F.lit(0.0)
    held = {"linear": F.array("slope", "intercept"), "quadratic": F.array("qa", "qb", "qc"), "power": F.array("pa_", "pb")}
    model = sigma = coefficients = None
    for m in names:
        hit = F.col(f"r2_{m}") >= F.col("r2") - 1e-12  # what differs by rounding alone is equal
        if m == "linear":
            hit &= gain <= 2.0**-52
        model = F.when(hit, F.lit(m)) if model is None else model.when(hit, F.lit(m))
        sigma = F.when(hit, F.col(f"sd_{m}")) if sigma is None else sigma.when(hit, F.col(f"sd_{m}"))
        coefficients = F.when(hit, held[m]) if coefficients is None else coefficients.when(hit, held[m])
    reason = F.when(F.col("n") < least_n, F.lit("below_min_n")).when(~F.col("used"), F.lit("degenerate"))
    return f.select(*keys, "n", "used", reason.alias("reason"), model.alias("model"), coefficients.alias("coefficients"), "r2_linear", "r2_quadratic", "r2_power", "r2", sigma.alias("sigma_observed"), F.when(F.col("used"), F.greatest(sigma, F.lit(LEAST_SIGMA))).alias("sigma_effective"))


def _linear(p: DataFrame, keys: list[str], least_n: int) -> DataFrame:
    """The straight line alone needs no second look at the points: residuals follow from the centred sums."""
    x, y = F.col("x"), F.col("y")
    f = p.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    f = f.withColumn("used", (F.col("n") >= least_n) & (F.col("hi") > F.col("lo"))).withColumn("rest", F.greatest(F.col("syy") - F.when(F.col("sxx") > 0, F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(0.0), F.lit(0.0)))
    own = lambda c: F.when(F.col("used"), c)
    r2, sigma, none = own(F.when(F.col("syy") > 0, 1 - F.col("rest") / F.col("syy")).otherwise(F.lit(0.0))), own(F.sqrt(F.col("rest") / F.col("n"))), F.lit(None).cast("double")
    reason = F.when(F.col("n") < least_n, F.lit("below_min_n")).when(~F.col("used"), F.lit("degenerate"))
    return f.select(*keys, "n", "used", reason.alias("reason"), own(F.lit("linear")).alias("model"), own(F.array("slope", "intercept")).alias("coefficients"), r2.alias("r2_linear"), none.alias("r2_quadratic"), none.alias("r2_power"), r2.alias("r2"), sigma.alias("sigma_observed"), F.greatest(sigma, own(F.lit(LEAST_SIGMA))).alias("sigma_effective"))


def graded(points: DataFrame, fits: DataFrame, keys: list[str], da: str = "da", pa: str = "pa") -> DataFrame:
    """points with predicted, residual, score and grade by their group's fit; null where the group has none that is used."""
    from gristmill.functions.scores import predicted

    f = fits.select(*keys, F.struct("model", "coefficients", "sigma_effective").alias("_fit"))
    out = points.join(f, keys, "left").withColumn("predicted", predicted(F.col("_fit.model"), F.col("_fit.coefficients"), F.col(da).cast("double")))
    out = out.withColumn("residual", F.col(pa) - F.col("predicted")).withColumn("score", residual_score(F.col("residual"), F.col("_fit.sigma_effective")))
    return out.withColumn("grade", grade(F.col("score"))).drop("_fit")


def first_usable(rows: DataFrame, *tiers: tuple[DataFrame, list[str], str]) -> DataFrame:
    """rows with fit and fit_source: the first tier whose fit is used. tiers: fits, their keys (columns of rows as well), name."""
    fit, source = [], []
    for i, (fits, keys, name) in enumerate(tiers):
        held = fits.where("used").select(*keys, F.struct("model", "coefficients", "sigma_effective", "sigma_observed", "n").alias(f"_fit{i}"))
        rows = rows.join(held, keys, "left")
        fit.append(F.col(f"_fit{i}"))
        source.append(F.when(F.col(f"_fit{i}").isNotNull(), F.lit(name)))
    return rows.withColumn("fit", F.coalesce(*fit)).withColumn("fit_source", F.coalesce(*source)).drop(*[f"_fit{i}" for i in range(len(tiers))])
