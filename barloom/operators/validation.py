"""Validation and drift of predictions: rows of (symbol, seq, predicted, actual, lower, upper)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import chi2_sf_even


def validate_model(df: DataFrame, minimum: int = 10) -> DataFrame:
    c, e = F.col, F.col("predicted") - F.col("actual")
    up, was = c("predicted") > 0, c("actual") > 0
    a = df.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.when(c("actual") != 0, F.abs(e / c("actual"))).otherwise(0.0)).alias("mape"),
        F.avg((F.signum("predicted") == F.signum("actual")).cast("double")).alias("direction_accuracy"), F.count_if(up & was).alias("tp"), F.count_if(up & ~was).alias("fp"), F.count_if(~up & was).alias("fn"),
        F.corr("predicted", "actual").alias("corr"), F.avg(e).alias("bias"), F.avg((e > 0).cast("double")).alias("over_rate"), F.avg((e < 0).cast("double")).alias("under_rate"),
        (F.sqrt(F.avg(c("predicted") * c("predicted"))) + F.sqrt(F.avg(c("actual") * c("actual")))).alias("sizes"),
    ).where(F.col("n") >= minimum)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    a = a.withColumn("rmse", F.sqrt("mse")).withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    a = a.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))).withColumn("theil_u", ratio(c("rmse"), c("sizes")))
    return a.withColumn("corr", F.coalesce("corr", F.lit(0.0))).withColumn("r2", c("corr") * c("corr"))


def ljung_box(df: DataFrame, lags: int = 10) -> DataFrame:
    """Test of (symbol, seq, x) for autocorrelation up to ``lags`` (even)."""
    w = Window.partitionBy("symbol")
    d = df.withColumn("n", F.count("*").over(w)).withColumn("d", F.col("x") - F.avg("x").over(w))
    for k in range(1, lags + 1):
        d = d.withColumn(f"p{k}", F.col("d") * F.lag("d", k).over(w.orderBy("seq")))
    q = sum((F.pow(F.sum(f"p{k}") / F.sum(F.col("d") * F.col("d")), 2) / (F.max("n") - k) for k in range(2, lags + 1)), F.pow(F.sum("p1") / F.sum(F.col("d") * F.col("d")), 2) / (F.max("n") - 1))
    a = d.groupBy("symbol").agg((F.max("n") * (F.max("n") + 2) * q).alias("stat"))
    return a.withColumn("p_value", chi2_sf_even(F.col("stat"), lags))


def jarque_bera(df: DataFrame) -> DataFrame:
    """Normality test of (symbol, x) with moments about the mean over the sample deviation."""
    n = F.count("x")
    s, k = F.skewness("x") * F.pow((n - 1) / n, F.lit(1.5)), (F.kurtosis("x") + 3) * F.pow((n - 1) / n, F.lit(2)) - 3
    a = df.groupBy("symbol").agg((n / 6 * (s * s + k * k / 4)).alias("stat"))
    return a.withColumn("p_value", F.exp(-F.col("stat") / 2))


def psi(df: DataFrame, bins: int = 10, least: float = 1e-4) -> DataFrame:
    """Population stability of (symbol, part: 'ref' or 'cur', x) over equal-width bins of the joint range; empty bins count as ``least``."""
    w = Window.partitionBy("symbol")
    d = df.withColumn("low", F.min("x").over(w)).withColumn("high", F.max("x").over(w))
    d = d.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0) * bins)))
    d = d.withColumn("ref_n", F.count_if(F.col("part") == "ref").over(w)).withColumn("cur_n", F.count_if(F.col("part") == "cur").over(w))
    per = d.groupBy("symbol", "bin").agg(F.greatest(F.count_if(F.col("part") == "ref") / F.max("ref_n"), F.lit(least)).alias("p"), F.greatest(F.count_if(F.col("part") == "cur") / F.max("cur_n"), F.lit(least)).alias("q"))
    return per.groupBy("symbol").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))  # bins empty on both sides add nothing


def ks_two_sample(df: DataFrame) -> DataFrame:
    """Largest distance of the two distributions of (symbol, part, x), and its p value."""
    w = Window.partitionBy("symbol")
    at = w.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    share = lambda p: F.count_if(F.col("part") == p).over(at) / F.count_if(F.col("part") == p).over(w)
    d = df.withColumn("gap", F.abs(share("ref") - share("cur"))).groupBy("symbol").agg(F.max("gap").alias("d"), F.count_if(F.col("part") == "ref").alias("n"), F.count_if(F.col("part") == "cur").alias("m"))
    d = d.withColumn("stat", F.col("d") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))))
    return d.select("symbol", "d", "stat", F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("stat") * F.col("stat"))).alias("p_value"))


def interval_coverage(df: DataFrame, nominal: float = 0.95) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("seq")
    d = df.withColumn("hit", ((F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))).cast("int")).withColumn("before", F.lag("hit").over(w)).withColumn("width", F.col("upper") - F.col("lower"))
    a = d.groupBy("symbol").agg(F.avg("hit").alias("coverage"), F.avg("width").alias("width"), F.coalesce(F.stddev_samp("width"), F.lit(0.0)).alias("width_sd"), F.avg((F.col("hit") == F.col("before")).cast("int")).alias("conditional"))
    return a.withColumn("gap", F.col("coverage") - nominal)


def model_drift(df: DataFrame, window: int = 50, psi_limit: float = 0.2, ks_limit: float = 0.05, mae_limit: float = 1.5) -> DataFrame:
    """Drift between the last ``window`` predictions of either part of (symbol, seq, part: 'ref' or 'cur', predicted, actual).

    Returns psi, ks and its p_value over the predictions, mae_ratio, direction_ratio, drift and alerts; symbols with
    fewer than ``window`` rows in a part have no row.
    """
    c = F.col
    w = Window.partitionBy("symbol", "part")
    d = df.withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).withColumn("rows", F.count("*").over(w)).where((c("back") <= window) & (c("rows") >= window))
    part = lambda x, p: F.avg(F.when(c("part") == p, x))
    gap, right = F.abs(c("predicted") - c("actual")), (F.signum("predicted") == F.signum("actual")).cast("double")
    a = d.groupBy("symbol").agg(part(gap, "ref").alias("ref_mae"), part(gap, "cur").alias("cur_mae"), part(right, "ref").alias("ref_right"), part(right, "cur").alias("cur_right")).where("ref_mae is not null and cur_mae is not null")
    x = d.select("symbol", "part", c("predicted").alias("x"))
    a = a.join(psi(x), "symbol").join(ks_two_sample(x).select("symbol", c("d").alias("ks"), "p_value"), "symbol")
    a = a.withColumn("mae_ratio", F.when(c("ref_mae") > 0, c("cur_mae") / c("ref_mae")).otherwise(1.0)).withColumn("direction_ratio", c("cur_right") / F.greatest(F.lit(0.001), c("ref_right")))
    # fixed values: the texts of the alerts
    over = {"PSI exceeds threshold": c("psi") > psi_limit, "KS test p-value below threshold": c("p_value") < ks_limit, "MAE ratio exceeds threshold": c("mae_ratio") > mae_limit}
    a = a.withColumn("alerts", F.filter(F.array(*[F.when(hit, text) for text, hit in over.items()]), lambda x: x.isNotNull()))
    return a.withColumn("drift", F.size("alerts") > 0)


def performance_report(validation: DataFrame) -> DataFrame:
    """Adds rating, three readings and recommendations to rows of ``validate_model``; the later rule of two that hold decides."""
    acc, corr, u = F.col("direction_accuracy"), F.col("corr"), F.col("theil_u")
    rating = F.when((acc < 0.5) | (corr < 0.1) | (u > 1.2), "FAILING").when((acc > 0.6) & (corr > 0.5) & (u < 0.6), "EXCELLENT").when((acc > 0.55) & (corr > 0.3) & (u < 0.8), "GOOD").otherwise("POOR")
    # fixed values: ratings, readings and the texts of the advice
    advice = [F.when(acc < 0.55, "Consider regime-specific models"), F.when(corr < 0.3, "Add more predictive features"), F.when(u > 1, "Reduce forecast variance, increase shrinkage"), F.when(F.col("mape") > 0.05, "High percentage errors - check for outliers")]
    return validation.withColumns({
        "rating": rating,
        "reading_direction": F.when(acc > 0.55, "Better than random").otherwise("No better than random"),
        "reading_corr": F.when(corr > 0.3, "Meaningful linear relationship").otherwise("Weak linear relationship"),
        "reading_theil_u": F.when(u < 1, "Better than naive forecast").otherwise("Worse than naive forecast"),
        "recommendations": F.filter(F.array(*advice), lambda x: x.isNotNull()),
    })


def backtest_validation(rows: DataFrame, windows: tuple = (20, 50, 100), minimum: int = 10) -> tuple[DataFrame, DataFrame]:
    """(validation of all of a symbol's walk-forward predictions, window 0, and of its last ``windows`` ones; coverage of their intervals).

    ``rows``: (symbol, cutoff, predicted, actual, lower, upper). A window longer than the series has no row.
    """
    w = Window.partitionBy("symbol")
    d = rows.withColumn("back", F.row_number().over(w.orderBy(F.desc("cutoff")))).withColumn("rows", F.count("*").over(w))
    each = d.withColumn("window", F.explode(F.array(F.lit(0), *map(F.lit, windows)))).where((F.col("window") == 0) | ((F.col("back") <= F.col("window")) & (F.col("rows") >= F.col("window"))))
    keyed = each.withColumn("symbol", F.concat_ws("|", F.col("window").cast("string"), "symbol"))
    v = validate_model(keyed, minimum).withColumn("window", F.split("symbol", r"\|", 2)[0].cast("int")).withColumn("symbol", F.split("symbol", r"\|", 2)[1])
    return v, interval_coverage(rows.withColumn("seq", F.col("cutoff")))
