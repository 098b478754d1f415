"""Moments of matrices whose rows are arrays, and running moments of series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _with(bound: Column, use: Callable[[Column], Column]) -> Column:
    """use(bound), where bound is computed once, also inside of lambdas."""
    return F.element_at(F.transform(F.array(bound), use), 1)


def _squares(values: Column) -> Column:
    """Sum of squared deviations from the mean, in two passes."""
    return _with(_mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))


def axis_variance(rows: DataFrame, index: str, values: str, axis: str = "row", ddof: int = 1) -> DataFrame:
    """Variances of a matrix's rows (index, variance) or columns (column,
    variance).  An axis of ddof elements or fewer has none (NULL)."""
    if ddof not in (0, 1):
        raise InvalidArgument("ddof is 0 or 1")
    if axis == "row":
        n = F.size(values)
        return rows.select(index, F.when(n > ddof, _squares(F.col(values).cast("array<double>")) / (n - ddof)).alias("variance"))
    if axis != "column":
        raise InvalidArgument(f"axis {axis!r} is neither row nor column")
    cells = rows.select(F.posexplode(F.col(values).cast("array<double>")).alias("column", "v"))
    var = F.var_samp("v") if ddof else F.var_pop("v")
    return cells.groupBy("column").agg(F.when(F.count("v") > ddof, var).alias("variance"))


def centred(rows: DataFrame, values: str) -> DataFrame:
    """Rows minus their means."""
    v = F.col(values).cast("array<double>")
    return rows.withColumn(values, _with(_mean(v), lambda m: F.transform(v, lambda x: x - m)))


def standardised(rows: DataFrame, values: str, ddof: int = 1) -> DataFrame:
    """Rows minus their means, over their standard deviations; rows without
    variation become 0."""
    if ddof not in (0, 1):
        raise InvalidArgument("ddof is 0 or 1")
    v = F.col(values).cast("array<double>")
    sd = F.sqrt(_squares(v) / F.nullif(F.size(values) - ddof, F.lit(0)))
    both = F.struct(_mean(v).alias("mean"), sd.alias("sd"))
    return rows.withColumn(values, _with(both, lambda b: F.transform(v, lambda x: F.when(b["sd"] > 0, (x - b["mean"]) / b["sd"]).otherwise(0.0))))


def running(series: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n, mean, sd of series by Spark's merging of partial moments.  A value
    that is missing, NaN or infinite is an error; one value has sd 0."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    held = series.select(*by, F.when(finite, v).otherwise(F.raise_error(F.lit(f"{value} isn't a finite number")).cast("double")).alias("v"))
    return held.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean, sd of parts (by, n, mean, sd) that belong together."""
    one = parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum((F.col("n") - 1) * F.col("sd") * F.col("sd")).alias("inside"), F.collect_list(F.struct("n", "mean")).alias("_parts"))
    # From the mean itself, so that large means don't cancel; a number a part.
    between = F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return one.select(*by, "n", "mean", F.when(F.col("n") > 1, F.sqrt((F.col("inside") + between) / (F.col("n") - 1))).otherwise(0.0).alias("sd"))
