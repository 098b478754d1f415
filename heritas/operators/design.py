"""Phenotypes and covariates: missing values, dummies, design, transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument
from heritas.functions.normal import norm_inv

#: Tokens that count as missing (fixed values).
MISSING = ("", "NA", "NaN", "nan", "null", "NULL", ".")


def is_missing(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return c.isNull() | c.cast("string").isin(*MISSING, *extra)


def drop_missing(df: DataFrame, columns: list[str], action: str = "skip", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns are all there.  action: skip (drop a row with any
    missing column), default (fill with 0 or an empty string) or throw."""
    if action == "skip":
        return df.where(reduce(lambda a, b: a & b, [~is_missing(F.col(c), extra) for c in columns], F.lit(True)))
    kinds = dict(df.dtypes)
    if action == "default":
        fill = {c: F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c]) for c in columns}
        return df.withColumns({c: F.when(is_missing(F.col(c), extra), fill[c]).otherwise(F.col(c)) for c in columns})
    if action == "throw":
        stop = {c: F.when(is_missing(F.col(c), extra), F.raise_error(F.lit(f"missing value in {c}")).cast(kinds[c])).otherwise(F.col(c)) for c in columns}
        return df.withColumns(stop)
    raise InvalidArgument(f"action {action!r} is none of skip, default, throw")


def trait(df: DataFrame, file_column: int = 2, name: str = "y") -> DataFrame:
    """The trait at a 0-based file column (the first two are the ids).  All
    trait columns decide which rows are complete, so rows don't depend on it."""
    if not 2 <= file_column < len(df.columns):
        raise InvalidArgument(f"column {file_column} isn't between 2 and {len(df.columns) - 1}")
    return drop_missing(df, df.columns[2:]).select("fid", "iid", F.col(df.columns[file_column]).cast("double").alias(name))


def levels(df: DataFrame, column: str, order: str = "sample_idx") -> DataFrame:
    """level, level_idx: in order of first appearance; level 0 is the reference."""
    first = df.groupBy(F.col(column).alias("level")).agg(F.min(order).alias("first"))
    return first.select("level", (F.row_number().over(Window.orderBy("first", "level")) - 1).alias("level_idx"))


def dummy_encode(df: DataFrame, columns: list[str], order: str = "sample_idx") -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with a 0/1 column for each level but the first; (column, level) names
    of the new ones.  Columns of one level get none.  The levels, as many as
    columns of the result, come to the driver."""
    names, new = [], {}
    for c in columns:
        for r in levels(df, c, order).orderBy("level_idx").collect()[1:]:
            names.append((c, r["level"]))
            new[f"{c}_{r['level']}"] = F.when(F.col(c) == r["level"], 1.0).otherwise(0.0)
    return df.withColumns(new), names


def design_matrix(df: DataFrame, quantitative: list[str] = (), dummies: list[str] = ()) -> DataFrame:
    """df with x: the array of intercept, quantitative covariates, dummies."""
    cells = [F.lit(1.0), *[F.col(c).cast("double") for c in (*quantitative, *dummies)]]
    return df.withColumn("x", F.array(*cells))


def column_norms(design: DataFrame) -> DataFrame:
    """column, norm2: squared norms of the design's columns."""
    return design.select(F.posexplode("x").alias("column", "v")).groupBy("column").agg(F.sum(F.col("v") * F.col("v")).alias("norm2"))


def average_rank(df: DataFrame, value: str = "y", out: str = "rank") -> DataFrame:
    """Ranks from 1, ties share their mean rank.

    Equal values are counted first, so that the running total sees a row a
    distinct value."""
    sizes = df.groupBy(value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = sizes.select(F.col(value), (upto - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, value)


def _to_normal(df: DataFrame, value: str, out: str, offset: float) -> DataFrame:
    ranked = average_rank(df, value, "_rank").withColumn("_total", df.select(F.count(value)).scalar())
    p = (F.col("_rank") - offset) / (F.col("_total") - 2 * offset + 1)
    p = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    return ranked.withColumn(out, norm_inv(p)).drop("_rank", "_total")


def direct_int(df: DataFrame, value: str = "y", out: str = "y_int", offset: float = 0.375) -> DataFrame:
    """Rank-based inverse normal transform."""
    return _to_normal(df, value, out, offset)


def residuals(df: DataFrame, value: str, covariates: list[str], out: str = "residual") -> DataFrame:
    """Least-squares residuals on intercept and covariates.  Spark adds up the
    normal equations (as wide as there are covariates); the driver solves them."""
    import numpy as np

    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    k = len(x)
    cells = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(value)).alias(f"b{i}") for i in range(k)]
    row = df.agg(*cells).first()
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        b[i] = row[f"b{i}"] or 0.0
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    fit = sum((float(c) * v for c, v in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
    return df.withColumn(out, F.col(value) - fit)


def indirect_int(df: DataFrame, value: str, covariates: list[str], out: str = "y_int", offset: float = 0.375, digits: int = 9) -> DataFrame:
    """Inverse normal transform of the residuals, rounded so that equal ones tie;
    the model that follows has an intercept only."""
    rounded = residuals(df, value, covariates, "_residual").withColumn("_residual", F.round("_residual", digits))
    return _to_normal(rounded, "_residual", out, offset).drop("_residual")
