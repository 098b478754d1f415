"""Simulated effects and phenotypes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument
from heritas.functions.genotype import with_encoding


def uniform(seed: int, key: Column, stream: int) -> Column:
    """A number between 0 and 1 that key, seed and stream decide (52 bits of their
    MD5), so a task that runs again, or another engine, draws the same."""
    text = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(stream))))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, key: Column, stream: int) -> Column:
    """A standard normal draw from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, key, stream))) * F.cos(2 * np.pi * uniform(seed, key, stream + 1))


def check_classes(classes: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """(proportion, variance) of effect classes."""
    if not classes:
        raise InvalidArgument("no effect classes")
    if any(p <= 0 for p, _ in classes) or any(v < 0 for _, v in classes):
        raise InvalidArgument("proportions must be positive and variances not negative")
    if abs(sum(p for p, _ in classes) - 1) > 1e-6:
        raise InvalidArgument("proportions must add up to 1")
    return classes


def class_bounds(n: int, classes: list[tuple[float, float]]) -> list[int]:
    """Ends of the classes in a list of n loci: rounded shares, the last class
    takes what is left."""
    ends, at = [], 0
    for p, _ in check_classes(classes)[:-1]:
        at = min(n, at + int(np.floor(n * p + 0.5)))
        ends.append(at)
    return [*ends, n]


def assign_classes(loci: DataFrame, classes: list[tuple[float, float]], order=None, seed: int = 42, out: str = "class") -> DataFrame:
    """loci with their class, in a random order unless one is given (a unique
    Column): a locus's place is its rank."""
    from pyspark.sql import Window

    n = loci.count()
    place = F.row_number().over(Window.orderBy(order if order is not None else uniform(seed, F.col("snp_idx"), 0)))
    one = loci.withColumn("_place", place)
    value = F.lit(len(classes) - 1)
    for k, end in reversed(list(enumerate(class_bounds(n, classes)[:-1]))):
        value = F.when(F.col("_place") <= end, k).otherwise(value)
    return one.withColumn(out, value).drop("_place")


def draw_effects(loci: DataFrame, classes: list[tuple[float, float]], seed: int, column: str = "class", out: str = "effect") -> DataFrame:
    sd = F.lit(0.0)
    for k, (_, v) in enumerate(classes):
        sd = F.when(F.col(column) == k, float(np.sqrt(v))).otherwise(sd)
    return loci.withColumn(out, F.when(sd > 0, normal(seed, F.col("snp_idx"), 1) * sd).otherwise(0.0))


def genetic_values(loci: DataFrame, n: int, kind: str = "add", effect: str = "effect") -> DataFrame:
    """sample_idx, value: sums of OS-encoded genotypes times effects."""

    def run(batches):
        total = np.zeros(n)
        for b in batches:
            if b.num_rows:
                total += b.column(1).to_numpy(zero_copy_only=False) @ b.column(0).values.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        yield pa.RecordBatch.from_pydict({"sample_idx": pa.array(np.arange(n)), "v": pa.array(total)})

    rows = with_encoding(loci, "OS", kind).where(F.col(effect) != 0).select("z", F.col(effect).cast("double").alias("b"))
    return rows.mapInArrow(run, "sample_idx long, v double").groupBy("sample_idx").agg(F.sum("v").alias("value"))


def dominance_scale(var_a: float, var_d: float, h2: float, d2: float) -> float:
    """Factor that gives dominance the variance var_a * d2 / h2."""
    return float(np.sqrt(var_a * d2 / h2 / var_d)) if d2 > 0 and var_d > 0 else 1.0


def residual_variance(var_a: float, h2: float, d2: float = 0.0) -> float:
    return var_a * (1 - h2 - d2) / h2


@dataclass
class Simulated:
    phenotype: DataFrame
    causal: DataFrame
    h2: float
    d2: float


def simulate(loci: DataFrame, n: int, h2: float = 0.5, d2: float = 0.0, add_classes=((1.0, 0.01),), dom_classes=((1.0, 0.01),), intercept: float = 0.0, seed: int = 42) -> Simulated:
    """loci (snp_idx, dosage): a phenotype (sample_idx, phenotype) and the causal
    effects; h2 and d2 as realised."""
    if not (0 < h2 < 1 and 0 <= d2 < 1 and h2 + d2 < 1):
        raise InvalidArgument("0 < h2 < 1, 0 <= d2 < 1 and h2 + d2 < 1 must hold")
    add_classes, dom_classes = list(add_classes), list(dom_classes)
    one = draw_effects(assign_classes(loci, add_classes, seed=seed, out="add_class"), add_classes, seed, "add_class", "additive_effect")
    a = genetic_values(one, n, "add", "additive_effect")
    if d2 > 0:
        one = draw_effects(assign_classes(one, dom_classes, seed=seed + 1, out="dom_class"), dom_classes, seed + 1, "dom_class", "dominance_effect")
        d = genetic_values(one, n, "dom", "dominance_effect").withColumnRenamed("value", "d")
    else:
        one = one.withColumn("dominance_effect", F.lit(0.0)).withColumn("dom_class", F.lit(0))
        d = a.select("sample_idx", F.lit(0.0).alias("d"))
    both = a.withColumnRenamed("value", "a").join(d, "sample_idx")
    v = both.agg(F.var_samp("a").alias("a"), F.var_samp("d").alias("d")).first()
    scale = dominance_scale(v["a"], v["d"], h2, d2)
    sd = float(np.sqrt(residual_variance(v["a"], h2, d2)))
    noise = normal(seed, F.col("sample_idx"), 3) * sd
    parts = both.withColumn("d", F.col("d") * scale).withColumn("e", noise)
    pheno = parts.withColumn("phenotype", F.col("a") + F.col("d") + F.col("e") + intercept)
    r = pheno.agg(F.var_samp("a").alias("a"), F.var_samp("d").alias("d"), F.var_samp("phenotype").alias("y")).first()
    causal = one.select("snp_idx", "additive_effect", (F.col("dominance_effect") * scale).alias("dominance_effect"), "add_class", "dom_class")
    return Simulated(pheno.select("sample_idx", "phenotype"), causal, r["a"] / r["y"], r["d"] / r["y"])
