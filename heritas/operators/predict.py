"""Scores of new samples from variant and covariate effects."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.errors import DataError

#: Effects up to this size are skipped.
TINY = 1e-10
log = logging.getLogger(__name__)


def _standardised(g, p):
    """Additive and dominance codes of a dosage under equilibrium; missing
    dosages contribute nothing."""
    q = 1 - p
    add = (g - 2 * p) / F.sqrt(F.greatest(2 * p * q, F.lit(TINY)))
    code = F.when(g == 2, 4 * p - 2).when(g == 1, 2 * p).otherwise(F.lit(0.0))
    dom = (code - 2 * p * p) / F.sqrt(F.greatest(4 * p * p * q * q, F.lit(TINY)))
    return add, dom


def variant_scores(geno: DataFrame, effects: DataFrame) -> DataFrame:
    """sample_idx, additive, dominant from the long form: geno (sample_idx,
    snp_id, g), effects (snp_id, a1_freq, add, dom).  Loci without an effect
    leave before the join."""
    used = effects.where((F.abs("add") > TINY) | (F.abs(F.coalesce("dom", F.lit(0.0))) > TINY))
    both = geno.join(used, "snp_id")
    add, dom = _standardised(F.col("g"), F.col("a1_freq"))
    one = both.select("sample_idx", F.coalesce(add * F.col("add"), F.lit(0.0)).alias("a"), F.coalesce(F.when(F.col("g").isNotNull(), dom) * F.col("dom"), F.lit(0.0)).alias("d"))
    return one.groupBy("sample_idx").agg(F.sum("a").alias("additive"), F.sum("d").alias("dominant"))


def array_scores(aligned: DataFrame, n: int, absent: str = "zero") -> DataFrame:
    """sample_idx, additive, dominant from aligned loci (dosage, a1_freq, add,
    dom), n samples each.  A locus that the target lacks counts as dosage 0
    (absent="zero") or as the mean (absent="mean").  Tasks emit one partial
    vector each."""

    def run(batches):
        total = np.zeros((2, n))
        for b in batches:
            for dosage, p, add, dom in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in (1, 2, 3))):
                if dosage is None and absent == "mean":
                    continue
                g = np.zeros(n) if dosage is None else np.array(dosage, float)
                q = 1 - p
                if abs(add or 0) > TINY:
                    total[0] += np.nan_to_num((g - 2 * p) / np.sqrt(max(2 * p * q, TINY))) * add
                if abs(dom or 0) > TINY:
                    code = np.where(g == 2, 4 * p - 2, np.where(g == 1, 2 * p, 0.0))
                    code[np.isnan(g)] = 2 * p * p
                    total[1] += (code - 2 * p * p) / np.sqrt(max(4 * p * p * q * q, TINY)) * dom
        yield pa.RecordBatch.from_pydict({"sample_idx": pa.array(np.arange(n)), "a": pa.array(total[0]), "d": pa.array(total[1])})

    parts = aligned.select("dosage", "a1_freq", "add", "dom").mapInArrow(run, "sample_idx long, a double, d double")
    return parts.groupBy("sample_idx").agg(F.sum("a").alias("additive"), F.sum("d").alias("dominant"))


def covariate_scores(samples: DataFrame, intercept: float, continuous: dict[str, float], categorical: dict[str, dict[str, float]], quantitative: list[str] = (), discrete: list[str] = ()) -> DataFrame:
    """samples with intercept and a column <name>_effect a covariate; a covariate
    or level without coefficient is an error."""
    lack = [c for c in quantitative if c not in continuous] + [c for c in discrete if c not in categorical]
    if lack:
        raise DataError(f"no coefficient for {', '.join(lack)}")
    out = samples.withColumn("intercept", F.lit(float(intercept)))
    for c in quantitative:
        out = out.withColumn(f"{c}_effect", F.col(c).cast("double") * F.lit(float(continuous[c])))
    for c in discrete:
        value = F.raise_error(F.concat(F.lit(f"no coefficient for level of {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("double")
        for level, b in categorical[c].items():
            value = F.when(F.col(c) == level, F.lit(float(b))).otherwise(value)
        out = out.withColumn(f"{c}_effect", value)
    return out


def total(scored: DataFrame, columns: list[str], out: str = "prediction") -> DataFrame:
    return scored.withColumn(out, sum((F.col(c) for c in columns), F.lit(0.0)))
