"""Association scans: Wald tests of every locus under a fitted null model.

The null model is fitted once.  Of a dense model, V^-1 and V^-1 (y - X beta) go to the tasks as
one broadcast of checked size (MAX_BYTES: 11,585 samples), and every partition of loci is encoded and tested where it
lies: no shuffle.  Of a factored model (reml.Factored), the tests come from the
products over samples, so nothing grows with the samples but one pass over them.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heritas.errors import DataError, InvalidArgument
from heritas.functions.genotype import Method, center_method, with_encoding
from heritas.operators.products import Encoding, Products
from heritas.operators.reml import Factored, Fit, Model, fit

#: Bytes of V^-1 that may be broadcast: a task's Python worker holds it.
MAX_BYTES = 1 << 30
RESULT = "snp_idx long, a1_freq double, beta double, se double, p double"


def wald(z: np.ndarray, v_inverse: np.ndarray | float, vr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beta, se, p of the rows of z; NaN where a locus has no variation.  A
    number for V^-1 stands for that multiple of the identity."""
    w = z * v_inverse if np.isscalar(v_inverse) else z @ v_inverse
    return _tests(z @ vr, np.einsum("ij,ij->i", z, w))


def _tests(score: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beta, se, p from z' V^-1 (y - X beta) and z' V^-1 z."""
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = np.where(size > 1e-12, score / size, np.nan)
        se = np.where(size > 1e-12, 1 / np.sqrt(size), np.nan)
    p = np.array([erfc(abs(t) / sqrt(2)) if t == t else np.nan for t in beta / se])
    return beta, se, p


def scan(loci: DataFrame, v_inverse: np.ndarray | float, vr: np.ndarray, name: str | Method = "OCH", kind: str = "add", checked: bool = True) -> DataFrame:
    """snp_idx, a1_freq, beta, se, p (NULL for monomorphic loci)."""
    m = center_method(name) if checked else name
    if getattr(v_inverse, "nbytes", 0) > MAX_BYTES:
        raise InvalidArgument(f"V^-1 takes {v_inverse.nbytes} bytes; a task holds {MAX_BYTES}")
    shared = loci.sparkSession.sparkContext.broadcast((v_inverse, vr))

    def run(batches):
        vi, r = shared.value
        for b in batches:
            if b.num_rows:
                z = b.column(2).values.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                beta, se, p = wald(z, vi, r)
                num = [pa.array(x, pa.float64(), from_pandas=True) for x in (beta, se, p)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *num], names=["snp_idx", "a1_freq", "beta", "se", "p"])

    return with_encoding(loci, m, kind).select(F.col("snp_idx").cast("long").alias("snp_idx"), "a1_freq", "z").mapInArrow(run, RESULT)


def _result(spark: SparkSession, of: Encoding, found: tuple[np.ndarray, ...], keep: np.ndarray | None = None) -> DataFrame:
    rows = [(int(j), f, *[None if v != v else float(v) for v in t]) for j, f, t in zip(of.snp_idx, of.a1_freq, zip(*found))]
    return spark.createDataFrame(rows if keep is None else [r for r, k in zip(rows, keep) if k], RESULT)


def scan_products(spark: SparkSession, sums: Products, block: str, of: Encoding, variance: float) -> DataFrame:
    """scan of a block's loci under independent samples of equal variance."""
    at = sums.columns(block)
    return _result(spark, of, _tests((sums.gram[at, 1] - sums.gram[at, 0] * sums.gram[0, 1] / sums.n) / variance, np.diag(sums.gram)[at] / variance))


def scan_factored(spark: SparkSession, model: Factored, null: Fit, block: str, of: Encoding, keep: np.ndarray | None = None) -> DataFrame:
    """scan of a block's loci, or those kept, under a fitted factored model."""
    w, at = model.against(block), null.point
    size = at.quadratic(w, np.diag(model.products.gram)[model.products.columns(block)])
    return _result(spark, of, _tests(w @ at.p[:, 1], size), keep)


def loco_factored(spark: SparkSession, sums: Products, effects: dict[str, tuple[str, Encoding]], counts: np.ndarray, block: str, of: Encoding, chrom: np.ndarray, max_iter: int = 100, tol: float = 1e-6) -> tuple[DataFrame, dict[str, Fit]]:
    """loco_association by products.  effects: the kernels' blocks and encodings;
    chrom: of each locus; counts: its class counts."""
    out, fits = None, {}
    for c in sorted(set(chrom.tolist())):
        rest = chrom != c
        kernels = {}
        for effect, (own, e) in effects.items():
            k = e.only(rest).trace(counts) / sums.n
            if k <= 0:
                raise DataError(f"chromosome {c} holds all of the matrix")
            kernels[effect] = (own, rest, k)
        model = Factored(sums, kernels)
        fits[c] = fit(model, max_iter, tol)
        found = scan_factored(spark, model, fits[c], block, of, ~rest).withColumn("chrom", F.lit(c))
        out = found if out is None else out.unionByName(found)
    return out, fits


def adjusted(model: Model, null: Fit) -> np.ndarray:
    """V^-1 (y - X beta)."""
    return null.v_inverse @ (model.y - model.x @ null.beta)


def association(loci: DataFrame, model: Model, name: str | Method = "OCH", kind: str = "add", max_iter: int = 100, tol: float = 1e-6) -> tuple[DataFrame, Fit]:
    null = fit(model, max_iter, tol)
    return scan(loci, null.v_inverse, adjusted(model, null), name, kind), null


def loco_association(loci: DataFrame, y: np.ndarray, x: np.ndarray, whole: dict[str, np.ndarray], parts: dict[str, dict[str, np.ndarray]], name: str | Method = "OCH", kind: str = "add", max_iter: int = 100, tol: float = 1e-6) -> tuple[DataFrame, dict[str, Fit]]:
    """loci carry `chrom`.  whole, parts[chrom]: unnormalised matrices by effect.
    Every chromosome has a null model of its own, from a cold start."""
    out, fits = None, {}
    for chrom, own in parts.items():
        kernels = {}
        for effect, g in whole.items():
            k, ki = np.trace(g) / len(g), np.trace(own[effect]) / len(g)
            if k - ki <= 0:
                raise DataError(f"chromosome {chrom} holds all of the matrix")
            kernels[effect] = (g - own[effect]) / (k - ki)
        found, fits[chrom] = association(loci.where(F.col("chrom") == chrom), Model(y, x, kernels), name, kind, max_iter, tol)
        found = found.withColumn("chrom", F.lit(chrom))
        out = found if out is None else out.unionByName(found)
    return out, fits
