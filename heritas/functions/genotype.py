"""Genotype encodings and moments as Column expressions.

A locus is a row with `dosage`, an array of 0/1/2 in sample order with NULL for
missing, or many rows of the long form (snp_idx, sample_idx, g).  Both forms
give the same numbers; the array form is a narrow projection, the long form an
aggregation with partial results and a join of one row a locus.

A locus without any valid genotype, or with one only, is monomorphic and
encodes to zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument

MONOMORPHIC_BELOW = 1e-10
#: Class of a missing genotype beside 0, 1 and 2.
MISSING = 3


@dataclass(frozen=True)
class Method:
    name: str
    long_name: str
    orthogonal: bool
    hwe: bool
    scale: bool


#: Names of the methods.
METHODS = {
    m.name: m
    for m in (
        Method("SH", "StandardizeHWE", False, True, True),
        Method("CH", "CenterHWE", False, True, False),
        Method("OSH", "OrthStandardizeHWE", True, True, True),
        Method("OCH", "OrthCenterHWE", True, True, False),
        Method("S", "Standardize", False, False, True),
        Method("C", "Center", False, False, False),
        Method("OS", "OrthStandardize", True, False, True),
        Method("OC", "OrthCenter", True, False, False),
    )
}
EFFECTS = ("add", "dom")


def method(name: str | Method) -> Method:
    """A method by its short or long name, whatever the case."""
    if isinstance(name, Method):
        return name
    for m in METHODS.values():
        if name.lower() in (m.name.lower(), m.long_name.lower()):
            return m
    raise InvalidArgument(f"unknown genotype method {name!r}; one of {', '.join(METHODS)}")


def center_method(name: str | Method) -> Method:
    """A method of the centering family, which association scans take."""
    if method(name).scale:
        raise InvalidArgument(f"{name} scales; association takes CH, OCH, C or OC")
    return method(name)


def effect(name: str) -> str:
    if name not in EFFECTS:
        raise InvalidArgument(f"effect {name!r} is neither add nor dom")
    return name


def encoded(g: Column, p: Column, m: Method, kind: str) -> Column:
    """Code of a genotype: dosage itself, heterozygote indicator, or the
    dominance deviation 0, 2p, 4p - 2 that is orthogonal to dosage."""
    if effect(kind) == "add":
        return g
    if m.orthogonal:
        return F.when(g == 2, 4 * p - 2).when(g == 1, 2 * p).otherwise(g)
    return F.when(g == 2, F.lit(0.0)).otherwise(g)


def expected_moments(p: Column, m: Method, kind: str) -> tuple[Column, Column]:
    """Mean and standard deviation of the code in Hardy-Weinberg equilibrium."""
    q = 1 - p
    het = 2 * p * q
    if effect(kind) == "add":
        return 2 * p, F.sqrt(F.greatest(het, F.lit(0.0)))
    if m.orthogonal:
        return 2 * p * p, het
    return het, F.sqrt(F.greatest(het * (p * p + q * q), F.lit(0.0)))


def _scaled(centred: Column, sd: Column, m: Method) -> Column:
    return F.when(sd < MONOMORPHIC_BELOW, centred).otherwise(centred / sd) if m.scale else centred


def _flat(sd: Column, valid: Column) -> Column:
    return F.when(valid < 2, F.lit(0.0)).otherwise(sd)


# ---- array form -----------------------------------------------------------


def with_encoding(loci: DataFrame, name: str | Method, kind: str = "add", dosage: str = "dosage", out: str = "z") -> DataFrame:
    """loci and a1_freq, mean, sd, is_monomorphic and the encoded array `out`."""
    m = method(name)
    g = F.col(dosage)
    total = F.aggregate(g, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    one = loci.withColumn("_valid", F.size(F.filter(g, lambda x: x.isNotNull()))).withColumn("_sum", total)
    one = one.withColumn("a1_freq", F.when(F.col("_valid") > 0, F.col("_sum") / (2 * F.col("_valid"))))
    p = F.coalesce("a1_freq", F.lit(0.0))
    one = one.withColumn("_code", F.transform(g, lambda x: encoded(x, p, m, kind)))
    if m.hwe:
        mean, sd = expected_moments(p, m, kind)
        one = one.withColumn("mean", mean).withColumn("sd", _flat(sd, F.col("_valid")))
    else:
        mean = 2 * p if kind == "add" else F.aggregate("_code", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.greatest(F.col("_valid"), F.lit(1))
        one = one.withColumn("mean", mean)
        square = F.aggregate("_code", F.lit(0.0), lambda s, x: s + F.coalesce((x - F.col("mean")) * (x - F.col("mean")), F.lit(0.0)))
        one = one.withColumn("sd", _flat(F.sqrt(square / F.greatest(F.col("_valid") - 1, F.lit(1))), F.col("_valid")))
    centred = lambda x: _scaled(F.coalesce(x - F.col("mean"), F.lit(0.0)), F.col("sd"), m)
    return one.withColumn(out, F.transform("_code", centred)).withColumn("is_monomorphic", F.col("sd") < MONOMORPHIC_BELOW).drop("_valid", "_sum", "_code")


# ---- long form ------------------------------------------------------------


def allele_frequency(geno: DataFrame) -> DataFrame:
    """snp_idx, n_valid, a1_freq (not folded to the minor allele)."""
    return geno.groupBy("snp_idx").agg(F.count("g").alias("n_valid"), (F.sum("g") / F.nullif(2 * F.count("g"), F.lit(0))).alias("a1_freq"))


def moments(geno: DataFrame, name: str | Method, kind: str = "add") -> DataFrame:
    """snp_idx, n_valid, a1_freq, mean, sd, is_monomorphic."""
    # One aggregation: every code is a number per genotype class, so counts of
    # the classes hold all that the moments need.
    n = {k: F.sum(F.when(F.col("g") == k, 1).otherwise(0)).alias(f"n{k}") for k in (0, 1, 2)}
    return moments_of(geno.groupBy("snp_idx").agg(*n.values()), name, kind)


def moments_of(counts: DataFrame, name: str | Method, kind: str = "add") -> DataFrame:
    """The moments from class counts: snp_idx, n0, n1, n2."""
    m = method(name)
    one = counts.withColumn("n_valid", F.col("n0") + F.col("n1") + F.col("n2"))
    one = one.withColumn("a1_freq", F.when(F.col("n_valid") > 0, (F.col("n1") + 2 * F.col("n2")) / (2 * F.col("n_valid"))))
    p = F.coalesce("a1_freq", F.lit(0.0))
    valid = F.greatest(F.col("n_valid"), F.lit(1))
    code = [encoded(F.lit(float(k)), p, m, kind) for k in (0, 1, 2)]
    if m.hwe:
        mean, sd = expected_moments(p, m, kind)
    else:
        mean = 2 * p if kind == "add" else sum((F.col(f"n{k}") * code[k] for k in (1, 2)), F.col("n0") * code[0]) / valid
    one = one.withColumn("mean", mean)
    if not m.hwe:
        square = sum((F.col(f"n{k}") * (code[k] - F.col("mean")) * (code[k] - F.col("mean")) for k in (0, 1, 2)), F.lit(0.0))
        sd = F.sqrt(square / F.greatest(F.col("n_valid") - 1, F.lit(1)))
    one = one.withColumn("sd", _flat(sd, F.col("n_valid")))
    return one.select("snp_idx", "n_valid", "a1_freq", "mean", "sd", (F.col("sd") < MONOMORPHIC_BELOW).alias("is_monomorphic"))


def encode_long(geno: DataFrame, name: str | Method, kind: str = "add") -> DataFrame:
    """geno (snp_idx, sample_idx, g, ...) with the code z; missing codes are 0."""
    m = method(name)
    at = moments(geno, m, kind)
    z = _scaled(F.coalesce(encoded(F.col("g"), F.col("a1_freq"), m, kind) - F.col("mean"), F.lit(0.0)), F.col("sd"), m)
    return geno.join(at, "snp_idx").withColumn("z", z)


def class_codes(counts: DataFrame, name: str | Method, kind: str = "add") -> DataFrame:
    """snp_idx, a1_freq, z0, z1, z2: the codes of the three classes, from class
    counts.  A missing genotype's code is 0."""
    m = method(name)
    z = [_scaled(F.coalesce(encoded(F.lit(float(k)), F.col("a1_freq"), m, kind) - F.col("mean"), F.lit(0.0)), F.col("sd"), m).alias(f"z{k}") for k in (0, 1, 2)]
    return moments_of(counts, m, kind).select("snp_idx", "a1_freq", *z)


def dosage_classes(dosage: Column) -> Column:
    """The class of each genotype of an array."""
    return F.transform(dosage, lambda x: F.coalesce(x.cast("tinyint"), F.lit(MISSING).cast("tinyint")))


def to_loci(geno: DataFrame) -> DataFrame:
    """Long form to array form (a locus's genotypes meet in one row)."""
    rows = geno.groupBy("snp_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "g"))).alias("cells"))
    return rows.select("snp_idx", F.transform("cells", lambda c: c["g"]).alias("dosage"))
