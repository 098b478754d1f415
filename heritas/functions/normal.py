"""Normal distribution as Column arithmetic (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published algorithm AS 241 (numerator,
# denominator), low powers first: central part, middle tail.
CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: The published nine-coefficient rational erfc, high powers last.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _horner(r, coefficients):
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * r + F.lit(c)
    return out


def norm_inv(p: Column) -> Column:
    """Inverse normal distribution; 0 outside of (0, 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    mid = q * _horner(r, CENTRAL[0]) / _horner(r, CENTRAL[1])
    edge = F.when((p > 0) & (p < 1), F.sqrt(-F.log(F.least(p, 1 - p)))).otherwise(F.lit(1.6))
    near, far = edge - 1.6, edge - 5.0
    tail = F.when(edge <= 5, _horner(near, TAIL[0]) / _horner(near, TAIL[1])).otherwise(_horner(far, FAR[0]) / _horner(far, FAR[1]))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).when(F.abs(q) <= 0.425, mid).otherwise(F.signum(q) * tail)


def erfc(x: Column) -> Column:
    """Complementary error function, relative error at most 1.2e-7."""
    a = F.abs(x)
    t = 1 / (1 + a / 2)
    value = t * F.exp(-a * a + _horner(t, ERFC))
    return F.when(x >= 0, value).otherwise(2 - value)


def norm_cdf(x: Column) -> Column:
    return erfc(-x / F.sqrt(F.lit(2.0))) / 2


def register(spark) -> None:
    """SQL functions erfc, norm_cdf and norm_inv (vectorized, full precision)."""
    import math
    from statistics import NormalDist

    import pandas as pd

    normal = NormalDist()
    for name, f in {"erfc": math.erfc, "norm_cdf": normal.cdf, "norm_inv": lambda p: normal.inv_cdf(p) if 0 < p < 1 else 0.0}.items():
        spark.udf.register(name, F.pandas_udf(lambda s, f=f: pd.Series([None if v is None or v != v else f(v) for v in s], dtype="float64"), "double"))
