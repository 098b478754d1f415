import math
from statistics import NormalDist

from pyspark.sql import functions as F

from heritas.functions import normal


def test_inverse_and_cdf(spark):
    ps = [1e-10, 1e-6, 0.001, 0.02425, 0.3, 0.5, 0.8, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.norm_inv(F.col("p")).alias("x")).collect()
    for r in rows:
        assert abs(r["x"] - NormalDist().inv_cdf(r["p"])) < 1e-8
    edge = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "p double").select(normal.norm_inv(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in edge] == [0.0] * 3
    for r in spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 0.7, 4.0)], "x double").select("x", normal.erfc(F.col("x")).alias("e"), normal.norm_cdf(F.col("x")).alias("c")).collect():
        assert abs(r["e"] - math.erfc(r["x"])) < 2e-7 and abs(r["c"] - NormalDist().cdf(r["x"])) < 2e-7


def test_registered(spark):
    normal.register(spark)
    r = spark.sql("SELECT erfc(0.5D) e, norm_inv(0.975D) q, norm_cdf(1.0D) c").first()
    assert abs(r["e"] - math.erfc(0.5)) < 1e-15 and abs(r["q"] - 1.959963984540054) < 1e-9 and abs(r["c"] - NormalDist().cdf(1)) < 1e-15
