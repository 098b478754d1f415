import numpy as np
import pytest
from pyspark.sql import functions as F

from heritas.errors import DataError, InvalidArgument, SampleMismatch
from heritas.operators import design, samples


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "fid string, iid string")


def test_intersection_order_and_alignment(spark):
    a = ids(spark, ("b", "2"), ("a", "10"), ("a", "2"), ("a", "2"), ("c", "1"), (None, "9"), ("", "3"))
    b = ids(spark, ("a", "2"), ("a", "10"), ("b", "2"), ("z", "0"))
    common = samples.finalize(samples.intersect(a, b))
    assert [tuple(r) for r in common.orderBy("sample_idx").collect()] == [("a", "10", 0), ("a", "2", 1), ("b", "2", 2)]
    y = b.withColumn("y", F.lit(1.0))
    assert samples.reindex(common, y).count() == 3
    raw = b.withColumn("raw_idx", F.monotonically_increasing_id())
    assert sorted(r["target"] for r in samples.projection(raw, common).collect()) == [-1, 0, 1, 2]
    assert samples.excluded_count([a, b]).first()["excluded"] == 1
    with pytest.raises(SampleMismatch):
        samples.require_samples(samples.intersect(a, ids(spark, ("q", "q"))))
    with pytest.raises(DataError):
        samples.check_unique(a)


def test_missing(spark):
    df = spark.createDataFrame([("f", "1", "1.5", "10"), ("f", "2", "NA", "20"), ("f", "3", "2.0", "."), ("f", "4", "-9", "1")], "fid string, iid string, a string, b string")
    assert [r["iid"] for r in design.drop_missing(df, ["a", "b"]).collect()] == ["1", "4"]
    assert [r["iid"] for r in design.drop_missing(df, ["a", "b"], extra=("-9",)).collect()] == ["1"]
    assert design.drop_missing(df, ["a"], "default").where("a = ''").count() == 1
    with pytest.raises(Exception, match="missing value in a"):
        design.drop_missing(df, ["a"], "throw").collect()
    assert [r["y"] for r in design.trait(df, 2).collect()] == [1.5, -9.0]
    with pytest.raises(InvalidArgument):
        design.trait(df, 7)


def test_dummies(spark):
    df = spark.createDataFrame([(0, "B", "X"), (1, "A", "Y"), (2, "C", "X"), (3, "A", "Z")], "sample_idx long, Group string, Site string")
    wide, names = design.dummy_encode(df, ["Group", "Site"])
    assert names == [("Group", "A"), ("Group", "C"), ("Site", "Y"), ("Site", "Z")]
    x = design.design_matrix(wide, [], [f"{c}_{v}" for c, v in names]).orderBy("sample_idx")
    assert [r["x"] for r in x.collect()] == [[1, 0, 0, 0, 0], [1, 1, 0, 1, 0], [1, 0, 1, 0, 0], [1, 1, 0, 0, 1]]
    assert {r["column"]: r["norm2"] for r in design.column_norms(x).collect()} == {0: 4, 1: 2, 2: 1, 3: 1, 4: 1}


def test_rank_transforms(spark):
    y = [1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame(list(enumerate(y)), "k long, y double")
    got = [r["rank"] for r in design.average_rank(df).orderBy("k").collect()]
    assert got == [1, 3, 3, 3, 5.5, 5.5, 7, 8]
    z = [r["y_int"] for r in design.direct_int(df).orderBy("k").collect()]
    assert z[1] == z[2] == z[3] and sorted(z) == z
    draws = np.exp(np.random.default_rng(1).normal(size=1000))
    z = np.array([r["y_int"] for r in design.direct_int(spark.createDataFrame([(float(v),) for v in draws], "y double")).collect()])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def test_residuals(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    y = 3 + x @ [1.0, -2.0] + rng.normal(size=50)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(50)], "k long, y double, a double, b double")
    got = np.array([r["residual"] for r in design.residuals(df, "y", ["a", "b"]).orderBy("k").collect()])
    full = np.column_stack([np.ones(50), x])
    assert np.allclose(got, y - full @ np.linalg.lstsq(full, y, rcond=None)[0])
    assert design.indirect_int(df, "y", ["a"]).count() == 50
