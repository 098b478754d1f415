"""Moments, report texts, transform lengths, tiles in groups, push-down."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument
from heritas.functions import text
from heritas.operators import diagnose, grm, moments, reml


def test_axis_moments(spark):
    x = np.random.default_rng(1).normal(3, 2, (7, 5))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    for ddof in (0, 1):
        got = [r["variance"] for r in moments.axis_variance(rows, "i", "v", ddof=ddof).orderBy("i").collect()]
        assert np.allclose(got, x.var(1, ddof=ddof))
        got = [r["variance"] for r in moments.axis_variance(rows, "i", "v", "column", ddof).orderBy("column").collect()]
        assert np.allclose(got, x.var(0, ddof=ddof))
    z = np.array([r["v"] for r in moments.standardised(rows, "v").orderBy("i").collect()])
    assert np.allclose(z, (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True))
    flat = spark.createDataFrame([(0, [2.0, 2.0]), (1, [1.0])], "i int, v array<double>")
    assert [r["v"] for r in moments.standardised(flat, "v").orderBy("i").collect()] == [[0.0, 0.0], [0.0]]
    assert moments.axis_variance(flat, "i", "v").where("i = 1").first()["variance"] is None
    with pytest.raises(InvalidArgument):
        moments.axis_variance(rows, "i", "v", "both")


def test_running_moments(spark):
    x = np.random.default_rng(2).normal(1e6, 1, 500)
    df = spark.createDataFrame([(k % 2, k % 7, float(v)) for k, v in enumerate(x)], "a int, b int, value double")
    whole = {r["a"]: r for r in moments.running(df, ["a"]).collect()}
    for got in (whole, {r["a"]: r for r in moments.merged(moments.running(df, ["a", "b"]), ["a"]).collect()}):
        for a in (0, 1):
            assert got[a]["n"] == 250 and got[a]["mean"] == pytest.approx(x[a::2].mean()) and got[a]["sd"] == pytest.approx(x[a::2].std(ddof=1), rel=1e-4)
    assert moments.running(df.limit(1), ["a"]).first()["sd"] == 0
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite"):
            moments.running(df.union(spark.createDataFrame([(0, 0, bad)], df.schema)), ["a"]).collect()


def test_report_texts():
    assert [text.abbreviated(v) for v in (5, 999, 1234, 150000, 3e6, 2.04e9, 0.25)] == ["5", "999", "1.2k", "150k", "3M", "2G", "0.2"]
    assert [text.clock(s) for s in (0, 61, 3725.9, -1, 1e9)] == ["00:00:00", "00:01:01", "01:02:05", "--:--:--", "--:--:--"]
    assert text.some(["a", "b"], 2) == "a, b" and text.some(["a", "b", "c"], 2) == "a, b, ... and 1 more" and text.some([], 3) == ""


def test_transform_lengths():
    def plain(n):
        for p in (2, 3, 5):
            while n % p == 0:
                n //= p
        return n == 1

    for n in range(1, 700):
        assert diagnose.smooth_size(n) == next(m for m in range(n, 2 * n + 1) if plain(m))


def test_autocorrelations(spark):
    x = np.arange(10.0)
    df = spark.createDataFrame([(0, k, "p", float(v)) for k, v in enumerate(x)], "chain int, draw long, param string, value double")
    got = [r["rho"] for r in diagnose.autocorrelations(df, 20, biased=False).orderBy("lag").collect()]
    assert np.allclose(got, [1, 0.78, 0.52, 0.21, -0.13, -0.52, -0.94, -1.4, -1.91, -2.45], atol=0.01)


def test_tiles_of_parts_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 3, (40, 23)).astype(float)
    df = spark.createDataFrame([(j, str(j % 3), row.tolist()) for j, row in enumerate(g)], "snp_idx long, chrom string, dosage array<double>").repartition(5)
    whole = grm.tiles_to_matrix(grm.tiles(df, "OC", "add", tile=7), 23, 7)
    z = g - g.mean(1, keepdims=True)
    assert np.allclose(whole, z.T @ z)
    monkeypatch.setattr(grm, "HELD_TILES", 3)  # ten tiles in four groups
    assert np.allclose(grm.tiles_to_matrix(grm.tiles(df, "OC", "add", tile=7, n=23), 23, 7), whole)
    assert np.allclose(grm.tiles_to_matrix(grm.tiles(df, "OC", "add", tile=7), 23, 7), whole)
    parted = grm.tiles(df, "OC", "add", tile=7, by="chrom", n=23)
    parts = grm.parts_to_matrices(parted, 23, 7)
    own = z[1::3].T @ z[1::3]
    assert np.allclose(parts["1"], own) and np.allclose(sum(parts.values()), whole)
    got = grm.to_matrix(grm.loco_of(parted, "1", 23, 7), 23)
    assert np.allclose(got, (whole - own) / (np.trace(whole) / 23 - np.trace(own) / 23))


def test_reports(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(60, 200))
    k = z @ z.T / 200
    y = z @ rng.normal(0, 0.1, 200) + rng.normal(size=60)
    found = reml.fit(reml.Model(y, np.ones((60, 1)), {"add": k}))
    rows = {(r["section"], r["name"]): r for r in reml.report(spark, found, ["Intercept"]).collect()}
    assert rows["fit", "AIC"]["estimate"] == pytest.approx(found.aic) and rows["fixed", "Intercept"]["se"] > 0 and rows["variance", "residual"]["estimate"] == pytest.approx(found.sigma[0])
    assert reml.heritability(found.names, found.sigma, ["add"])["add"] == pytest.approx(found.heritability["add"][0]) == pytest.approx(rows["heritability", "add"]["estimate"])
    loco = reml.loco_report(spark, {"1": found, "2": found}).where("component = 'add'").collect()
    assert {r["chrom"] for r in loco} == {"1", "2", "mean"} and len({round(r["variance"], 9) for r in loco}) == 1


def test_push_down_of_loci(spark, tmp_path):
    from heritas.sources import plink

    prefix = str(tmp_path / "g")
    g = np.random.default_rng(7).integers(0, 3, (50, 9))
    plink.write_plink(prefix, g, [("f", str(i)) for i in range(9)], [("1", f"r{j}", j, "A", "T") for j in range(50)])
    back = plink.read_bed(spark, prefix + ".bed", partitionLoci=5)
    part = back.where("snp_idx >= 12 AND snp_idx < 20 AND snp_idx <> 13")
    assert [r["snp_idx"] for r in part.select("snp_idx").orderBy("snp_idx").collect()] == [12, 14, 15, 16, 17, 18, 19]
    assert part.rdd.getNumPartitions() <= 2
    assert back.where("snp_idx > 60").count() == 0 and back.where(F.col("snp_idx") == 49).first()["dosage"] == g[49].tolist()


def test_transforms_on_the_driver_and_in_columns(spark):
    """What `assoc --transform` computes is what the columns' operators do."""
    from heritas.operators import design
    from heritas.plans import commands

    rng = np.random.default_rng(9)
    x = rng.normal(size=80)
    y = np.round(2 * x + rng.exponential(size=80), 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "i int, y double, x double")
    for how, got in (("dint", design.direct_int(df)), ("iint", design.indirect_int(df, "y", ["x"]))):
        data = commands._Data.__new__(commands._Data)
        data.y, data.x = y.copy(), np.column_stack([np.ones(80), x])
        data.transform(how, 0.375)
        assert np.allclose(data.y, [r["y_int"] for r in got.orderBy("i").collect()], atol=1e-6), how
