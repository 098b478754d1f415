import numpy as np
import pytest

from heritas.errors import InvalidArgument
from heritas.functions import genotype as gt


def loci(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "snp_idx long, dosage array<double>")


def encode(spark, row, name, kind="add"):
    return gt.with_encoding(loci(spark, row), name, kind).first()


def test_centre(spark):
    assert np.allclose(encode(spark, [0.0, 1.0, 2.0, 1.0, 0.0], "C")["z"], [-0.8, 0.2, 1.2, 0.2, -0.8])


def test_standardize(spark):
    r = encode(spark, [0.0, 1.0, 2.0, 1.0, 0.0], "s")
    assert r["mean"] == pytest.approx(0.8) and r["sd"] == pytest.approx(0.8366600265340756, rel=1e-10)
    assert np.allclose(r["z"], np.array([-0.8, 0.2, 1.2, 0.2, -0.8]) / r["sd"], rtol=1e-10)


def test_flat_loci_are_zero(spark):
    for row in ([2.0] * 5, [None] * 3, [1.0, None], []):
        r = encode(spark, row, "Standardize")
        assert r["is_monomorphic"] and r["z"] == [0.0] * len(row)


def reference(g, name, kind):
    m = gt.method(name)
    g = np.array([np.nan if v is None else v for v in g])
    ok = ~np.isnan(g)
    p = g[ok].sum() / (2 * ok.sum())
    q = 1 - p
    x = g.copy()
    if kind == "dom":
        x = np.where(g == 2, 4 * p - 2, np.where(g == 1, 2 * p, g)) if m.orthogonal else np.where(g == 2, 0, g)
    if m.hwe:
        mean, sd = (2 * p, np.sqrt(2 * p * q)) if kind == "add" else (2 * p * p, 2 * p * q) if m.orthogonal else (2 * p * q, np.sqrt(2 * p * q * (p * p + q * q)))
    else:
        mean, sd = x[ok].mean(), x[ok].std(ddof=1)
    z = np.where(ok, x - mean, 0)
    return z / sd if m.scale else z


@pytest.mark.parametrize("kind", gt.EFFECTS)
def test_all_methods_in_both_forms(spark, kind):
    g = [0.0, 1.0, 2.0, None, 1.0, 2.0, 2.0, 0.0, 1.0]
    long = spark.createDataFrame([(0, i, v) for i, v in enumerate(g)], "snp_idx long, sample_idx long, g double")
    for name in gt.METHODS:
        want = reference(g, name, kind)
        assert np.allclose(encode(spark, g, name, kind)["z"], want, atol=1e-12), name
        got = [r["z"] for r in gt.encode_long(long, name, kind).orderBy("sample_idx").collect()]
        assert np.allclose(got, want, atol=1e-12), name


def test_names():
    assert gt.method("orthstandardizehwe").name == "OSH"
    with pytest.raises(InvalidArgument):
        gt.method("X")
    with pytest.raises(InvalidArgument):
        gt.center_method("OSH")
    assert gt.center_method("och").name == "OCH"
