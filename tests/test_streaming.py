import numpy as np

from heritas.operators import grm
from heritas.streaming import blocks
from tests.test_models import encoded, frame, genotypes


def test_incremental_grm(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = frame(spark, genotypes(12, 20))
    df.where("snp_idx < 8").write.parquet(src)
    blocks.stream_grm(spark, src, out, ck).awaitTermination()
    df.where("snp_idx >= 8").write.mode("append").parquet(src)
    blocks.stream_grm(spark, src, out, ck).awaitTermination()
    z = encoded(spark, df)
    assert np.allclose(grm.to_matrix(grm.cells(blocks.read_tiles(spark, out), 12), 12), z.T @ z)


def test_incremental_moments(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    v = np.random.default_rng(1).normal(5, 2, 60)
    df = spark.createDataFrame([(i % 2, i, "p", float(x)) for i, x in enumerate(v)], "chain int, draw long, param string, value double")
    for cut in ("draw < 25", "draw >= 25"):
        df.where(cut).write.mode("append").parquet(src)
        blocks.stream_moments(spark, src, out, ck).awaitTermination()
    got = {r["chain"]: r for r in blocks.read_moments(spark, out).collect()}
    for c in (0, 1):
        assert got[c]["n"] == 30 and np.isclose(got[c]["mean"], v[c::2].mean()) and np.isclose(got[c]["sd"], v[c::2].std(ddof=1))
    blocks.stream_diagnostics(spark, src, str(tmp_path / "d"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).where("param = 'p'").count() >= 1
