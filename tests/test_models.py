import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heritas.errors import DataError, InvalidArgument, NumericalError
from heritas.functions.genotype import with_encoding
from heritas.operators import assoc, bayes, grm, loci, predict, reml, simulate


def genotypes(n, p, seed=1, missing=0.02):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0.1, 0.5, p)[:, None], (p, n)).astype(float)
    g[rng.random((p, n)) < missing] = np.nan
    return g


def frame(spark, g):
    return spark.createDataFrame([(j, [None if math.isnan(v) else float(v) for v in row]) for j, row in enumerate(g)], "snp_idx long, dosage array<double>")


def encoded(spark, df, name="OSH", kind="add"):
    return np.array([r["z"] for r in with_encoding(df, name, kind).orderBy("snp_idx").collect()])


def test_grm_by_tiles(spark):
    g = genotypes(23, 40)
    df = frame(spark, g)
    z = encoded(spark, df)
    for tile in (5, 23, 64):
        got = grm.to_matrix(grm.cells(grm.tiles(df.repartition(3), "OSH", "add", tile), 23, tile), 23)
        assert np.allclose(got, z.T @ z, atol=1e-10)
    whole = grm.cells(grm.tiles(df), 23)
    norm = grm.to_matrix(grm.normalised(whole), 23)
    assert np.trace(norm) / 23 == pytest.approx(1)
    part = grm.cells(grm.tiles(df.where("snp_idx < 10")), 23)
    w, own = z.T @ z, z[:10].T @ z[:10]
    want = (w - own) / (np.trace(w) / 23 - np.trace(own) / 23)
    assert np.allclose(grm.to_matrix(grm.loco(whole, part), 23), want, rtol=1e-5)
    pick = spark.createDataFrame([(4, 0), (1, 1), (9, 2)], "raw_idx long, target long")
    assert np.allclose(grm.to_matrix(grm.subset(whole, pick), 3), w[np.ix_([4, 1, 9], [4, 1, 9])])
    with pytest.raises(DataError.__mro__[1]):
        grm.subset(whole, spark.createDataFrame([(99, 0)], "raw_idx long, target long"))
    with pytest.raises(InvalidArgument):
        grm.to_matrix(whole, 10**6)


def test_reml_recovers_heritability():
    rng = np.random.default_rng(5)
    z = genotypes(400, 300, 3, 0)
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    k = z.T @ z
    k /= np.trace(k) / len(k)
    u = z.T @ rng.normal(size=300)
    u *= 1 / u.std()
    y = 2 + u + rng.normal(size=400)
    f = reml.fit(reml.Model(y, np.ones((400, 1)), {"add": k}))
    assert f.converged and abs(f.heritability["add"][0] - 0.5) < 3 * f.heritability["add"][1] < 0.6
    # A maximum: the likelihood falls to both sides.
    at = lambda s: reml.evaluate(reml.Model(y, np.ones((400, 1)), {"add": k}), s).log_likelihood
    for d in ([0.05, 0], [-0.05, 0], [0, 0.05], [0, -0.05]):
        assert at(f.sigma) >= at(f.sigma + np.array(d)) - 1e-6
    assert f.aic == pytest.approx(-2 * f.log_likelihood + 6)
    assert f.random_values["add"].shape == (400,)


def test_constrain_and_errors():
    got, changed = reml.constrain(np.array([10, 20, -0.5, 40, 50.0]), 100)
    assert changed and got[2] == pytest.approx(1e-4) and (got[[0, 1, 3, 4]] < [10, 20, 40, 50]).all()
    with pytest.raises(NumericalError):
        reml.evaluate(reml.Model(np.ones(3), np.ones((3, 1)), {"a": -np.eye(3)}), np.array([1.0, 2.0]))


def test_scan_matches_dense_formulas(spark):
    g = genotypes(60, 25)
    g[3] = 1.0
    df = frame(spark, g)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 60))
    vi, y = np.linalg.inv(a @ a.T + np.eye(60)), rng.normal(size=60)
    rows = assoc.scan(df.repartition(3), vi, vi @ y).orderBy("snp_idx").collect()
    z = encoded(spark, df, "OCH")
    for r, x in zip(rows, z):
        if r["snp_idx"] == 3:
            assert r["beta"] is None and r["p"] is None
            continue
        beta, se = x @ vi @ y / (x @ vi @ x), 1 / np.sqrt(x @ vi @ x)
        assert r["beta"] == pytest.approx(beta) and r["se"] == pytest.approx(se)
        assert r["p"] == pytest.approx(math.erfc(abs(beta / se) / math.sqrt(2)))
    with pytest.raises(InvalidArgument):
        assoc.scan(df, vi, y, "OSH")
    flip = assoc.scan(frame(spark, 2 - g), vi, vi @ y).orderBy("snp_idx").collect()
    assert all(a["beta"] is None or a["beta"] == pytest.approx(-b["beta"]) for a, b in zip(rows, flip))


def test_loco(spark):
    g = genotypes(80, 30, 7)
    df = frame(spark, g).withColumn("chrom", F.when(F.col("snp_idx") < 15, "1").otherwise("2"))
    z = encoded(spark, df)
    y = np.random.default_rng(3).normal(size=80)
    x = np.ones((80, 1))
    parts = {"1": {"add": z[:15].T @ z[:15]}, "2": {"add": z[15:].T @ z[15:]}}
    found, fits = assoc.loco_association(df, y, x, {"add": z.T @ z}, parts)
    assert found.count() == 30 and set(fits) == {"1", "2"}


def test_islands_and_matching(spark):
    v = spark.createDataFrame([(i, c) for i, c in enumerate("1112233311")], "snp_idx long, chrom string")
    got = [(r["chrom"], r["first_snp"], r["end_snp"]) for r in loci.chromosome_islands(v).orderBy("island").collect()]
    assert got == [("1", 0, 3), ("2", 3, 5), ("3", 5, 8), ("1", 8, 10)]
    with pytest.raises(DataError):
        loci.loco_groups(v)
    model = spark.createDataFrame([(0, "a", "A", "G"), (1, "b", "C", "T"), (2, "c", "A", "C"), (3, "a", "T", "T")], "model_idx long, snp_id string, a1 string, a2 string")
    target = spark.createDataFrame([(0, "a", "a", "g"), (1, "b", "T", "C"), (2, "c", "A", "T"), (3, "d", "A", "C")], "snp_idx long, snp_id string, a1 string, a2 string")
    m = loci.match(target, model).orderBy("snp_idx")
    assert [(r["match_type"], r["model_idx"]) for r in m.collect()] == [("keep", 0), ("reverse", 1), ("skip", None), ("skip", None)]
    g = frame(spark, np.array([[0, 2.0], [1, 2.0], [2, 2.0], [0, 0.0]]))
    al = {r["model_idx"]: r["dosage"] for r in loci.align(m.join(g, "snp_idx"), model.select("model_idx")).collect()}
    assert al == {0: [0, 2], 1: [1, 0], 2: None, 3: None}
    with pytest.raises(DataError):
        loci.check_targets(target.union(target))


def test_scores(spark):
    model = spark.createDataFrame([(0, "a", 0.3, 0.1, 0.02), (1, "b", 0.4, -0.05, None), (2, "c", 0.2, 0.0, 0.0)], "model_idx long, snp_id string, a1_freq double, add double, dom double")
    g = np.array([[0, 2.0], [1, 1.0]])
    df = frame(spark, g)
    want = [(g[0, i] - 0.6) / math.sqrt(0.42) * 0.1 + (g[1, i] - 0.8) / math.sqrt(0.48) * -0.05 for i in (0, 1)]
    code = [0.0, 4 * 0.3 - 2]
    wantd = [(c - 2 * 0.09) / (2 * 0.3 * 0.7) * 0.02 for c in code]
    long = df.join(spark.createDataFrame([(0, "a"), (1, "b")], "snp_idx long, snp_id string"), "snp_idx").select("snp_id", F.posexplode("dosage").alias("sample_idx", "g"))
    for got in (predict.variant_scores(long, model), predict.array_scores(df.withColumnRenamed("snp_idx", "model_idx").join(model, "model_idx"), 2)):
        rows = got.orderBy("sample_idx").collect()
        assert np.allclose([r["additive"] for r in rows], want, atol=1e-8) and np.allclose([r["dominant"] for r in rows], wantd, atol=1e-8)
    lacking = model.where("snp_id = 'a'").withColumn("dosage", F.lit(None).cast("array<double>"))
    assert predict.array_scores(lacking, 1).first()["additive"] == pytest.approx(-0.6 / math.sqrt(0.42) * 0.1)
    assert predict.array_scores(lacking, 1, "mean").first()["additive"] == 0
    who = spark.createDataFrame([("x", 2.0)], "site string, age double")
    cov = predict.covariate_scores(who, 1, {"age": 0.5}, {"site": {"x": 0.25}}, ["age"], ["site"])
    assert predict.total(cov, ["intercept", "age_effect", "site_effect"]).first()["prediction"] == 2.25
    with pytest.raises(DataError):
        predict.covariate_scores(who, 1, {}, {}, ["age"])
    with pytest.raises(Exception, match="no coefficient for level"):
        predict.covariate_scores(who, 1, {}, {"site": {"y": 1.0}}, [], ["site"]).collect()


def test_simulation(spark):
    df = frame(spark, genotypes(300, 60, 9))
    got = simulate.simulate(df, 300, 0.5, 0.2, seed=3)
    assert got.phenotype.count() == 300 and got.causal.count() == 60
    assert abs(got.h2 - 0.5) < 0.15 and abs(got.d2 - 0.2) < 0.12
    again = simulate.simulate(df.repartition(5), 300, 0.5, 0.2, seed=3)
    a, b = ([r["phenotype"] for r in x.phenotype.orderBy("sample_idx").collect()] for x in (got, again))
    assert np.allclose(a, b)
    assert simulate.class_bounds(10, [(0.25, 1), (0.75, 1)]) == [3, 10]
    for bad in ([], [(0.5, 1.0)], [(1.0, -1.0)], [(0.0, 1.0), (1.0, 1.0)]):
        with pytest.raises(InvalidArgument):
            simulate.check_classes(bad)
    with pytest.raises(InvalidArgument):
        simulate.simulate(df, 300, 0.9, 0.2)


def test_bayes_samplers():
    rng = np.random.default_rng(11)
    g = genotypes(300, 30, 4, 0)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
    b = np.zeros(30)
    b[[3, 17]] = [0.8, -0.7]
    y = 1 + z.T @ b + rng.normal(size=300)
    for name in bayes.MODELS:
        both = {"add": z, "dom": np.abs(z) - 0.8} if bayes.Spec.of(name).dominance else {"add": z}
        mean, inside, n = np.zeros(30), np.zeros(30), 0
        for _, scalars, eff in bayes.sample(y, np.ones((300, 1)), both, name, 150, 50, 1, 2):
            mean += eff["add"][0]
            inside += eff["add"][1] > 0
            n += 1
        mean /= n
        assert n == 100 and abs(mean[3] - 0.8) < 0.25 and abs(mean[17] + 0.7) < 0.25, (name, mean[[3, 17]])
        assert np.abs(np.delete(mean, [3, 17])).max() < 0.3
        assert 0 < scalars["h2_add"] < 1 and all(math.isfinite(v) for v in scalars.values())
        if bayes.Spec.of(name).kind in "BCR" and not bayes.Spec.of(name).dominance and name != "RR":
            assert inside[3] / n > 0.9
    runs = [list(bayes.sample(y, np.ones((300, 1)), {"add": z}, "R", 20, 10, 1, 5)) for _ in range(2)]
    assert runs[0][-1][1] == runs[1][-1][1]
    with pytest.raises(InvalidArgument):
        bayes.Spec.of("X")
    list(bayes.sample(y, np.ones((300, 1)), {"add": z}, "RR", 10, 5, random=[np.eye(300)[:, :4]]))


def test_bayes_rr_matches_ridge():
    """With many draws the posterior mean is the ridge solution at the
    posterior's variances."""
    rng = np.random.default_rng(1)
    z = rng.normal(size=(10, 200))
    y = z.T @ rng.normal(size=10) * 0.3 + rng.normal(size=200)
    draws = list(bayes.sample(y, np.ones((200, 1)), {"add": z}, "RR", 1500, 500, 1, 3))
    mean = np.mean([d[2]["add"][0] for d in draws], axis=0)
    yc, zc = y - y.mean(), z - z.mean(1, keepdims=True)
    ve, vb = np.mean([d[1]["sigma_e"] for d in draws]), mean.var()
    assert np.allclose(mean, np.linalg.solve(zc @ zc.T + ve / vb * np.eye(10), zc @ yc), atol=0.03)


def test_chains_in_tasks(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(8, 50))
    y = z[2] + rng.normal(size=50)
    got = bayes.run_chains(spark, y, np.ones((50, 1)), {"add": z}, "C", chains=2, iterations=30, burn_in=10)
    assert bayes.draws(got).where("param = 'h2_add'").count() == 40
    eff = bayes.effects(got, float(y.var(ddof=1))).orderBy("snp_idx").collect()
    assert len(eff) == 8 and all(0 <= r["pip"] <= 1 for r in eff)
