import numpy as np
import pytest

from heritas import cli
from heritas.errors import KINDS, EngineError, InvalidArgument
from heritas.plans import commands as c
from tests.test_models import genotypes
from tests.test_sources import trio


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    g = genotypes(120, 40, 8)
    prefix = trio(folder, g, ["1"] * 20 + ["2"] * 20)
    rng = np.random.default_rng(2)
    z = np.nan_to_num(g - np.nanmean(g, axis=1, keepdims=True))
    y = 1 + 0.9 * z[5] - 0.8 * z[30] + rng.normal(size=120)
    with open(folder / "p.tsv", "w") as f:
        f.write("FID\tIID\tt1\n" + "".join(f"fam{i % 5 + 1}\ts{i}\t{'NA' if i == 7 else y[i]}\n" for i in range(120)))
    with open(folder / "q.tsv", "w") as f:
        f.write("FID\tIID\tage\n" + "".join(f"fam{i % 5 + 1}\ts{i}\t{20 + i % 30}\n" for i in range(120)))
    with open(folder / "d.tsv", "w") as f:
        f.write("FID\tIID\tsex\n" + "".join(f"fam{i % 5 + 1}\ts{i}\t{'FM'[i % 2]}\n" for i in range(120)))
    return folder, prefix


def test_grm_assoc(spark, study):
    folder, prefix = study
    out = str(folder / "g")
    assert len(c.run_grm(spark, prefix, out, by_chromosome=True)) == 3
    for loco in (False, True):
        found = c.run_assoc(spark, str(folder / "p.tsv"), prefix, [out + ".add"], str(folder / "a"), qcovar=str(folder / "q.tsv"), dcovar=str(folder / "d.tsv"), loco=loco)
        best = [r["snp_idx"] for r in found.orderBy("p").limit(2).collect()]
        assert set(best) == {5, 30}
        lines = open(folder / "a.gwas.tsv").read().splitlines()
        assert lines[0].split("\t") == ["CHR", "SNP", "BP", "A1", "A2", "A1FREQ", "BETA", "SE", "P"] and len(lines) == 41 and lines[6].split("\t")[1] == "rs5"
    for how in ("dint", "iint"):
        assert c.run_assoc(spark, str(folder / "p.tsv"), prefix, [out + ".add"], str(folder / "b"), qcovar=str(folder / "q.tsv"), transform=how).count() == 40
    with pytest.raises(InvalidArgument):
        c.run_assoc(spark, str(folder / "p.tsv"), prefix, [out + ".add"], geno_method="OSH")


def test_fit_predict_post(spark, study):
    folder, prefix = study
    out = str(folder / "fit")
    c.run_fit(spark, str(folder / "p.tsv"), prefix, "RRd", out, qcovar=str(folder / "q.tsv"), dcovar=str(folder / "d.tsv"), iterations=60, burn_in=20, chains=2)
    terms = [x.split("\t")[0] for x in open(out + ".params").read().splitlines()]
    assert terms == ["term", "Intercept", "age", "sex_M", "sex_F", "σ²_add", "h²", "σ²_dom", "δ²", "σ²_e"]
    got = c.run_predict(spark, prefix, out + ".snp.eff", str(folder / "pred.tsv"), out + ".params", str(folder / "q.tsv"), str(folder / "d.tsv"))
    assert got.count() == 120
    head = open(folder / "pred.tsv").readline().strip().split("\t")
    assert head == ["FID", "IID", "prediction", "intercept", "age_effect", "sex_effect", "additive", "dominant"]
    assert c.run_post(spark, [f"{out}.chain{k}" for k in (0, 1)]).count() == 5
    plain = c.run_predict(spark, prefix, out + ".snp.eff", str(folder / "pred2.tsv"))
    assert plain.where("intercept <> 0").count() == 0


def test_simulate(spark, study):
    folder, prefix = study
    c.run_simulate(spark, prefix, str(folder / "sim.phen"), h2=0.4, d2=0.1)
    lines = open(folder / "sim.phen").read().splitlines()
    assert lines[0] == "FID\tIID\tphenotype" and len(lines) == 121
    assert len(open(folder / "sim.causal").read().splitlines()) == 41


def test_cli(spark, study):
    folder, prefix = study
    args = cli.parser().parse_args(["grm", "-b", prefix, "-o", str(folder / "cli"), "--dom"])
    cli.run(args, spark)
    assert (folder / "cli.dom.bin").exists()
    a = cli.parser().parse_args(["assoc", "-p", "p", "-b", "b", "--grm", "g"])
    assert (a.pheno_col, a.max_iter, a.tol, a.geno_method, a.int_offset) == (2, 100, 1e-6, "OCH", 0.375)
    assert len(KINDS) == 13 and all(issubclass(k, EngineError) for k in KINDS)
