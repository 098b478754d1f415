"""The six commands over files: fit, simulate, predict, grm, assoc, post."""

from __future__ import annotations

import os

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument
from heritas.functions.genotype import EFFECTS, center_method, method, with_encoding
from heritas.operators import assoc, bayes, design, diagnose, grm, loci, predict, reml, samples, simulate
from heritas.sources import binary, tables
from heritas.sources.plink import bed_path, read_bed, read_bim, read_fam


def _stem(bfile: str) -> str:
    return bed_path(bfile).removesuffix(".bed")


def _targets(spark: SparkSession, bfile: str, *others: DataFrame) -> tuple[list[tuple[str, str]], list[int]]:
    """Ids that all tables have, sorted by bytes, and their places in the .bed.
    As many as one matrix on the driver holds."""
    fam = read_fam(spark, _stem(bfile) + ".fam")
    ids = samples.require_samples(samples.intersect(fam, *others))
    if ids.count() > grm.DRIVER_SAMPLES:
        raise InvalidArgument(f"more than {grm.DRIVER_SAMPLES} samples")
    rows = samples.finalize(ids).join(fam, samples.ID).orderBy("sample_idx").collect()
    return [(r["fid"], r["iid"]) for r in rows], [r["raw_idx"] for r in rows]


def _genotypes(spark: SparkSession, bfile: str, keep: list[int]) -> DataFrame:
    return read_bed(spark, bed_path(bfile), keep=",".join(map(str, keep)))


def _ids(spark: SparkSession, ids: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(ids, "fid string, iid string")


class _Data:
    """Aligned phenotype and design on the driver."""

    def __init__(self, spark, pheno, bfile, pheno_col, qcovar, dcovar, extra=()):
        table = tables.read_frame(spark, pheno)
        y = design.trait(table, pheno_col)
        q = tables.read_frame(spark, qcovar) if qcovar else None
        d = tables.read_frame(spark, dcovar, "string") if dcovar else None
        self.ids, self.keep = _targets(spark, bfile, y, *[t for t in (q, d) if t is not None], *extra)
        order = spark.createDataFrame([(f, i, k) for k, (f, i) in enumerate(self.ids)], "fid string, iid string, sample_idx long")
        rows = samples.reindex(order, y)
        qs = [c for c in q.columns if c not in samples.ID] if q is not None else []
        rows = samples.reindex(rows, q) if q is not None else rows
        ds = [c for c in d.columns if c not in samples.ID] if d is not None else []
        rows = samples.reindex(rows, d) if d is not None else rows
        wide, self.dummies = design.dummy_encode(rows, ds)
        self.reference = [(c, r["level"]) for c in ds for r in design.levels(rows, c).where("level_idx = 0").collect()]
        self.quantitative = qs
        got = design.design_matrix(wide, qs, [f"{c}_{v}" for c, v in self.dummies]).select("sample_idx", "y", "x").orderBy("sample_idx").toPandas()
        self.y, self.x = got["y"].to_numpy(float), np.array(got["x"].tolist(), float)

    @property
    def terms(self) -> list[str]:
        return ["Intercept", *self.quantitative, *[f"{c}_{v}" for c, v in self.dummies]]

    def transform(self, how: str, offset: float) -> None:
        if how == "none":
            return
        if how not in ("dint", "iint"):
            raise InvalidArgument(f"transform {how!r} is none of none, dint, iint")
        v = self.y - self.x @ np.linalg.lstsq(self.x, self.y, rcond=None)[0] if how == "iint" else self.y
        _, place, size = np.unique(v, return_inverse=True, return_counts=True)
        rank = (np.cumsum(size) - (size - 1) / 2)[place]
        from statistics import NormalDist

        p = np.clip((rank - offset) / (len(v) - 2 * offset + 1), 1e-10, 1 - 1e-10)
        self.y = np.array([NormalDist().inv_cdf(u) for u in p])
        if how == "iint":
            self.x = np.ones((len(v), 1))


def run_grm(spark: SparkSession, bfile: str, out: str = "grm", geno_method: str = "OSH", add: bool = False, dom: bool = False, by_chromosome: bool = False) -> list[str]:
    """Write matrices of all samples: <out>.<effect>[.chr<name>].bin and .id."""
    kinds = [k for k, on in zip(EFFECTS, (add, dom)) if on] or ["add"]
    ids, keep = _targets(spark, bfile)
    rows, written = _genotypes(spark, bfile, keep), []
    by = "chrom" if by_chromosome else None
    if by:
        rows = rows.join(F.broadcast(read_bim(spark, _stem(bfile) + ".bim").select("snp_idx", "chrom")), "snp_idx")
    for kind in kinds:
        found = grm.tiles(rows, method(geno_method), kind, by=by, n=len(ids))
        if not by:
            binary.write_grm(f"{out}.{kind}", grm.tiles_to_matrix(found, len(ids)), ids)
            written.append(f"{out}.{kind}")
            continue
        # One pass over the loci; then a chromosome's tiles at a time come here.
        found, whole, own = found.persist(StorageLevel.DISK_ONLY), None, []
        for r in loci.loco_groups(read_bim(spark, _stem(bfile) + ".bim")).collect():
            part = grm.tiles_to_matrix(found.where(F.col("part") == r["chrom"]), len(ids))
            whole = part.copy() if whole is None else whole + part
            own.append(f"{out}.{kind}.chr{r['chrom']}")
            binary.write_grm(own[-1], part, ids)
        found.unpersist()
        if whole is not None:
            binary.write_grm(f"{out}.{kind}", whole, ids)
            written += [f"{out}.{kind}", *own]
    return written


def run_assoc(spark: SparkSession, pheno: str, bfile: str, grms: list[str], out: str = "heritas", pheno_col: int = 2, qcovar: str = "", dcovar: str = "", max_iter: int = 100, tol: float = 1e-6, loco: bool = False, model: str = "a", geno_method: str = "OCH", transform: str = "none", int_offset: float = 0.375) -> DataFrame:
    if not grms:
        raise InvalidArgument("a relationship matrix is needed")
    kind = {"a": "add", "d": "dom"}.get(model)
    if kind is None:
        raise InvalidArgument(f"model {model!r} is neither a nor d")
    center_method(geno_method)
    data = _Data(spark, pheno, bfile, pheno_col, qcovar, dcovar, [_ids(spark, binary.read_grm_ids(g)) for g in grms])
    data.transform(transform, int_offset)
    rows, variants = _genotypes(spark, bfile, data.keep), read_bim(spark, _stem(bfile) + ".bim")
    named = {binary.grm_kind(g) if len(grms) > 1 else "genetic": g for g in grms}
    if loco:
        chroms = [r["chrom"] for r in loci.loco_groups(variants).collect()]
        whole = {k: binary.load_grm(g, data.ids, False) for k, g in named.items()}
        parts = {c: {k: binary.load_grm(f"{g}.chr{c}", data.ids, False) for k, g in named.items()} for c in chroms}
        found, fits = assoc.loco_association(rows.join(variants.select("snp_idx", "chrom"), "snp_idx"), data.y, data.x, whole, parts, geno_method, kind, max_iter, tol)
    else:
        kernels = {k: binary.load_grm(g, data.ids) for k, g in named.items()}
        found, null = assoc.association(rows, reml.Model(data.y, data.x, kernels), geno_method, kind, max_iter, tol)
        fits = {"all": null}
    tables.write_report(reml.loco_report(spark, fits) if loco else reml.report(spark, fits["all"], data.terms), out + ".reml.tsv")
    tables.write_gwas(found, variants, out + ".gwas.tsv")
    return found


def run_fit(spark: SparkSession, pheno: str, bfile: str, model: str, out: str = "heritas", pheno_col: int = 2, qcovar: str = "", dcovar: str = "", geno_method: str = "OSH", iterations: int = 5000, burn_in: int = 3000, thin: int = 1, seed: int = 42, chains: int = 1, **priors) -> DataFrame:
    spec = bayes.Spec.of(model)
    data = _Data(spark, pheno, bfile, pheno_col, qcovar, dcovar)
    rows = _genotypes(spark, bfile, data.keep)
    z = {}
    for kind in ("add", "dom")[: 1 + spec.dominance]:
        enc = with_encoding(rows, geno_method, kind).select("snp_idx", "z")
        if enc.count() * len(data.y) * 8 > bayes.MAX_BYTES:
            raise InvalidArgument("the encoded loci don't fit a chain's task")
        z[kind] = np.array(enc.orderBy("snp_idx").toPandas()["z"].tolist(), float)
    got = bayes.run_chains(spark, data.y, data.x, z, model, chains, seed, iterations=iterations, burn_in=burn_in, thin=thin, **priors).persist()
    summary = {r["param"]: (r["mean"], r["stddev"]) for r in diagnose.posterior_summary(bayes.draws(got)).collect()}
    terms = [(t, *summary[f"beta[{j}]"]) for j, t in enumerate(data.terms)] + [(f"{c}_{v}", 0.0, 0.0) for c, v in data.reference]
    tables.write_params([*terms, *tables.genetic_terms(summary, list(z))], out + ".params")
    freq = with_encoding(rows, geno_method, "add").select("snp_idx", "a1_freq")
    tables.write_effects(bayes.effects(got, float(data.y.var(ddof=1)), bayes.component_count(model, priors.get("scales"))), read_bim(spark, _stem(bfile) + ".bim"), freq, out + ".snp.eff")
    names = ["sigma_e", "sigma_add", "h2_add"] + ["sigma_dom", "h2_dom"] * spec.dominance
    for c in range(chains):
        wide = bayes.draws(got).where((F.col("chain") == c) & F.col("param").isin(names)).groupBy("draw").pivot("param", names).agg(F.first("value")).orderBy("draw").toPandas()
        w = binary.ChainWriter(f"{out}.chain{c}.scalar_chain", len(names))
        for row in wide[names].to_numpy(float):
            w.write(row)
        w.finish()
    return got


def run_predict(spark: SparkSession, bfile: str, snp_eff: str, out: str, covar_eff: str = "", qcovar: str = "", dcovar: str = "", absent: str = "zero") -> DataFrame:
    q = tables.read_frame(spark, qcovar) if qcovar else None
    d = tables.read_frame(spark, dcovar, "string") if dcovar else None
    ids, keep = _targets(spark, bfile, *[t for t in (q, d) if t is not None])
    intercept, continuous, categorical = tables.read_params(covar_eff) if covar_eff else (0.0, {}, {})
    model = tables.read_effects(spark, snp_eff)
    target = loci.check_targets(read_bim(spark, _stem(bfile) + ".bim"))
    matched = loci.match(target, model).join(_genotypes(spark, bfile, keep), "snp_idx")
    score = predict.array_scores(loci.align(matched, model), len(ids), absent)
    who = spark.createDataFrame([(f, i, k) for k, (f, i) in enumerate(ids)], "fid string, iid string, sample_idx long")
    for t in (q, d):
        who = samples.reindex(who, t) if t is not None else who
    qs, ds = ([c for c in t.columns if c not in samples.ID] if t is not None else [] for t in (q, d))
    cov = predict.covariate_scores(who, intercept, continuous, categorical, qs, ds)
    terms = ["intercept", *[f"{c}_effect" for c in (*qs, *ds)], "additive", "dominant"]
    scored = predict.total(cov.join(score, "sample_idx"), terms).persist()
    tables.write_prediction(scored, out, terms)
    return scored


def run_simulate(spark: SparkSession, bfile: str, out: str = "sim", intercept: float = 0.0, h2: float = 0.5, add_classes=((1.0, 0.01),), d2: float = 0.0, dom_classes=((1.0, 0.01),), seed: int = 42) -> simulate.Simulated:
    ids, keep = _targets(spark, bfile)
    got = simulate.simulate(_genotypes(spark, bfile, keep), len(ids), h2, d2, add_classes, dom_classes, intercept, seed)
    who = spark.createDataFrame([(f, i, k) for k, (f, i) in enumerate(ids)], "fid string, iid string, sample_idx long")
    variants = read_bim(spark, _stem(bfile) + ".bim").select("snp_idx", "snp_id")
    prefix = out.removesuffix(".phen")
    tables.write_simulation(got.phenotype.join(who, "sample_idx"), got.causal.join(variants, "snp_idx"), prefix)
    return got


def run_post(spark: SparkSession, prefixes: list[str], prob: float = 0.9) -> DataFrame:
    """Diagnostics of <prefix>.scalar_chain files of one shape, a chain each."""
    if not prefixes:
        raise InvalidArgument("no chain files")
    chains = [np.array(binary.read_chain(p if p.endswith(".scalar_chain") else p + ".scalar_chain")) for p in prefixes]
    if len({c.shape for c in chains}) > 1 or chains[0].shape[0] not in (3, 5):
        raise InvalidArgument("chains differ in shape, or don't have 3 or 5 rows")
    names = ["sigma_e", "sigma_add", "h2_add", "sigma_dom", "h2_dom"][: chains[0].shape[0]]
    rows = [(c, d, n, float(v)) for c, x in enumerate(chains) for n, line in zip(names, x) for d, v in enumerate(line)]
    return diagnose.summary(spark.createDataFrame(rows, "chain int, draw long, param string, value double"), prob)


def require_folder(path: str) -> str:
    folder = os.path.dirname(path)
    if folder and not os.path.isdir(folder):
        raise InvalidArgument(f"{folder} isn't a folder")
    return path
