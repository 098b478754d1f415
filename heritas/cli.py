"""python -m heritas.cli COMMAND: fit, simulate, predict, grm, assoc, post."""

from __future__ import annotations

import argparse
import sys

from heritas.errors import EngineError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="heritas")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *required):
        p = sub.add_parser(name)
        for flags, dest in required:
            p.add_argument(*flags, dest=dest, required=True)
        return p

    def data(p):
        p.add_argument("--pheno-col", type=int, default=2)
        p.add_argument("--qcovar", default="")
        p.add_argument("--dcovar", default="")

    def work(p, *more):
        """Options of the one-machine world: Spark's settings decide instead, where
        they say something."""
        p.add_argument("-c", "--chunk-size", type=int, default=None, help="loci of a partition")
        p.add_argument("-t", "--threads", type=int, default=None, help="tasks at a time: local[N] where no master is set")
        for name in more:
            p.add_argument(name, action="store_true", help="no effect: tasks read their own ranges of files")

    pheno, bfile = (("-p", "--pheno"), "pheno"), (("-b", "--bfile"), "bfile")
    p = command("fit", pheno, bfile, (("-m", "--method"), "model"))
    data(p)
    p.add_argument("-o", "--out", default="heritas")
    p.add_argument("--geno-method", default="OSH")
    for name in ("pi", "scale", "dpi", "dscale"):
        p.add_argument(f"--{name}", type=float, nargs="+")
    p.add_argument("--iters", type=int, default=5000)
    p.add_argument("--burn-in", type=int, default=3000)
    p.add_argument("--thin", type=int, default=1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--chains", type=int, default=1)
    work(p, "--mmap")

    p = command("assoc", pheno, bfile)
    p.add_argument("--grm", nargs="+", required=True)
    data(p)
    p.add_argument("-o", "--out", default="heritas")
    p.add_argument("--max-iter", type=int, default=100)
    p.add_argument("--tol", type=float, default=1e-6)
    p.add_argument("--loco", action="store_true")
    p.add_argument("--model", default="a")
    p.add_argument("--geno-method", default="OCH")
    p.add_argument("--transform", default="none")
    p.add_argument("--int-offset", type=float, default=0.375)
    work(p)

    p = command("grm", bfile)
    p.add_argument("-o", "--out", default="grm")
    p.add_argument("--geno-method", default="OSH")
    for name in ("add", "dom", "loco"):
        p.add_argument(f"--{name}", action="store_true")
    work(p)

    p = command("predict", bfile, (("-e", "--snp-eff"), "snp_eff"), (("-o", "--out"), "out"))
    p.add_argument("--covar-eff", default="")
    p.add_argument("--qcovar", default="")
    p.add_argument("--dcovar", default="")
    p.add_argument("--absent", choices=("zero", "mean"), default="zero")

    p = command("simulate", bfile)
    p.add_argument("-o", "--out", default="sim.phen")
    p.add_argument("--intercept", type=float, default=0.0)
    p.add_argument("--h2", type=float, default=0.5)
    p.add_argument("--d2", type=float, default=0.0)
    for name in ("add", "dom"):
        p.add_argument(f"--{name}-var", type=float, nargs="+", default=[0.01])
        p.add_argument(f"--{name}-prop", type=float, nargs="+", default=[1.0])
    p.add_argument("--seed", type=int, default=42)

    p = command("post")
    p.add_argument("--in", dest="inputs", nargs="+", required=True)
    return top


def run(args: argparse.Namespace, spark) -> None:
    from heritas.plans import commands as c

    a = args
    if a.command == "fit":
        priors = {k: v for k, v in (("pi", a.pi), ("scales", a.scale), ("dpi", a.dpi), ("dscales", a.dscale)) if v}
        c.run_fit(spark, a.pheno, a.bfile, a.model, a.out, a.pheno_col, a.qcovar, a.dcovar, a.geno_method, a.iters, a.burn_in, a.thin, a.seed, a.chains, **priors)
    elif a.command == "assoc":
        c.run_assoc(spark, a.pheno, a.bfile, a.grm, a.out, a.pheno_col, a.qcovar, a.dcovar, a.max_iter, a.tol, a.loco, a.model, a.geno_method, a.transform, a.int_offset)
    elif a.command == "grm":
        c.run_grm(spark, a.bfile, a.out, a.geno_method, a.add, a.dom, a.loco)
    elif a.command == "predict":
        c.run_predict(spark, a.bfile, a.snp_eff, a.out, a.covar_eff, a.qcovar, a.dcovar, a.absent)
    elif a.command == "simulate":
        got = c.run_simulate(spark, a.bfile, a.out, a.intercept, a.h2, list(zip(a.add_prop, a.add_var)), a.d2, list(zip(a.dom_prop, a.dom_var)), a.seed)
        print(f"h2 {got.h2:.4f} d2 {got.d2:.4f}")
    else:
        c.run_post(spark, a.inputs).show(truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    session = SparkSession.builder.appName("heritas")
    if getattr(args, "threads", None):
        session = session.master(f"local[{args.threads}]")
    try:
        spark = session.getOrCreate()
        if getattr(args, "chunk_size", None):
            spark.conf.set("heritas.bed.partitionLoci", str(args.chunk_size))
        run(args, spark)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
