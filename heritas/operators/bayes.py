"""Bayesian marker regression: Gibbs samplers of fourteen models.

A chain is sequential, so a Spark task runs a whole chain: run_chains sends the
encoded loci as one broadcast (size checked) and gets a draw a row back.  A sweep
needs products with the phenotype less all effects alone: either sample by sample
(Samples), or, of few loci, from the products over samples (Crossed, run_products),
whose size and time a sweep don't depend on the samples.

Models: A, B, Bpi, C, Cpi, R, RR with additive effects; Ad, Bd, Bdpi, Cd, Cdpi,
Rd, RRd with dominance too, sampled after the additive block of each sweep.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heritas.errors import InvalidArgument
from heritas.operators.products import Products

MODELS = ("A", "Ad", "B", "Bpi", "Bd", "Bdpi", "C", "Cpi", "Cd", "Cdpi", "R", "Rd", "RR", "RRd")
SPIKE_PI = (0.99, 0.01)
#: Adds up to 0.998 as published; it is scaled to 1 before use.
MIXTURE_PI = (0.99, 0.005, 0.001, 0.001, 0.001)
MIXTURE_SCALES = (0.0, 0.001, 0.01, 0.1, 1.0)
#: Shares of the phenotypic variance with which chains begin, and prior weights.
SHARE = {"add": 0.5, "dom": 0.2, "residual": 0.3}
NU_MARKER, NU_RESIDUAL = 4.0, -2.0
#: Bytes of encoded loci that may be broadcast to a chain's task: they have to fit
#: into a Python worker beside an executor's heap.
MAX_BYTES = 1 << 30


@dataclass
class Spec:
    kind: str  # A, B, C, R or RR
    dominance: bool
    estimate_pi: bool

    @staticmethod
    def of(name: str) -> Spec:
        for m in MODELS:
            if m.lower() == name.lower():
                pi = m.endswith("pi")
                base = m.removesuffix("pi")
                dom = base.endswith("d")
                kind = base.removesuffix("d")
                return Spec(kind, dom, pi or kind == "R")
        raise InvalidArgument(f"unknown model {name!r}; one of {', '.join(MODELS)}")


def scaled_inv_chi2(rng: np.random.Generator, nu: float, s2: float, sse: float, n: float) -> float:
    """Draw of a variance whose prior is (nu, s2) after n terms of sum of
    squares sse; without terms, of the prior itself."""
    df = nu + max(n, 0)
    if df <= 0:
        return max(s2, 1e-12)
    scale = nu * s2 + (sse if n > 0 else 0.0)
    return max(scale, 1e-300) / rng.chisquare(df)


class Samples:
    """The phenotype less all effects, sample by sample."""

    def __init__(self, y: np.ndarray, x: np.ndarray, z: dict[str, np.ndarray]):
        self.y, self.n, self.y_mean = np.asarray(y, float), len(y), 0.0
        self.columns = {"fixed": np.asarray(x, float).T, **z}
        self.e = self.y.copy()

    def variance_y(self) -> float:
        return float(self.y.var(ddof=1))

    def norms(self, name: str) -> np.ndarray:
        return np.einsum("ij,ij->i", self.columns[name], self.columns[name])

    def spread(self, name: str) -> float:
        return float(self.columns[name].var(axis=1, ddof=1).sum())

    def dot(self, name: str, j: int) -> float:
        return self.columns[name][j] @ self.e

    def add(self, name: str, j: int, effect: float) -> None:
        self.e -= self.columns[name][j] * effect

    def variance(self, name: str, b: np.ndarray) -> float:
        return float((b @ self.columns[name]).var(ddof=1))

    def square(self) -> float:
        return float(self.e @ self.e)


class Crossed:
    """The same by products over samples (operators.products): an intercept, and
    blocks named by effect."""

    def __init__(self, sums: Products):
        self.gram, self.n, self.y_mean = sums.gram, sums.n, sums.y_mean
        self.sums, self.first = sums, {"fixed": 0} | {k: v.start for k, v in sums.at.items()}
        self.places = {"fixed": np.array([0])} | {k: sums.columns(k) for k in sums.at}
        self.with_y, self.r, self.coef = sums.gram[:, 1].copy(), sums.gram[:, 1].copy(), np.zeros(len(sums.gram))

    def variance_y(self) -> float:
        return self.sums.variance

    def norms(self, name: str) -> np.ndarray:
        return self.gram[self.places[name], self.places[name]].copy()

    def spread(self, name: str) -> float:
        at = self.places[name]
        return float((self.gram[at, at] - self.gram[at, 0] ** 2 / self.n).sum()) / (self.n - 1)

    def dot(self, name: str, j: int) -> float:
        return self.r[self.first[name] + j]

    def add(self, name: str, j: int, effect: float) -> None:
        k = self.first[name] + j
        self.r -= self.gram[k] * effect
        self.coef[k] += effect

    def variance(self, name: str, b: np.ndarray) -> float:
        at = self.places[name]
        return max(float(b @ self.gram[np.ix_(at, at)] @ b - (self.gram[0, at] @ b) ** 2 / self.n), 0.0) / (self.n - 1)

    def square(self) -> float:
        # Rounding is put right once a sweep.
        self.r = self.with_y - self.gram @ self.coef
        return max(float(self.gram[1, 1] - self.coef @ self.with_y - self.coef @ self.r), 0.0)


@dataclass
class Block:
    """Marker effects of one kind, additive or dominance."""

    name: str
    space: Samples | Crossed
    spec: Spec
    pi: np.ndarray
    scales: np.ndarray
    var: np.ndarray
    s2: float
    b: np.ndarray = None
    cls: np.ndarray = None
    norm: np.ndarray = None
    live: np.ndarray = field(default=None)

    @staticmethod
    def make(name: str, space: Samples | Crossed, spec: Spec, var_y: float, pi=None, scales=None) -> Block:
        mixture = spec.kind == "R"
        pi = np.array(pi if pi is not None else MIXTURE_PI if mixture else SPIKE_PI, float)
        pi = pi / pi.sum()
        scales = np.array(scales if scales is not None else MIXTURE_SCALES, float)
        if mixture and len(pi) != len(scales):
            raise InvalidArgument("pi and scales differ in length")
        share = 1.0 if spec.kind in ("A", "RR") else 1 - pi[0]
        start = SHARE[name] * var_y / max(space.spread(name) * share, 1e-12)
        norm = space.norms(name)
        p = len(norm)
        each = p if spec.kind in ("A", "B") else 1
        return Block(name, space, spec, pi, scales, np.full(each, start), 0.5 * start, np.zeros(p), np.zeros(p, int), norm, np.flatnonzero(norm > 1e-10))

    def sweep(self, var_e: float, rng: np.random.Generator) -> None:
        """One pass over the loci."""
        kind, own = self.spec.kind, self.spec.kind in ("A", "B")
        log_pi = np.log(np.maximum(self.pi, 1e-300))
        coin, normal = rng.random(len(self.live)), rng.standard_normal(len(self.live))
        for t, j in enumerate(self.live):
            old, n2 = self.b[j], self.norm[j]
            rhs = self.space.dot(self.name, j) + n2 * old
            v = self.var[j if own else 0]
            k = 1
            if kind == "R":
                vk = v * self.scales
                with np.errstate(divide="ignore", invalid="ignore"):
                    lam = var_e / vk
                    score = -0.5 * (np.log(n2 / lam + 1) - rhs * rhs / (n2 + lam) / var_e) + log_pi
                score[self.scales == 0] = log_pi[self.scales == 0]
                prob = np.exp(score - score.max())
                k = int(min(np.searchsorted(np.cumsum(prob), coin[t] * prob.sum()), len(prob) - 1))
                v = vk[k]
            elif kind in ("B", "C"):
                lam = var_e / v
                score = -0.5 * (np.log(n2 / lam + 1) - rhs * rhs / (n2 + lam) / var_e)
                k = int(coin[t] >= 1 / (1 + np.exp(np.clip(score + log_pi[1] - log_pi[0], -700, 700))))
                v = v if k else 0.0
            self.cls[j] = k
            if v > 0:
                kappa = 1 / (n2 + var_e / v)
                new = rhs * kappa + normal[t] * np.sqrt(var_e * kappa)
            else:
                new = 0.0
            if new != old:
                self.space.add(self.name, j, new - old)
                self.b[j] = new
            if own and k:
                self.var[j] = scaled_inv_chi2(rng, NU_MARKER, self.s2, new * new, 1)
        live = self.live
        if kind == "RR":
            self.var[0] = scaled_inv_chi2(rng, NU_MARKER, self.s2, float(self.b @ self.b), len(live))
        elif kind == "C":
            self.var[0] = scaled_inv_chi2(rng, NU_MARKER, self.s2, float(self.b @ self.b), int((self.cls[live] > 0).sum()))
        elif kind == "R":
            inside = live[self.scales[self.cls[live]] > 0]
            self.var[0] = scaled_inv_chi2(rng, NU_MARKER, self.s2, float((self.b[inside] ** 2 / self.scales[self.cls[inside]]).sum()), len(inside))
        if self.spec.estimate_pi:
            self.pi = rng.dirichlet(np.bincount(self.cls[live], minlength=len(self.pi)) + 1.0)

    def class_variances(self) -> np.ndarray:
        """Genetic variance of each mixture class."""
        return np.array([self.space.variance(self.name, np.where(self.cls == k, self.b, 0.0)) if (self.cls == k).any() else 0.0 for k in range(len(self.pi))])


@dataclass
class Random:
    """A random effect: design (samples x levels), effects and variance."""

    w: np.ndarray
    var: float
    s2: float
    b: np.ndarray

    @staticmethod
    def make(w: np.ndarray, var_y: float) -> Random:
        return Random(w, 0.1 * var_y, 0.05 * var_y, np.zeros(w.shape[1]))

    def sweep(self, e: np.ndarray, var_e: float, rng: np.random.Generator) -> None:
        for k in range(self.w.shape[1]):
            x = self.w[:, k]
            c = x @ x + var_e / self.var
            new = (x @ e + (x @ x) * self.b[k]) / c + rng.standard_normal() * np.sqrt(var_e / c)
            e += x * (self.b[k] - new)
            self.b[k] = new
        self.var = scaled_inv_chi2(rng, NU_MARKER, self.s2, float(self.b @ self.b), len(self.b))


def sample(y: np.ndarray, x: np.ndarray, z: dict[str, np.ndarray], model: str, iterations: int = 5000, burn_in: int = 3000, thin: int = 1, seed: int = 42, pi=None, scales=None, dpi=None, dscales=None, random: list[np.ndarray] = ()):
    """Yield (draw, {parameter: value}) of one chain.  z: loci x samples by
    effect (add and, for models with dominance, dom)."""
    yield from sample_in(Samples(y, x, z), model, iterations, burn_in, thin, seed, pi, scales, dpi, dscales, random)


def sample_in(space: Samples | Crossed, model: str, iterations: int = 5000, burn_in: int = 3000, thin: int = 1, seed: int = 42, pi=None, scales=None, dpi=None, dscales=None, random: list[np.ndarray] = ()):
    """The same in a space, which the chain changes."""
    spec = Spec.of(model)
    if thin < 1 or not 0 <= burn_in <= iterations:
        raise InvalidArgument("burn-in must not exceed the iterations, and thin must be positive")
    if len(random) and isinstance(space, Crossed):
        raise InvalidArgument("random effects need the samples")
    names = space.columns if isinstance(space, Samples) else space.places
    if spec.dominance != ("dom" in names):
        raise InvalidArgument(f"model {model} {'needs' if spec.dominance else 'has no'} dominance codes")
    rng = np.random.default_rng(seed)
    var_y = space.variance_y()
    blocks = [Block.make("add", space, spec, var_y, pi, scales)]
    if spec.dominance:
        blocks.append(Block.make("dom", space, spec, var_y, dpi, dscales))
    extra = [Random.make(np.asarray(w, float), var_y) for w in random]
    norm, draw = space.norms("fixed"), 0
    beta, var_e = np.zeros(len(norm)), SHARE["residual"] * var_y
    for it in range(iterations):
        for j in range(len(norm)):
            mean = space.dot("fixed", j) / norm[j] + beta[j]
            new = mean + rng.standard_normal() * np.sqrt(var_e / norm[j])
            space.add("fixed", j, new - beta[j])
            beta[j] = new
        for r in extra:
            r.sweep(space.e, var_e, rng)
        for block in blocks:
            block.sweep(var_e, rng)
        var_e = scaled_inv_chi2(rng, NU_RESIDUAL, 0.0, space.square(), space.n)
        if it < burn_in or (it + 1 - burn_in) % thin:
            continue
        g = {b.name: space.variance(b.name, b.b) for b in blocks}
        total = sum(g.values()) + var_e + sum(r.var for r in extra)
        out = {f"beta[{j}]": float(v) + (0.0 if j else space.y_mean) for j, v in enumerate(beta)} | {"sigma_e": var_e} | {f"sigma_random[{i}]": r.var for i, r in enumerate(extra)}
        for b in blocks:
            out |= {f"sigma_{b.name}": g[b.name], f"h2_{b.name}": g[b.name] / total}
            if spec.kind in ("B", "C", "R"):
                out |= {f"pi_{b.name}[{k}]": float(v) for k, v in enumerate(b.pi)}
            if spec.kind == "R" and len(b.pi) > 2:
                out |= {f"sigma_{b.name}[{k}]": float(v) for k, v in enumerate(b.class_variances())}
        yield draw, out, {b.name: (b.b.copy(), b.cls.copy()) for b in blocks}
        draw += 1


SUMMARY = "chain int, kind string, effect string, snp_idx long, param string, draw long, value double"


def run_chains(spark: SparkSession, y: np.ndarray, x: np.ndarray, z: dict[str, np.ndarray], model: str, chains: int = 2, seed: int = 42, **how) -> DataFrame:
    """One task a chain.  Rows of kind `draw` have a scalar parameter's value;
    rows of kind `mean`, `sd` and `class[k]` have a locus's posterior mean,
    standard deviation and share of draws in class k."""
    size = sum(v.nbytes for v in z.values())
    if size > MAX_BYTES:
        raise InvalidArgument(f"encoded loci take {size} bytes; a chain's task holds {MAX_BYTES}")
    return _chains(spark, Samples, (np.asarray(y, float), np.asarray(x, float), z), model, chains, seed, how)


def run_products(spark: SparkSession, sums: Products, model: str, chains: int = 2, seed: int = 42, **how) -> DataFrame:
    """run_chains by products over samples: an intercept, and blocks add and, for
    models with dominance, dom."""
    return _chains(spark, Crossed, (sums,), model, chains, seed, how)


def _chains(spark: SparkSession, space: type, given: tuple, model: str, chains: int, seed: int, how: dict) -> DataFrame:
    shared = spark.sparkContext.broadcast(given)
    spec = Spec.of(model)

    def one(frames):
        for pdf in frames:
            for chain in pdf["chain"].tolist():
                rows, count, first, second, member = [], 0, {}, {}, {}
                for draw, scalars, effects in sample_in(space(*shared.value), model, seed=seed + 7919 * chain, **how):
                    rows += [(chain, "draw", None, None, p, draw, v) for p, v in scalars.items()]
                    count += 1
                    for name, (b, cls) in effects.items():
                        d = b - first[name] if name in first else b
                        first[name] = first[name] + d / count if name in first else b.copy()
                        second[name] = second[name] + d * (b - first[name]) if name in second else np.zeros(len(b))
                        if spec.kind in ("B", "C", "R"):
                            k = len(MIXTURE_PI) if spec.kind == "R" else 2
                            k = max(k, int(cls.max(initial=0)) + 1)
                            member.setdefault(name, np.zeros((k, len(b))))
                            np.add.at(member[name], (cls, np.arange(len(b))), 1)
                for name, m in first.items():
                    sd = np.sqrt(second[name] / max(count - 1, 1))
                    rows += [(chain, "mean", name, j, None, None, v) for j, v in enumerate(m)]
                    rows += [(chain, "sd", name, j, None, None, v) for j, v in enumerate(sd)]
                    for k, share in enumerate(member.get(name, [])):
                        rows += [(chain, f"class[{k}]", name, j, None, None, v / count) for j, v in enumerate(share)]
                out = pd.DataFrame(rows, columns=["chain", "kind", "effect", "snp_idx", "param", "draw", "value"])
                yield out.astype({"snp_idx": "Int64", "draw": "Int64"})

    seeds = spark.range(chains, numPartitions=chains).selectExpr("CAST(id AS int) AS chain")
    return seeds.mapInPandas(one, SUMMARY)


def draws(result: DataFrame) -> DataFrame:
    return result.where("kind = 'draw'").select("chain", "draw", "param", "value")


def component_count(model: str, scales: list[float] | None = None) -> int:
    """Classes of a model's marker effects; 0 where it has none."""
    kind = Spec.of(model).kind
    return len(scales or MIXTURE_SCALES) if kind == "R" else 2 if kind in ("B", "C") else 0


def explained(effect: Column, var_y: Column) -> Column:
    """Share of the phenotype's variance that a locus explains."""
    return effect * effect / var_y


def class_shares(draws: DataFrame, by: list[str], cls: str, classes: int) -> DataFrame:
    """by, p0, p1, ...: shares of draws in each class, and pip, that of classes
    but 0."""
    share = [F.avg((F.col(cls) == k).cast("double")).alias(f"p{k}") for k in range(classes)]
    return draws.groupBy(*by).agg(*share, F.avg((F.col(cls) > 0).cast("double")).alias("pip"))


def effects(result: DataFrame, var_y: float, classes: int = 0) -> DataFrame:
    """snp_idx, effect, mean, sd, pve, pip over all chains; models without
    classes have pip 1.  For models of more than two classes (component_count),
    there are pi_0, pi_1, ..., the shares of draws in each class, too."""
    more = range(classes) if classes > 2 else []
    loci = result.where("kind <> 'draw'")
    one = loci.groupBy("snp_idx", "effect").agg(
        F.avg(F.when(F.col("kind") == "mean", F.col("value"))).alias("mean"),
        F.sqrt(F.avg(F.when(F.col("kind") == "sd", F.col("value") * F.col("value"))) + F.coalesce(F.var_pop(F.when(F.col("kind") == "mean", F.col("value"))), F.lit(0.0))).alias("sd"),
        F.avg(F.when(F.col("kind") == "class[0]", F.col("value"))).alias("out"),
        *[F.avg(F.when(F.col("kind") == f"class[{k}]", F.col("value"))).alias(f"pi_{k}") for k in more],
    )
    return one.select("snp_idx", "effect", "mean", "sd", explained(F.col("mean"), F.lit(float(var_y))).alias("pve"), (1 - F.coalesce("out", F.lit(0.0))).alias("pip"), *[f"pi_{k}" for k in more])
