"""Variance components by restricted maximum likelihood.

Components are ordered residual, random effects, genetic effects.  The fit
takes one EM step, then average-information steps.  Of dense kernels (Model) the
driver holds a few n x n matrices, which grm.DRIVER_SAMPLES bounds.  Kernels of few
loci (Factored) are never made: all that the same steps need comes from the products
over samples, loci by loci, for any number of samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from heritas.errors import InvalidArgument, NumericalError
from heritas.operators.products import Products


@dataclass
class Model:
    y: np.ndarray
    x: np.ndarray
    genetic: dict[str, np.ndarray]
    random: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def kernels(self) -> list[np.ndarray]:
        """Of all components but the residual."""
        return [*self.random.values(), *self.genetic.values()]

    @property
    def names(self) -> list[str]:
        return ["residual", *self.random, *self.genetic]

    @property
    def samples(self) -> int:
        return len(self.y)

    @property
    def variance(self) -> float:
        return float(self.y.var(ddof=1))

    @property
    def terms(self) -> int:
        return self.x.shape[1]


@dataclass
class Factored:
    """A model with an intercept whose kernels are F F', F being columns of products
    (operators.products) times a factor.  genetic: block, kept columns of it, and
    the number that F F' is divided by."""

    products: Products
    genetic: dict[str, tuple[str, np.ndarray | None, float]]
    random: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.random:
            raise InvalidArgument("random effects need a dense model")
        own, by, self.own = [], [], {}
        for name, (block, keep, k) in self.genetic.items():
            at = self.products.columns(block)
            at = at if keep is None else at[np.asarray(keep)]
            self.own[name] = slice(2 + len(own), 2 + len(own) + len(at))
            own, by = own + at.tolist(), by + [1 / np.sqrt(k)] * len(at)
        self.places, self.factors = np.array([0, 1, *own]), np.array([1.0, 1.0, *by])
        #: Products of the intercept, y and the factors' columns.
        self.gram = self.products.gram[np.ix_(self.places, self.places)] * np.outer(self.factors, self.factors)

    @property
    def names(self) -> list[str]:
        return ["residual", *self.genetic]

    @property
    def samples(self) -> int:
        return self.products.n

    @property
    def variance(self) -> float:
        return self.products.variance

    @property
    def terms(self) -> int:
        return 1

    def against(self, block: str) -> np.ndarray:
        """Products of a block's columns with those of gram."""
        return self.products.gram[np.ix_(self.products.columns(block), self.places)] * self.factors


@dataclass
class Fit:
    names: list[str]
    sigma: np.ndarray
    sigma_se: np.ndarray
    beta: np.ndarray
    beta_se: np.ndarray
    random_values: dict[str, np.ndarray]
    heritability: dict[str, tuple[float, float]]
    log_likelihood: float
    aic: float
    bic: float
    iterations: int
    converged: bool
    v_inverse: np.ndarray | None
    warnings: list[str]
    #: Of a factored model, which has no v_inverse: the point that was reached.
    point: FactoredPoint | None = None

    def rows(self) -> list[tuple[str, float, float]]:
        return [(n, float(s), float(e)) for n, s, e in zip(self.names, self.sigma, self.sigma_se)]


def initial(model: Model | Factored) -> np.ndarray:
    """Half of the variance is residual; genetic effects share the other half;
    random effects share a fifth."""
    v = model.variance
    g, r = len(model.genetic), len(model.random)
    return np.array([0.5 * v, *[0.2 * v / max(r, 1)] * r, *[0.5 * v / max(g, 1)] * g])


def _inverse(a: np.ndarray, what: str) -> tuple[np.ndarray, float]:
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise NumericalError(f"{what} isn't positive definite") from e
    return np.linalg.inv(a), 2 * float(np.log(np.diag(low)).sum())


@dataclass
class Point:
    """All that depends on the components' values."""

    v_inverse: np.ndarray
    p: np.ndarray
    py: np.ndarray
    xvx_inverse: np.ndarray
    log_likelihood: float


@dataclass
class FactoredPoint:
    """The same without n x n numbers.  V^-1 and P map the span of the columns
    B = [1, y, F] to itself: V^-1 B = B v, P B = B p."""

    v: np.ndarray
    p: np.ndarray
    bvb: np.ndarray
    bpb: np.ndarray
    xvx_inverse: np.ndarray
    log_likelihood: float
    #: V^-1 = (I - F middle F') / sigma_e.
    middle: np.ndarray
    sigma_e: float
    trace_p: float

    def quadratic(self, w: np.ndarray, size: np.ndarray) -> np.ndarray:
        """w' V^-1 w of columns from their products with B and their squares' sums."""
        own = w[:, 2:]
        return (size - np.einsum("ij,jk,ik->i", own, self.middle, own)) / self.sigma_e


def evaluate_factored(model: Factored, sigma: np.ndarray) -> FactoredPoint:
    g, wide = model.gram, [at.stop - at.start for at in model.own.values()]
    d = np.sqrt(np.repeat(sigma[1:], wide))
    inner, logdet = _inverse(sigma[0] * np.eye(len(d)) + np.outer(d, d) * g[2:, 2:], "V")
    middle = np.outer(d, d) * (inner + inner.T) / 2
    v = np.eye(len(g))
    v[2:] -= middle @ g[2:]
    v /= sigma[0]
    bvb = g @ v
    bvb = (bvb + bvb.T) / 2
    xvx, logdet_x = _inverse(bvb[:1, :1], "X'V^-1X")
    onto = np.zeros_like(v)
    onto[:1] = xvx @ bvb[:1]
    p, bpb = v - v @ onto, bvb - bvb[:, :1] @ onto[:1]
    trace = (model.samples - float((middle * g[2:, 2:]).sum())) / sigma[0] - float(np.trace(xvx @ (v.T @ g @ v)[:1, :1]))
    logdet_v = (model.samples - len(d)) * float(np.log(sigma[0])) + logdet
    return FactoredPoint(v, p, bvb, bpb, xvx, -0.5 * (logdet_v + logdet_x + float(bpb[1, 1])), middle, float(sigma[0]), trace)


def evaluate(model: Model | Factored, sigma: np.ndarray) -> Point | FactoredPoint:
    if isinstance(model, Factored):
        return evaluate_factored(model, sigma)
    v = np.diag(np.full(len(model.y), sigma[0]))
    for s, k in zip(sigma[1:], model.kernels):
        v = v + s * k
    vi, logdet_v = _inverse(v, "V")
    vi = (vi + vi.T) / 2
    vx = vi @ model.x
    xvx, logdet_x = _inverse(model.x.T @ vx, "X'V^-1X")
    p = vi - vx @ xvx @ vx.T
    py = p @ model.y
    return Point(vi, p, py, xvx, -0.5 * (logdet_v + logdet_x + float(model.y @ py)))


def _derivatives(model: Model | Factored, at: Point | FactoredPoint) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y'P K P y and tr(P K) of every component's K, and the products y'P K P K P y."""
    if isinstance(model, Factored):
        u = np.zeros((len(model.gram), 1 + len(model.own)))
        u[:, 0] = at.p[:, 1]
        for k, own in enumerate(model.own.values(), 1):
            u[own, k] = at.bpb[own, 1]
        quads = [at.p[:, 1] @ model.gram @ at.p[:, 1], *[float(at.bpb[own, 1] @ at.bpb[own, 1]) for own in model.own.values()]]
        return np.array(quads), np.array([at.trace_p, *[np.trace(at.bpb[own, own]) for own in model.own.values()]]), u.T @ at.bpb @ u
    kpy = [at.py, *[k @ at.py for k in model.kernels]]
    traces = [np.trace(at.p), *[float((at.p * k).sum()) for k in model.kernels]]
    u = np.stack(kpy, axis=1)
    return np.array([float(at.py @ x) for x in kpy]), np.array(traces), u.T @ at.p @ u


def em_step(model: Model | Factored, sigma: np.ndarray, at: Point | FactoredPoint) -> np.ndarray:
    n = model.samples
    quads, traces, _ = _derivatives(model, at)
    return (sigma * sigma * quads - sigma * sigma * traces + n * sigma) / n


def information(model: Model | Factored, at: Point | FactoredPoint) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, and the (negative) average-information matrix."""
    quads, traces, both = _derivatives(model, at)
    return -0.5 * (traces - quads), -0.5 * both


def ai_step(model: Model | Factored, sigma: np.ndarray, at: Point | FactoredPoint) -> np.ndarray:
    gradient, hessian = information(model, at)
    return sigma - np.linalg.pinv(hessian) @ gradient


def constrain(sigma: np.ndarray, variance: float) -> tuple[np.ndarray, bool]:
    """Negative components become 1e-6 of the variance; those components that
    exceed the share pay for it."""
    out, floor = np.array(sigma, float), 1e-6 * variance
    low = out < 0
    if not low.any():
        return out, False
    missing = float((floor - out[low]).sum())
    out[low] = floor
    share = missing / max(1, int((~low).sum()))
    pays = ~low & (out > share)
    out[pays] -= share
    return out, True


def heritability(names: list[str], sigma: np.ndarray, genetic: list[str]) -> dict[str, float]:
    """Each genetic component's share of the variance, without standard errors."""
    total = float(np.sum(sigma))
    return {n: float(s) / total for n, s in zip(names, sigma) if n in genetic} if total else {}


def report(spark: SparkSession, found: Fit, terms: list[str]) -> DataFrame:
    """section (fit, fixed, variance, heritability), name, estimate, se: what a fit
    has to say."""
    rows = [("fit", n, float(v), None) for n, v in (("logL", found.log_likelihood), ("AIC", found.aic), ("BIC", found.bic), ("iterations", found.iterations), ("converged", found.converged))]
    rows += [("fixed", t, float(b), float(e)) for t, b, e in zip(terms, found.beta, found.beta_se)]
    rows += [("variance", n, s, e) for n, s, e in found.rows()]
    rows += [("heritability", n, h, e) for n, (h, e) in found.heritability.items()]
    if len(found.heritability) > 1:
        kept = dict(zip(found.names, found.sigma))
        rows += [("variance", "total genetic", float(sum(kept[n] for n in found.heritability)), None), ("heritability", "total", sum(h for h, _ in found.heritability.values()), None)]
    return spark.createDataFrame(rows, "section string, name string, estimate double, se double")


def loco_report(spark: SparkSession, fits: dict[str, Fit]) -> DataFrame:
    """chrom, log_likelihood, component, variance, heritability, converged of every
    chromosome's null model, and the means over chromosomes (chrom `mean`)."""
    rows, all_ = [], {}
    for chrom, f in fits.items():
        for n, s in zip(f.names, f.sigma):
            h = f.heritability.get(n, (None,))[0]
            rows.append((chrom, float(f.log_likelihood), n, float(s), h, bool(f.converged)))
            all_.setdefault(n, []).append((float(s), h))
    for n, own in all_.items():
        shares = [h for _, h in own if h is not None]
        rows.append(("mean", None, n, sum(s for s, _ in own) / len(own), sum(shares) / len(shares) if shares else None, None))
    return spark.createDataFrame(rows, "chrom string, log_likelihood double, component string, variance double, heritability double, converged boolean")


def fit(model: Model | Factored, max_iter: int = 100, tol: float = 1e-6) -> Fit:
    """random_values: predicted effects; of a factored model, its columns' effects."""
    sigma, var_y = initial(model), model.variance
    at, before, done, warnings, turn = None, None, False, [], 0
    for turn in range(max_iter + 1):
        at = evaluate(model, sigma)
        step = em_step if turn == 0 else ai_step
        new, bounded = constrain(step(model, sigma, at), var_y)
        if bounded:
            warnings.append(f"turn {turn}: a component was negative")
        moved = np.linalg.norm(new - sigma) / max(np.linalg.norm(new), 1e-300)
        if before is not None:
            change = at.log_likelihood - before
            done = bool(moved < tol and (abs(change) < 1e-4 or (change < 0 and abs(change) < 1e-2)))
        before, sigma = at.log_likelihood, new
        if done:
            break
    if not done:
        warnings.append(f"no convergence in {max_iter} turns")
    _, hessian = information(model, at)
    cov = -np.linalg.pinv(hessian)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    if isinstance(model, Factored):
        beta = at.xvx_inverse @ at.bvb[:1, 1] + model.products.y_mean
        values = {n: s * model.factors[own] * at.bpb[own, 1] for (n, own), s in zip(model.own.items(), sigma[1:])}
    else:
        beta = at.xvx_inverse @ (model.x.T @ (at.v_inverse @ model.y))
        values = {n: s * (k @ at.py) for n, s, k in zip(model.names[1:], sigma[1:], model.kernels)}
    total, h2 = sigma.sum(), {}
    for i, name in enumerate(model.names):
        if name in model.genetic:
            slope = np.full(len(sigma), -sigma[i] / total**2)
            slope[i] += 1 / total
            h2[name] = (float(sigma[i] / total), float(np.sqrt(max(slope @ cov @ slope, 0))))
    k, n = len(sigma) + model.terms, model.samples
    narrow = at if isinstance(model, Factored) else None
    return Fit(model.names, sigma, se, beta, np.sqrt(np.diag(at.xvx_inverse)), values, h2, at.log_likelihood, -2 * at.log_likelihood + 2 * k, -2 * at.log_likelihood + k * float(np.log(n)), turn, done, None if narrow else at.v_inverse, warnings, narrow)
