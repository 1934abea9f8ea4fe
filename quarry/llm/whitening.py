"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become whole numbers x = floor(64 c) + 1000000.  The distinct vectors of these, n of them with sums S, are the
rows of the matrix; a row is centred, (n x - S) / n from exact whole numbers, before it is multiplied.  Bidiagonalisation
alternates products over the distributed rows: u = X v - beta u', then X' u, whose part beyond the earlier v gives the next
v.  Both sides are fully reorthogonalised: the v on the driver (vectors of one entry per dimension), the u by their
products with all earlier u, which the pass over the rows sums too.  A u is not stored with the rows; it is X w for a
vector w of one entry per dimension, so a step is one Spark job over the rows that brings back a few numbers per
dimension and step.  A direction that gives nothing new ends a block of the bidiagonal matrix, and one orthogonal to all
before starts the next, so equal deviations and constant dimensions do no harm.  The singular values and vectors of
the small bidiagonal matrix give the deviations and components.  There are as many steps as dimensions, as fewer would
miss the second of two equal variances.

A variance below 1e-12 of the largest counts as none: there is nothing to whiten, and its component is left out.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, as are vectors of no entry and
of another length than the most frequent one (ties: the longer), which lack entries; entries beyond 2^53 / 64 count as
that; repeated rows all get their results, equal vectors count once in the fit; ties between equal variances give any orthonormal
components; an empty table, or one with a single distinct vector, gives no rows; a squared deviation that a long can't hold ends the
query with an overflow error; kept columns travel in a struct, so names can't clash.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import attach, col, map_batches, written

SCALE, SHIFT = 64, 1_000_000
MOST = float(2 ** 53)


def integers(rows: DataFrame, keep: list[str], vector: str = "embedding") -> DataFrame:
    """``row`` (the kept columns) and x of the rows that stay."""
    v = col(rows, vector)
    x = F.transform(v, lambda c: F.floor(F.least(F.greatest(F.lit(SCALE) * c.cast("double"), F.lit(-MOST)), F.lit(MOST))).cast("long") + F.lit(SHIFT))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    sound = v.isNotNull() & (F.size(v) > 0) & ~bad
    kept = rows.where(sound).select(F.struct(*[col(rows, c).alias(c) for c in keep]).alias("row"), x.alias("x"))
    top = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("x") == F.lit(top[0] if top else 0))


def stacked(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


class Centre:
    """n, the sums and the centring of rows."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.sums = n, sums

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n x - S; whole numbers of any size where a long is too short."""
        most = max((int(np.abs(x).max()) if x.size else 0) * self.n, max((abs(int(s)) for s in self.sums), default=0))
        if most < 1 << 61:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(float) / self.n


def summed(rows: DataFrame, value, width: int) -> np.ndarray:
    """Sum over all rows of the vectors that ``value`` makes of blocks of them: one vector a task, added up in Spark."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            x = stacked(batch.column(0))
            for at in range(0, len(x), 8192):
                total += value(x[at:at + 8192])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "value"])

    found = map_batches(rows.select("x"), run, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for r in found:
        out[r["i"]] = r["value"]
    return out


def fit_list(x: DataFrame) -> tuple[DataFrame, Centre]:
    """The distinct vectors, written, and their centre."""
    fit = written(x.select("x").distinct(), "vectors")
    sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return fit, Centre(fit.count(), np.array([int(r["s"]) for r in sums], object))


def bidiagonal(fit: DataFrame, centre: Centre, seed: int = 7, tiny: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows and their right vectors (as rows), largest first."""
    d = len(centre.sums)
    rng = np.random.default_rng(seed)
    v_all = w_all = images = np.zeros((0, d))  # v, w and X'u = X'X w of each step
    alphas: list[float] = []
    betas: list[float] = []
    top = 0.0

    def beyond(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - v_all.T @ (v_all @ v)
        return v

    def step(z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Norm of the part of X z beyond the earlier u, its vector w, and X'X w."""
        columns = np.vstack([w_all, z]).T

        def products(x: np.ndarray) -> np.ndarray:
            rows = centre(x)
            y = rows @ columns  # the earlier u's entries of these rows, and those of X z
            return np.concatenate([rows.T @ y[:, -1], y.T @ y[:, -1]])

        got = summed(fit, products, d + len(w_all) + 1)
        image, along, square = got[:d], got[d:-1], got[-1]
        return float(np.sqrt(max(square - along @ along, 0.0))), z - w_all.T @ along, image - images.T @ along

    def fresh() -> np.ndarray:
        v = beyond(rng.standard_normal(d))
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        v_all = np.vstack([v_all, v])
        alpha, w, image = step(v - beta * w_all[-1] if beta else v)
        top = max(top, alpha, beta)
        if alpha > tiny * top:
            w, image = w / alpha, image / alpha
            if alpha < 0.01 * top:  # much was taken off: once more
                again, w, image = step(w)
                w, image = w / again, image / again
        else:  # X v lies in the span of the earlier u
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        alphas.append(alpha)
        w_all, images = np.vstack([w_all, w]), np.vstack([images, image])
        if len(alphas) == d:
            _, sigma, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            return sigma, right @ v_all
        rest = beyond(image)
        beta = float(np.linalg.norm(rest))
        v, beta = (rest / beta, beta) if beta > tiny * top else (fresh(), 0.0)
        betas.append(beta)


class Fit:
    """What whitening needs: the centre, components as rows, their variances, the trace, and the error found."""

    def __init__(self, centre: Centre, components: np.ndarray, variances: np.ndarray, trace: float):
        self.centre, self.components, self.variances, self.trace, self.error = centre, components, variances, trace, 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.components.T / np.sqrt(self.variances)


def learn(x: DataFrame, components: int = 16) -> Fit | None:
    """The fit over the distinct vectors; None where nothing varies."""
    fit, centre = fit_list(x)
    if centre.n < 2:
        return None
    trace = float(summed(fit, lambda b: np.array([np.square(centre(b)).sum()]), 1)[0]) / centre.n
    if not trace:
        return None
    sigma, vectors = bidiagonal(fit, centre)
    e = sigma ** 2 / centre.n
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    found = Fit(centre, vectors[:k], e[:k], trace)

    def covariance(b: np.ndarray) -> np.ndarray:
        y = found.whitened(b)
        return (y.T @ y).ravel()

    found.error = float(np.abs(summed(fit, covariance, k * k).reshape(k, k) / centre.n - np.eye(k)).max())
    return found


FIELDS = ("n", "deviation", "whitened", "explained", "identity_error")
SCHEMA = "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(rows: DataFrame, keep: list[str] | None = None, vector: str = "embedding", components: int = 16) -> DataFrame:
    """``row`` (the kept columns), n, deviation, whitened and explained (an entry per component) and identity_error of every
    row that stays."""
    x = integers(rows, rows.columns if keep is None else keep, vector)
    fit = learn(x, components)
    held = x.sparkSession.sparkContext.broadcast(fit)  # the components: two matrices of at most dimensions by dimensions

    def start():
        found = held.value

        def fn(vectors):
            out: dict[str, list] = {f: [] for f in FIELDS}
            for at in range(0, len(vectors), 4096):
                m = np.array(vectors[at:at + 4096], np.int64)
                whole = found.centre.whole(m)
                if float(np.abs(whole).max()) ** 2 * m.shape[1] >= 2 ** 62:  # as whole numbers of any size
                    whole = whole.astype(object)
                out["deviation"] += [Decimal(int(s)) for s in (whole * whole).sum(axis=1)]
                out["whitened"] += found.whitened(m).tolist()
            out["n"] = [found.centre.n] * len(vectors)
            out["explained"] = [(found.variances / found.trace).tolist()] * len(vectors)
            out["identity_error"] = [found.error] * len(vectors)
            return out
        return fn

    return attach(x if fit else x.limit(0), ["row", "x"], ["x"], SCHEMA, start).select("row.row", *FIELDS)


def report(rows: DataFrame) -> DataFrame:
    """The contract's digest: a row per vector and component."""
    out = whiten(rows, ["vec_id"])
    both = F.arrays_zip("whitened", "explained")
    return out.select(F.col("row.vec_id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error",
                      F.posexplode(both).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
