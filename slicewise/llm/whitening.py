"""Whitening of embeddings by shifted CholeskyQR.

Centred rows X are orthogonalised without ever being gathered: a pass sums the Gram matrix G of the
rows over all blocks, G + shift is factored as R'R, and the rows of the next pass are those of
Q = X R^-1, made block by block by triangular solves with the factors found so far. The first factor
is shifted, so that it exists for any rounding; the later ones bring Q to orthogonality. The product
of the factors is the R of X = QR, and the singular value decomposition of this small matrix gives
the eigenvalues and eigenvectors of the covariance to double precision, without squaring its condition.

Only matrices of dimension x dimension come to the driver, and vectors are integers until they are
centred, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100000, 8
#: Passes at most; three make the factors orthogonal unless rows are of deficient rank.
PASSES, ORTHOGONAL = 6, 1e-13
#: Directions with less than this share of the largest singular value are rounding, not data.
RANK = 1e-12
_LIMIT = float(1 << 62)


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: x = floor(1024 * c) + 100000 per entry c, as array<long>.

    Left out are vectors that are null, empty, or hold a null or non-finite entry, or one with
    1024 * c of 2**62 or more, for which a long has no room. Rows repeated with one id stay."""
    c = F.col("c")
    scaled = F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * SCALE))
    fine = F.forall(F.col(vector), lambda e: F.coalesce(F.abs(e.cast("double") * SCALE) < _LIMIT, F.lit(False)))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias(vector))
            .filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
            .select("vec_id", scaled.alias("c"))
            .select("vec_id", F.transform(c, lambda e: e + F.lit(OFFSET).cast("long")).alias("x")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def back_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Y with Y R = rows, for upper triangular R."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _summed(rows: DataFrame, make, kind: str = "double") -> np.ndarray | None:
    """Sum over all blocks of the matrix ``make(block)``, added up in each task, then by Spark: in
    doubles, or exactly in decimals. None without rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                one = make(_matrix(b["x"]))
                total = one if total is None else total + one
        if total is not None:
            i, j = np.indices(total.shape)
            v = total.ravel()
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": v if kind == "double" else v.astype(str)})

    parts = rows.select("x").mapInPandas(run, f"i int, j int, v {'double' if kind == 'double' else 'string'}")
    cells = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()     # dimension squared
    if not cells:
        return None
    out = np.empty((max(c["i"] for c in cells) + 1, max(c["j"] for c in cells) + 1), float if kind == "double" else object)
    for c in cells:
        out[c["i"], c["j"]] = float(c["v"]) if kind == "double" else int(c["v"])
    return out


def _moments(x: np.ndarray) -> np.ndarray:
    """Per dimension the exact sum and the number of rows, as Python integers."""
    fits = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
    sums = (x if fits else x.astype(object)).sum(0).astype(object)
    return np.column_stack([sums, np.full(x.shape[1], len(x), object)])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once: n * x - S is an exact integer."""
    return exact_deviations(x, n, sums).astype(np.float64) / n


def exact_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: 64-bit integers where they suffice, else Python's."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if largest < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


@dataclass
class Whitening:
    """``n`` rows with integer ``sums``; ``axes`` (columns) are unit eigenvectors of the covariance by
    falling ``eigenvalues``, without those of rounding; ``trace`` is that of the covariance."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def apply(self, x: np.ndarray, k: int) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.axes[:, :k] / np.sqrt(self.eigenvalues[:k])


def factor(gram: np.ndarray, rows: int, shift: bool) -> np.ndarray | None:
    """Upper triangular R with R'R = gram (+ shift). The shift is of the size of the rounding in a
    Gram matrix of so many rows; None if the matrix is not positive without it."""
    d = len(gram)
    if shift:
        unit = np.finfo(float).eps / 2
        gram = gram + np.eye(d) * 11 * d * (d + 1 + np.log2(rows + 1)) * unit * max(np.trace(gram), np.finfo(float).tiny)
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        return None


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all rows of ``rows`` (column ``x``, arrays of one length); None if there is none.

    The covariance has divisor n. Signs of eigenvectors: the entry of largest size is positive."""
    moments = _summed(rows, _moments, "decimal(38,0)")
    if moments is None:
        return None
    sums, n = moments[:, 0], moments[0, 1]
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        q = _centred(x, n, sums)
        for r in factors:
            q = back_solve(q, r)
        return q.T @ q

    trace = 0.0
    for k in range(PASSES):
        g = _summed(rows, gram)
        if k == 0:
            trace = float(np.trace(g)) / n
            if not trace:
                return Whitening(n, sums, np.zeros((len(g), 0)), np.zeros(0), 0.0)
        elif np.abs(g - np.eye(len(g))).max() < ORTHOGONAL * len(g):
            break
        r = factor(g, n, shift=k == 0)
        factors.append(factor(g, n, shift=True) if r is None else r)
    whole = np.eye(len(g))
    for r in factors:
        whole = r @ whole
    # what is left between Q and orthogonal rows: all of a direction without data, else rounding
    if len(factors) == PASSES:
        g = _summed(rows, gram)
    size, turn = np.linalg.eigh(g)
    whole = np.sqrt(np.maximum(size, 0))[:, None] * (turn.T @ whole)
    _, s, vt = np.linalg.svd(whole)
    real = s > RANK * s[0]
    axes = vt[real].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Whitening(n, sums, axes, s[real] ** 2 / n, trace)


def identity_error(rows: DataFrame, w: Whitening, k: int) -> float:
    """Largest absolute entry of (covariance of the whitened rows - identity), over all rows."""
    def moments(x: np.ndarray) -> np.ndarray:
        y = w.apply(x, k)
        return np.vstack([y.T @ y, y.sum(0)])

    m = _summed(rows, moments)
    mean = m[k] / w.n
    return float(np.abs(m[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def one_length(rows: DataFrame) -> DataFrame:
    """``rows`` of the most frequent length of ``x`` (of two the smaller); others have no place in the space."""
    often = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("x") == (often["d"] if often else 0))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row for each row
    of ``rows`` (``vec_id``, ``x``; see ``integer_rows``) and component, by falling variance.

    ``deviation`` is the exact sum of (n * x - S)**2, ``whitened`` the centred row on the component over
    its standard deviation, ``explained`` the component's share of all variance. There are as many
    components as directions with variance, at most ``components``: none if all rows are equal or
    there is but one. A deviation of more than 38 digits is null. Vectors of another length than the most frequent one are left out. Repeated
    rows and ids are rows like others, a null id stays null, an empty table gives an empty one.
    """
    rows = one_length(rows)
    w = fit(rows)
    shape = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
             "identity_error double")
    k = 0 if w is None else min(components, len(w.eigenvalues))
    if not k:
        return rows.sparkSession.createDataFrame([], shape)
    error = identity_error(rows, w, k)
    share = w.eigenvalues[:k] / w.trace

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["x"])
            d = exact_deviations(x, w.n, w.sums)
            if d.dtype != object and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0 ** 62:
                d = d.astype(object)
            yield pd.DataFrame({
                "vec_id": np.repeat(b["vec_id"].astype("Int64").array, k),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "deviation": np.repeat((d * d).sum(1).astype(str).astype(object), k),
                "whitened": w.apply(x, k).ravel(),
                "explained": np.tile(share, len(x))})

    return (rows.mapInPandas(run, "vec_id long, component int, deviation string, whitened double, explained double")
            .select("vec_id", "component", F.lit(w.n).cast("long").alias("n"),
                    F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", "explained",
                    F.lit(error).alias("identity_error")))
