"""Polynomial ridge price model: split, features, grid search, fit, evaluate.

Semantics: polynomial terms of the inputs (all monomials up to ``degree``),
each term standardised with the population mean / sigma of the training rows,
ridge regression with a fitted intercept, alpha chosen by 5-fold
cross-validated mean squared error (first best on ties), refit on all training
rows.

Execution: one distributed pass computes, per fold, the triangular QR factor of
[1, terms, price] (``tsqr``; d = 251 terms for 5 inputs at degree 5), merged
along a tree, so the driver receives one (d + 2)-wide factor per fold - a size
fixed by d, not by the data. A fold's training complement is the factor of the
other folds' factors; one decomposition of it gives the fits for all penalties.
Terms are shifted and divided by their values at the inputs' means and maxima,
from one row of aggregates. No Gram matrix is formed, so the condition number is not squared.

Rows are assigned to the test split and to folds by a hash of ``house_id``
(stable in any engine), not by a random seed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.operators import tsqr

# The candidate penalties, folds and input names of the model.
ALPHAS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
N_FOLDS = 5
TEST_CUT = 51          # first md5 byte < 51 -> test (about 20 %)
Y_SCALE = 1e9          # prices handled in billions inside the solver
INPUTS = ["area", "bedrooms", "bathrooms", "floors", "width_meters"]


def _md5_byte(c: Column, pos: int) -> Column:
    return F.conv(F.substring(F.md5(c), pos, 2), 16, 10).cast("int")


def with_split(df: DataFrame, key: str = "house_id") -> DataFrame:
    """Add ``is_test`` (about 20 %) and ``fold`` (0..4) from a hash of the key."""
    return df.withColumn("is_test", _md5_byte(F.col(key), 1) < TEST_CUT) \
        .withColumn("fold", _md5_byte(F.col(key), 3) % N_FOLDS)


def term_order(n_inputs: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of the terms in ``PolynomialExpansion`` output order.

    Terms are grouped by the power of the last input (0, 1, ...); inside a
    group come the terms of the other inputs with the remaining degree
    (constant first), each times that power. For (x, y) at degree 2 this is
    x, x^2, y, xy, y^2. ``tests/test_model.py`` checks the rule against
    Spark's expansion of distinct primes.
    """
    def with_const(n: int, d: int) -> list[tuple[int, ...]]:
        if n == 0:
            return [()]
        out = []
        for p in range(d + 1):
            out += [t + (p,) for t in with_const(n - 1, d - p)]
        return out
    return [t for t in with_const(n_inputs, degree) if any(t)]


def poly_exponents(spark: SparkSession, n_inputs: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents found by expanding distinct primes with Spark and factorising."""
    primes = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29][:n_inputs]
    df = spark.createDataFrame([tuple(float(p) for p in primes)], [f"x{i}" for i in range(n_inputs)])
    vec = VectorAssembler(inputCols=df.columns, outputCol="v").transform(df)
    out = PolynomialExpansion(degree=degree, inputCol="v", outputCol="p").transform(vec)
    values = out.select("p").first()["p"].toArray()
    exps = []
    for v in values:
        n = int(round(v))
        e = []
        for p in primes:
            k = 0
            while n % p == 0:
                n //= p
                k += 1
            e.append(k)
        exps.append(tuple(e))
    return exps


def term_names(inputs: list[str], exps: list[tuple[int, ...]]) -> list[str]:
    names = []
    for e in exps:
        parts = [name if k == 1 else f"{name}^{k}" for name, k in zip(inputs, e) if k]
        names.append(" ".join(parts))
    return names


def poly_column(df: DataFrame, inputs: list[str], degree: int, out: str = "poly") -> DataFrame:
    """Polynomial terms as a vector column (JVM-side ``PolynomialExpansion``).

    Rows with a null or NaN input are kept; their terms are NaN.
    """
    vec = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="keep").transform(df)
    if degree == 1:
        return vec.withColumnRenamed("_x", out)
    return PolynomialExpansion(degree=degree, inputCol="_x", outputCol=out).transform(vec).drop("_x")


@dataclass
class RidgeModel:
    inputs: list[str]
    degree: int
    exponents: list[list[int]]
    alpha: float
    center: list[float]       # global pre-scaling of each term
    scale: list[float]
    beta0: float              # intercept and slopes on pre-scaled terms (price in billions)
    beta: list[float]
    term_sigma: list[float] = field(default_factory=list)  # population sigma of each raw term
    cv: list[dict] = field(default_factory=list)

    # ---- prediction: one matrix product per Arrow batch ----
    def predict_column(self) -> Column:
        """price (VND) = beta0 + sum(beta_j * (z_j - c_j) / s_j), times 1e9; null if an input is null or NaN."""
        exps = np.array(self.exponents, dtype=np.int64).reshape(len(self.beta), len(self.inputs))
        center, scale, beta, beta0 = np.array(self.center), np.array(self.scale), np.array(self.beta), self.beta0

        @F.pandas_udf("double")
        def predict(*inputs: pd.Series) -> pd.Series:
            x = np.stack([i.to_numpy(dtype=np.float64) for i in inputs], axis=1)
            y = (beta0 + (terms(x, exps) - center) / scale @ beta) * Y_SCALE
            return pd.Series(y).where(~np.isnan(x).any(axis=1))
        return predict(*[F.col(c).cast("double") for c in self.inputs])

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; every row is kept."""
        return df.withColumn(out, self.predict_column())

    def coefficients(self) -> list[float]:
        """Slopes on the raw terms (billions per unit)."""
        return [b / s for b, s in zip(self.beta, self.scale)]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string") \
            .coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RidgeModel":
        return RidgeModel(**json.loads(spark.read.json(path).first()["model"]))


def terms(x: np.ndarray, exps: np.ndarray) -> np.ndarray:
    """All monomials of the rows of ``x``: one column per row of exponents."""
    z = np.ones((len(exps), len(x)))  # a term's values lie side by side
    for i in range(x.shape[1]):
        powers = exps[:, i]
        for k in range(1, int(powers.max(initial=0)) + 1):
            z[powers >= k] *= x[:, i]
    return z.T


def fold_factors(train: DataFrame, inputs: list[str], exps: list[tuple[int, ...]], shift: np.ndarray, scale: np.ndarray,
                 y_mean: float, target: str = "price") -> dict[int, np.ndarray]:
    """One distributed pass: {fold: R factor of [1, (z - shift) / scale, y - y_mean] over that fold's rows}."""
    powers, n_inputs = np.array(exps, dtype=np.int64).reshape(len(exps), len(inputs)), len(inputs)

    def design(pdf: pd.DataFrame) -> np.ndarray:
        a = np.ones((len(pdf), len(powers) + 2))
        a[:, 1:-1] = (terms(pdf.iloc[:, :n_inputs].to_numpy(dtype=np.float64), powers) - shift) / scale
        a[:, -1] = pdf["y"].to_numpy(dtype=np.float64) / Y_SCALE - y_mean
        return a
    rows = train.select(*[F.col(c).cast("double") for c in inputs],
                        F.col(target).cast("double").alias("y"), F.col("fold").cast("int"))
    return tsqr.merged_factors(tsqr.task_factors(rows, design), len(exps) + 2)


def grid_search(factors: dict[int, np.ndarray], alphas=ALPHAS) -> tuple[float, list[dict]]:
    """Mean error of each penalty over the folds, each fitted on the other folds' factors."""
    mses: dict[float, list[float]] = {a: [] for a in alphas}
    for f in sorted(factors):
        others = [r for g, r in sorted(factors.items()) if g != f]
        if not others:
            raise ValueError("cross-validation needs rows in two folds at least")
        ridge = tsqr.Ridge(tsqr.stacked_factor(others))
        for a in alphas:
            mses[a].append(tsqr.squared_error(factors[f], *ridge.solve(a)) / factors[f][0, 0] ** 2)
    rows = [{"alpha": a, "mean_mse": float(np.mean(mses[a])), "fold_mse": mses[a]} for a in alphas]
    best = min(range(len(rows)), key=lambda i: (rows[i]["mean_mse"], i))
    for i, r in enumerate(rows):
        r["chosen"] = i == best
    return rows[best]["alpha"], rows


def term_shift(train: DataFrame, inputs: list[str], exps: list[tuple[int, ...]], target: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(center, scale, mean target): each term at the inputs' means and at their largest absolute values.

    Both only keep the factors' numbers small; one row reaches the driver.
    """
    row = train.agg(*[F.avg(F.col(c).cast("double")) for c in inputs], *[F.max(F.abs(F.col(c).cast("double"))) for c in inputs],
                    F.avg(F.col(target).cast("double"))).first()
    mean, top = np.array([v or 0.0 for v in row[:len(inputs)]]), np.array([v or 1.0 for v in row[len(inputs):-1]])
    powers = np.array(exps, dtype=np.float64).reshape(len(exps), len(inputs))
    return np.prod(mean[None, :] ** powers, axis=1), np.prod(top[None, :] ** powers, axis=1), (row[-1] or 0.0) / Y_SCALE


def fit(train: DataFrame, inputs: list[str] = INPUTS, degree: int = 5, alphas=ALPHAS,
        target: str = "price", alpha: float | None = None) -> RidgeModel:
    """Grid-search alpha by 5-fold CV (unless ``alpha`` is given), refit on all rows.

    ``train`` has the inputs, ``target`` (VND) and ``fold``; rows with null
    inputs are dropped first.
    """
    cond = F.col(target).isNotNull()
    for c in inputs:
        cond = cond & F.col(c).isNotNull()
    exps = term_order(len(inputs), degree) if degree > 1 else \
        [tuple(1 if j == i else 0 for j in range(len(inputs))) for i in range(len(inputs))]
    train = train.filter(cond)
    shift, scale, y_mean = term_shift(train, inputs, exps, target)
    factors = fold_factors(train, inputs, exps, shift, scale, y_mean, target)
    if not factors:
        raise ValueError("no row has all inputs and a price")
    alpha, cv = grid_search(factors, alphas) if alpha is None else (alpha, [])
    ridge = tsqr.Ridge(tsqr.stacked_factor([factors[f] for f in sorted(factors)]))
    _, b = ridge.solve(alpha)
    # predictions start from the mean price: a term near its mean adds little, and little rounding
    b0, center, sig = y_mean + ridge.y_mean, shift + ridge.mean * scale, ridge.sigma * scale
    return RidgeModel(inputs=list(inputs), degree=degree, exponents=[list(e) for e in exps],
                      alpha=float(alpha), center=[float(v) for v in center],
                      scale=[float(v) for v in scale], beta0=float(b0), beta=[float(v) for v in b],
                      term_sigma=[float(v) for v in sig], cv=cv)


def evaluate(pred: DataFrame, label: str = "price", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, R^2 and MAPE (%) in one aggregation; prices in billions.

    MAPE skips zero prices (it would be infinite) and reports how many.
    """
    y = F.col(label) / F.lit(1e9)
    yhat = F.col(prediction) / F.lit(1e9)
    err = y - yhat
    agg = pred.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(err * err).alias("mse"),
        F.var_pop(y).alias("_var"),
        F.avg(F.when(y != 0, F.abs(err / y))).alias("_mape"),
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("n_zero_price_skipped"))
    return agg.select(
        "n_test", "mse", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - F.col("mse") / F.col("_var")).alias("r2"),
        (F.col("_mape") * 100).alias("mape_pct"),
        F.col("n_zero_price_skipped").cast("bigint").alias("n_zero_price_skipped"))
