"""Ridge regression from a tall-skinny QR: R factors per task, merged along a tree.

A Gram matrix squares the condition number of the terms, so with 251 correlated
degree-5 terms half of the digits are gone before the solve. Here each task
keeps, per fold, the triangular Householder factor R of its rows [1, terms, y]:
it stacks R on the next rows and factors again. R holds (d + 2)^2 numbers
whatever the number of rows. Factors of one fold are stacked and factored in
groups of ``FAN_IN`` per Spark job until one is left, so no task holds more than
``FAN_IN`` of them and the driver gets one per fold.

Because the first column is the constant, the rest of R without its first row is
the factor of the centred columns. One singular value decomposition of it,
standardised, gives the solution for every penalty.
"""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.session import drop_scratch, scratch_path

FAN_IN = 8
_ROWS = 2048
_FACTOR = "fold int, part long, factor binary"


@cache
def one_thread() -> bool:
    """Let this process's OpenBLAS compute on its caller's thread; False if numpy has no such library.

    A task has one core. The threads of several tasks would only wait for each other, at many times the CPU time.
    """
    done = False
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_",
                     "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
                break
    return done


def stacked_factor(parts: list[np.ndarray]) -> np.ndarray:
    """R of the rows of all parts, square whatever their number."""
    a = np.concatenate(parts)
    if len(a) < a.shape[1]:
        a = np.concatenate((a, np.zeros((a.shape[1] - len(a), a.shape[1]))))
    return np.linalg.qr(a, mode="r")


def _packed(r: np.ndarray) -> bytes:
    """The upper triangle."""
    return r[np.triu_indices(len(r))].astype("<f8").tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    r = np.zeros((width, width))
    r[np.triu_indices(width)] = np.frombuffer(data, "<f8")
    return r


def task_factors(rows: DataFrame, design: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """fold, part and factor: one R per task and fold of the rows ``design`` makes of a batch (with column fold)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        one_thread()
        held: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            folds = pdf["fold"].to_numpy()
            for a in range(0, len(pdf), _ROWS):
                part, mine = design(pdf.iloc[a:a + _ROWS]), folds[a:a + _ROWS]
                for f in np.unique(mine):
                    parts = held.setdefault(int(f), [])
                    parts.append(part[mine == f])
                    if sum(map(len, parts)) > _ROWS + part.shape[1]:
                        held[int(f)] = [stacked_factor(parts)]
        at = TaskContext.get().partitionId()
        for f, parts in held.items():
            yield pd.DataFrame({"fold": [f], "part": [at], "factor": [_packed(stacked_factor(parts))]})
    return rows.mapInPandas(run, _FACTOR)


def merged_factors(factors: DataFrame, width: int) -> dict[int, np.ndarray]:
    """{fold: R over all of its rows}, merged ``FAN_IN`` at a time; each level is a written table."""
    spark, base, level = factors.sparkSession, scratch_path(factors.sparkSession, "factors"), 0

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        pdf = pdf.sort_values("part")
        r = stacked_factor([_unpacked(x, width) for x in pdf["factor"]])
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "factor": [_packed(r)]})
    while True:
        factors.write.parquet(f"{base}/{level}")
        factors = spark.read.schema(_FACTOR).parquet(f"{base}/{level}")
        if (factors.agg(F.max("part")).first()[0] or 0) == 0:
            break
        factors = factors.groupBy("fold", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, _FACTOR)
        level += 1
    found = {r["fold"]: _unpacked(r["factor"], width) for r in factors.collect()}  # one row per fold
    drop_scratch(spark, base)
    return found


class Ridge:
    """All ridge solutions over the rows of one factor of [1, terms, y]."""

    def __init__(self, r: np.ndarray):
        self.n = r[0, 0] ** 2
        d = len(r) - 2
        self.mean, self.y_mean = r[0, 1:d + 1] / r[0, 0], r[0, d + 1] / r[0, 0]
        centred, y = r[1:, 1:d + 1], r[1:, d + 1]
        self.sigma = np.linalg.norm(centred, axis=0) / np.sqrt(self.n)
        # a constant term is inert; terms are scaled to values of at most about 1
        self.flat = self.sigma <= 1e-12
        scaled = np.where(self.flat, 0.0, centred / np.where(self.flat, 1.0, self.sigma))
        u, self.s, self.vt = np.linalg.svd(scaled, full_matrices=False)
        self.uy = u.T @ y

    def solve(self, alpha: float) -> tuple[float, np.ndarray]:
        """(intercept, slopes) with the penalty on terms standardised over these rows."""
        live = self.s > 1e-13 * self.s.max(initial=0.0)
        share = np.where(live, self.s / np.where(live, self.s ** 2 + alpha, 1.0), 0.0)
        w = self.vt.T @ (share * self.uy)
        beta = np.where(self.flat, 0.0, w / np.where(self.flat, 1.0, self.sigma))
        return float(self.y_mean - beta @ self.mean), beta


def squared_error(r: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """Sum of squared residuals over the rows of the factor."""
    return float(np.sum((r @ np.concatenate(([intercept], beta, [-1.0]))) ** 2))
