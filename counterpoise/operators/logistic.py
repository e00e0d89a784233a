"""Logistic regression of many training sets at a time by grouped Newton steps.

Sets are laid out as in :mod:`counterpoise.operators.boosting`. The loss of a set
is the ridge of half the squared coefficients, the intercept's included, plus its
rows' logistic losses with classes weighted to equal mass. A step is one job for
all sets that still move: loss, gradient and Hessian are sums over rows, added up
in the tasks and then by (set, place); each set's equations are solved where its
sums meet, and only the step of each set comes back. A step that does not lower
the loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.operators.boosting import SCORED, counted, matrix

STEPS = 200
TOLERANCE = 1e-9
SLICE = 16_384
Set = tuple[int, int]


def class_weights(n: int, positive: int) -> tuple[float, float]:
    """Weights of the two classes that give each half of the rows' mass."""
    return n / (2.0 * max(n - positive, 1)), n / (2.0 * max(positive, 1))


def newton_sums(rows: DataFrame, coefficients: dict[Set, np.ndarray], weights: dict[Set, tuple[float, float]]) -> DataFrame:
    """(v, f, i, value): each set's summed loss (i = 0), gradient, and Hessian above and on its diagonal, row by row.

    The last coefficient is the intercept. The ridge is not part of the sums.
    """
    sent = rows.sparkSession.sparkContext.broadcast((coefficients, weights))
    names = ["v", "f", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, weights = sent.value
        held: dict[Set, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                v, part, label, many = (batch.column(c).to_numpy() for c in ("v", "part", "label", "n"))
                x = matrix(batch.column("x"))
                x = np.hstack([x, np.ones((len(x), 1))])
                for (of, f), beta in coefficients.items():
                    at = np.flatnonzero((v == of) & (part >= 0) & (part != f))
                    if len(at) == 0:
                        continue
                    z, y = x[at], label[at]
                    c = np.where(y > 0, weights[of, f][1], weights[of, f][0]) * many[at]
                    s = z @ beta
                    p = 1 / (1 + np.exp(-s))
                    loss = np.dot(c, np.logaddexp(0, np.where(y > 0, -s, s)))
                    hessian = (z * (c * p * (1 - p))[:, None]).T @ z
                    found = np.concatenate([[loss], z.T @ (c * (p - y)), hessian[np.triu_indices(len(beta))]])
                    held[of, f] = held[of, f] + found if (of, f) in held else found
        sets = list(held)
        arrays = [pa.array([s[0] for s in sets], pa.int64()), pa.array([s[1] for s in sets], pa.int32())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([held[s] for s in sets], pa.list_(pa.float64()))], names)

    cells = counted(rows).mapInArrow(run, "v bigint, f int, values array<double>").select("v", "f", F.posexplode("values").alias("i", "value"))
    return cells.groupBy("v", "f", "i").agg(F.sum("value").alias("value"))


def _steps(sums: DataFrame, coefficients: dict[Set, np.ndarray]) -> dict[Set, tuple[float, np.ndarray]]:
    """Of each set: the whole loss at its coefficients, and the Newton step from there."""
    sent = sums.sparkSession.sparkContext.broadcast(coefficients)

    def solve(table: pa.Table) -> pa.Table:
        v, f = table.column("v")[0].as_py(), table.column("f")[0].as_py()
        values = np.zeros(table.num_rows)
        values[table.column("i").to_numpy()] = table.column("value").to_numpy()
        beta = sent.value[v, f]
        d = len(beta)
        hessian = np.zeros((d, d))
        hessian[np.triu_indices(d)] = values[1 + d :]
        hessian = hessian + np.triu(hessian, 1).T + np.eye(d)
        step = -np.linalg.solve(hessian, values[1 : 1 + d] + beta)
        loss = values[0] + np.dot(beta, beta) / 2
        return pa.table({"v": [v], "f": pa.array([f], pa.int32()), "loss": [float(loss)], "step": [step.tolist()]})

    # a group is as large as the square of the number of features
    found = sums.groupBy("v", "f").applyInArrow(solve, "v bigint, f int, loss double, step array<double>").collect()
    sent.unpersist()
    return {(r["v"], r["f"]): (r["loss"], np.array(r["step"])) for r in found}


@dataclass
class _Walk:
    """Where a set's coefficients stand, and the point tried next."""

    at: np.ndarray
    trial: np.ndarray
    loss: float = np.inf

    def move(self, loss: float, step: np.ndarray) -> bool:
        """Takes the trial point or halves the way to it; whether it has arrived."""
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.trial = (self.at + self.trial) / 2
            return bool(np.abs(self.trial - self.at).max() < TOLERANCE)
        self.at, self.loss = self.trial, loss
        self.trial = self.at + step
        return bool(np.abs(step).max() < TOLERANCE * max(1.0, float(np.abs(self.at).max())))


def fit(rows: DataFrame, sizes: dict[Set, tuple[int, int]], width: int, steps: int = STEPS) -> dict[Set, np.ndarray]:
    """Coefficients of each set, the intercept last; ``sizes`` is (rows, positive rows) fitted to."""
    weights = {s: class_weights(n, positive) for s, (n, positive) in sizes.items()}
    walks = {s: _Walk(np.zeros(width + 1), np.zeros(width + 1)) for s in sizes}
    moving = set(walks)
    for _ in range(steps):
        if not moving:
            break
        trial = {s: walks[s].trial for s in moving}
        found = _steps(newton_sums(rows, trial, {s: weights[s] for s in moving}), trial)
        moving = {s for s in moving if not walks[s].move(*found[s])}
    return {s: walk.at for s, walk in walks.items()}


def scores(rows: DataFrame, coefficients: dict[Set, np.ndarray]) -> DataFrame:
    """(v, f, row, label, score): the log-odds of the rows that each set leaves out."""
    sent = rows.sparkSession.sparkContext.broadcast(coefficients)  # features + 1 numbers a set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, part = batch.column("v").to_numpy(), batch.column("part").to_numpy()
            x = matrix(batch.column("x"))
            score = np.full(len(v), np.nan)
            for (of, f), beta in sent.value.items():
                at = (v == of) & (part == f)
                score[at] = x[at] @ beta[:-1] + beta[-1]
            keep = np.flatnonzero(~np.isnan(score))
            take = pa.array(keep)
            arrays = [batch.column(c).take(take) for c in ("v", "part", "row", "label", "n")]
            yield pa.RecordBatch.from_arrays([*arrays[:4], pa.array(score[keep]), arrays[4]], ["v", "f", "row", "label", "score", "n"])

    return counted(rows).select("v", "part", "row", "label", "n", "x").mapInArrow(run, SCORED)
