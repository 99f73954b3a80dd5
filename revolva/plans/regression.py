"""Logistic regression by Newton steps, each of them one plain aggregate.

A step needs the gradient and the weighted Gram matrix of the columns: sums that combine
before they are shuffled. One row of sums, of a size that depends on the number of columns
only, comes to the driver, which solves a small linear system. Rows may be of any number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticFit:
    """Weights, the intercept first, and the gradient of the penalised loss at them."""

    weights: tuple[float, ...]
    gradient: tuple[float, ...]
    loss: float
    steps: int


def margin(weights, columns: list[str]) -> str:
    """The linear predictor as SQL; the first weight is the intercept."""
    return " + ".join([_number(weights[0])] + [f"{_number(w)} * {c}" for w, c in zip(weights[1:], columns)])


def probability(weights, columns: list[str]) -> Column:
    return F.expr(f"1 / (1 + exp(-({margin(weights, columns)})))")


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _sums(rows: DataFrame, columns: list[str], label: str, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Gram matrix at ``weights``, without the penalty."""
    terms = ["1", *columns]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i + 1)]
    placed = rows.selectExpr(*columns, f"CAST({label} AS DOUBLE) AS _y", f"{margin(weights, columns)} AS _m").selectExpr(
        "*", "1 / (1 + exp(-_m)) AS _p"
    )
    # log(1 + exp(m)) - y m, without overflow.
    loss = "sum(greatest(_m, 0) + log1p(exp(-abs(_m))) - _y * _m) AS loss"
    slopes = [f"sum((_p - _y) * {c}) AS g{i}" for i, c in enumerate(terms)]
    bends = [f"sum(_p * (1 - _p) * {terms[i]} * {terms[j]}) AS h{i}_{j}" for i, j in pairs]
    row = placed.agg(*[F.expr(x) for x in (loss, *slopes, *bends)]).first()
    gram = np.zeros((len(terms), len(terms)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"h{i}_{j}"]
    return row["loss"], np.array([row[f"g{i}"] for i in range(len(terms))]), gram


def newton(
    rows: DataFrame, columns: list[str], label: str, penalty: float = 1.0, tolerance: float = 1e-10, most: int = 100
) -> LogisticFit:
    """Minimise the summed log loss plus half of ``penalty`` times the squared weights.

    The intercept is not penalised. ``rows`` is read once per step, so it should be stored.
    A step that does not lower the loss is halved. Labels are 0 or 1, and both must occur;
    nulls are an error.
    """
    check = rows.agg(
        F.min(label).alias("low"), F.max(label).alias("high"), F.count_if(F.concat(*[F.col(c).cast("string") for c in columns]).isNull()).alias("nulls")
    ).first()
    if (check.low, check.high) != (0, 1) or check.nulls:
        raise ValueError("a fit needs rows of both classes and no nulls")
    shrink = np.array([0.0] + [penalty] * len(columns))
    weights = np.zeros(len(columns) + 1)

    def at(w):
        loss, gradient, gram = _sums(rows, columns, label, w)
        return loss + (shrink * w * w).sum() / 2, gradient + shrink * w, gram + np.diag(shrink)

    loss, gradient, gram = at(weights)
    for step in range(1, most + 1):
        move = -np.linalg.solve(gram, gradient)
        while True:
            tried = at(weights + move)
            small = np.abs(move).max() <= tolerance * max(1.0, np.abs(weights).max())
            if tried[0] <= loss or small:
                break
            move = move / 2
        weights = weights + move
        loss, gradient, gram = tried
        if small:
            return LogisticFit(tuple(weights.tolist()), tuple(gradient.tolist()), float(loss), step)
    raise ValueError(f"no convergence in {most} steps")
