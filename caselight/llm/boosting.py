"""Small gradient-boosted trees, fitted on a bounded sample in the driver and applied as a native column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, bins: int = 32) -> dict:
    leaf = {"value": float(grad.sum() / (hess.sum() + 1.0))}
    if depth == 0 or len(x) < 20:
        return leaf
    best, best_gain = None, 1e-6
    base = grad.sum() ** 2 / (hess.sum() + 1.0)
    for j in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])):
            left = x[:, j] <= cut
            if left.all() or not left.any():
                continue
            gain = grad[left].sum() ** 2 / (hess[left].sum() + 1.0) + grad[~left].sum() ** 2 / (hess[~left].sum() + 1.0) - base
            if gain > best_gain:
                best, best_gain = (j, float(cut), left), gain
    if best is None:
        return leaf
    j, cut, left = best
    return {"feature": j, "cut": cut, "left": _tree(x[left], grad[left], hess[left], depth - 1), "right": _tree(x[~left], grad[~left], hess[~left], depth - 1)}


def _score(tree: dict, x: np.ndarray) -> np.ndarray:
    if "value" in tree:
        return np.full(len(x), tree["value"])
    left = x[:, tree["feature"]] <= tree["cut"]
    out = np.empty(len(x))
    out[left], out[~left] = _score(tree["left"], x[left]), _score(tree["right"], x[~left])
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4) -> dict:
    """Logistic boosting. With one class only (or no rows) the model is a constant."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = {"base": float(np.log(share / (1 - share))), "rate": rate, "trees": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    margin = np.full(len(y), model["base"])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(x, y - p, p * (1 - p), depth)
        model["trees"].append(tree)
        margin += rate * _score(tree, x)
    return model


def score_row(model: dict, x: list[float]) -> float:
    """The log-odds of one row."""
    out = model["base"]
    for tree in model["trees"]:
        while "value" not in tree:
            tree = tree["left"] if x[tree["feature"]] <= tree["cut"] else tree["right"]
        out += tree["value"] * model["rate"]
    return out


def margin_column(model: dict, features: list[Column]) -> Column:
    """The log-odds of ``model`` as one expression."""

    def of(tree: dict) -> Column:
        if "value" in tree:
            return F.lit(round(tree["value"] * model["rate"], 9))
        return F.when(features[tree["feature"]] <= tree["cut"], of(tree["left"])).otherwise(of(tree["right"]))

    out = F.lit(model["base"])
    for tree in model["trees"]:
        out = out + of(tree)
    return out
