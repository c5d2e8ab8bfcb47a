"""Scores of decision trees: as one column expression, or vectorised over arrays for large forests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How a split treats what is missing, and what counts as zero.
MISSING_NONE, MISSING_ZERO, MISSING_NAN = 0, 1, 2
ZERO = 1e-35


@dataclass(frozen=True)
class Node:
    """A split on ``feature`` (-1: a leaf with ``value``); children are places in the tree's list."""

    feature: int
    threshold: float = 0.0
    default_left: bool = True
    missing: int = MISSING_NONE
    left: int = -1
    right: int = -1
    value: float = 0.0


Tree = list[Node]


def check(trees: list[Tree], n_features: int) -> None:
    for t in trees:
        for i, n in enumerate(t):
            if n.feature >= n_features or (n.feature >= 0 and not (i < n.left < len(t) and i < n.right < len(t))):
                raise ValueError(f"bad node {i}: {n}")


def expression(trees: list[Tree], features: list[Column]) -> Column:
    """Sum of the trees as nested conditions, which Catalyst compiles; for forests of some hundred nodes."""

    def at(tree: Tree, i: int) -> Column:
        n = tree[i]
        if n.feature < 0:
            return F.lit(float(n.value))
        x = features[n.feature].cast("double")
        nan = F.isnan(x)
        v = x if n.missing == MISSING_NAN else F.when(nan, 0.0).otherwise(x)
        left, right = at(tree, n.left), at(tree, n.right)
        fallback = left if n.default_left else right
        plain = F.when(v <= n.threshold, left).otherwise(right)
        if n.missing == MISSING_NONE:
            return plain
        # the missing branch comes first: to Spark, NaN is larger than any number
        return F.when(F.abs(v) <= ZERO if n.missing == MISSING_ZERO else nan, fallback).otherwise(plain)

    check(trees, len(features))
    out = F.lit(0.0)
    for t in trees:
        out = out + at(t, 0)
    return out


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Sum of the trees for every row of ``x``; all rows walk down a level at a time."""
    check(trees, x.shape[1])
    out = np.zeros(len(x))
    for t in trees:
        feature, left, right = (np.array([getattr(n, k) for n in t]) for k in ("feature", "left", "right"))
        threshold, value = (np.array([getattr(n, k) for n in t], float) for k in ("threshold", "value"))
        default, missing = np.array([n.default_left for n in t]), np.array([n.missing for n in t])
        at = np.zeros(len(x), int)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            node = at[live]
            v = x[live, feature[node]].astype(float)
            nan = np.isnan(v)
            v = np.where(nan & (missing[node] != MISSING_NAN), 0.0, v)
            lost = ((missing[node] == MISSING_ZERO) & (np.abs(v) <= ZERO)) | ((missing[node] == MISSING_NAN) & nan)
            go_left = np.where(lost, default[node], v <= threshold[node])
            at[live] = np.where(go_left, left[node], right[node])
            live = live[feature[at[live]] >= 0]
        out += value[at]
    return out


def scorer(trees: list[Tree]):
    """Arrow UDF over an array<double> column."""
    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(predict(trees, np.stack(features.to_numpy())) if len(features) else [], dtype=float)

    return score
