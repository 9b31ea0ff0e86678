"""Exact additive contributions of features to a tree model's output (Shapley values along paths).

A leaf is reached by the features on its path: each row either takes the leaf's interval of
a feature or not, and where the feature is unknown, a share of the training rows takes it.
Over all orders in which features become known, a leaf gives its value times the difference
that a feature makes; with m features on the path that is a polynomial of m - 1 factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pandas as pd


@dataclass
class Leaf:
    value: float
    reach: float
    #: feature -> (low, high, share): values in (low, high] come here, of unknown ones that share
    path: dict[int, tuple[float, float, float]]
    #: features of the path whose missing values come here
    missing: frozenset[int] = frozenset()


def leaves_of(node, leaf_value) -> list[Leaf]:
    """Leaves below a JVM tree node; leaf_value(node) is a leaf's output."""
    out, todo = [], [(node, 1.0, {})]
    while todo:
        node, reach, path = todo.pop()
        if node.subtreeDepth() == 0:
            out.append(Leaf(float(leaf_value(node)), reach, path))
            continue
        f, cut, n = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
        low, high, share = path.get(f, (-inf, inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, cut))), (node.rightChild(), (max(low, cut), high))):
            part = child.impurityStats().count() / n if n else 0.5
            todo.append((child, reach * part, path | {f: (*bounds, share * part)}))
    return out


def trees_of(model, task: str) -> list[tuple[float, list[Leaf]]]:
    """(scale, leaves) of a fitted Spark tree, forest or boosted model; boosting classifies by log odds."""
    java = model._java_obj
    kind = type(model).__name__
    chance = lambda node: node.impurityStats().prob(1.0)
    number = lambda node: node.prediction()
    if kind.startswith("DecisionTree"):
        return [(1.0, leaves_of(java.rootNode(), chance if task == "classification" else number))]
    trees, weights = list(java.trees()), list(java.treeWeights())
    if kind.startswith("GBT"):
        return [(w * (2.0 if task == "classification" else 1.0), leaves_of(t.rootNode(), number)) for t, w in zip(trees, weights, strict=True)]
    return [(1.0 / len(trees), leaves_of(t.rootNode(), chance if task == "classification" else number)) for t in trees]


def contributions(x: np.ndarray, trees: list[tuple[float, list[Leaf]]]) -> tuple[np.ndarray, float]:
    """What each feature adds to the mean output for each row, and that mean."""
    out, base = np.zeros(x.shape), 0.0
    for scale, leaves in trees:
        for leaf in leaves:
            base += scale * leaf.value * leaf.reach
            m = len(leaf.path)
            takes = {f: np.where(np.isnan(x[:, f]), f in leaf.missing, (x[:, f] > a) & (x[:, f] <= b)).astype(np.float64) for f, (a, b, _) in leaf.path.items()}
            for f, (_, _, share) in leaf.path.items():
                # sums over subsets of the other features by the number that is known
                known = [np.ones(len(x))]
                for g, (_, _, other) in leaf.path.items():
                    if g != f:
                        known = [(known[k] * other if k < len(known) else 0.0) + (known[k - 1] * takes[g] if k else 0.0) for k in range(len(known) + 1)]
                weight = sum(c * (factorial(k) * factorial(m - 1 - k) / factorial(m)) for k, c in enumerate(known))
                out[:, f] += scale * leaf.value * (takes[f] - share) * weight
    return out, base


def in_batches(trees: list[tuple[float, list[Leaf]]], names: list[str]):
    """The function that mapInPandas applies to rows of the features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(contributions(batch[names].to_numpy(np.float64), trees)[0], columns=names)

    return run
