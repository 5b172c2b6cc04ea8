"""Cost-complexity pruning of a classification tree.

The weakest link of a tree is the inner node whose subtree lowers the error least per leaf it adds.
Collapsing weakest links one after the other gives a nested sequence of subtrees, each the best for
a range of complexities; cross-validation says what each of them is worth on rows it has not seen.

Spark fits the trees and says which leaf a row falls into. Counts per leaf and label are all that
pruning needs, so one aggregate per tree reaches the driver, no larger than its leaves times labels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators.models import WEIGHT, fit_tree, persisted

#: Two links are equally weak if their costs differ by less than this share of the root's error.
SAME = 1e-9


@dataclass
class Node:
    first: int  # leaves below are numbers first, ..., last - 1, from left to right
    last: int = 0
    below: list[Node] = field(default_factory=list)


def tree_shape(model: DecisionTreeClassificationModel) -> Node:
    """The nodes, from the model's description: a line per split, one per alternative and leaf."""
    lines = [x.strip() for x in model.toDebugString.splitlines()[1:]]
    steps = iter([x for x in lines if x.startswith(("If", "Predict"))])

    def read(first: int) -> Node:
        if next(steps).startswith("Predict"):
            return Node(first, first + 1)
        left = read(first)
        right = read(left.last)
        return Node(first, right.last, [left, right])

    return read(0)


Counts = dict[int, dict[float, float]]


def leaf_counts(
    model: DecisionTreeClassificationModel, df: DataFrame, label: str, weight: str = WEIGHT
) -> Counts:
    """Weight per leaf and label."""
    scored = model.setLeafCol("_leaf").transform(df)
    rows = scored.groupBy("_leaf", label).agg(F.sum(weight).alias("w")).collect()
    out: Counts = {}
    for r in rows:
        out.setdefault(int(r["_leaf"]), {})[r[label]] = r["w"]
    return out


def _label_weights(node: Node, counts: Counts) -> dict[float, float]:
    out: dict[float, float] = {}
    for leaf in range(node.first, node.last):
        for label, w in counts.get(leaf, {}).items():
            out[label] = out.get(label, 0.0) + w
    return out


def _choice(weights: dict[float, float]) -> float | None:
    """The label of most weight, ties to the smaller."""
    return min(weights, key=lambda x: (-weights[x], x)) if weights else None


@dataclass(frozen=True)
class Subtree:
    """One of the sequence: from which complexity on it is the best, and its leaves."""

    complexity: float
    leaves: tuple[tuple[int, int], ...]  # (first, last) of the nodes that are its leaves
    error: float


def pruning_sequence(root: Node, counts: Counts) -> list[Subtree]:
    """From the smallest best tree at complexity 0 to the root alone; complexity is error weight
    per leaf."""
    errors: dict[tuple[int, int], float] = {}

    def own_error(node: Node) -> float:
        key = (node.first, node.last)
        if key not in errors:
            weights = _label_weights(node, counts)
            errors[key] = sum(weights.values()) - max(weights.values(), default=0.0)
        return errors[key]

    cut: set[tuple[int, int]] = set()

    def leaves(node: Node) -> list[Node]:
        if not node.below or (node.first, node.last) in cut:
            return [node]
        return [x for child in node.below for x in leaves(child)]

    def links(node: Node) -> list[tuple[float, Node]]:
        if not node.below or (node.first, node.last) in cut:
            return []
        ends = leaves(node)
        cost = (own_error(node) - sum(map(own_error, ends))) / (len(ends) - 1)
        return [(cost, node), *(x for child in node.below for x in links(child))]

    tolerance = SAME * max(own_error(root), 1e-300)
    out: list[Subtree] = []
    complexity = 0.0
    while True:
        open_links = links(root)
        weakest = min((cost for cost, _ in open_links), default=math.inf)
        if weakest > complexity + tolerance:
            ends = leaves(root)
            error = sum(map(own_error, ends))
            out.append(Subtree(complexity, tuple((x.first, x.last) for x in ends), error))
            if not open_links:
                return out
            complexity = weakest
        cut |= {(node.first, node.last) for cost, node in open_links if cost <= complexity + tolerance}


def held_out_error(subtree: Subtree, learnt: Counts, seen: Counts) -> float:
    """Weight of the rows counted in ``seen`` that the subtree labels wrongly, labels being those of
    most weight in ``learnt``."""
    wrong = 0.0
    for first, last in subtree.leaves:
        node = Node(first, last)
        weights = _label_weights(node, seen)
        wrong += sum(weights.values()) - weights.get(_choice(_label_weights(node, learnt)), 0.0)
    return wrong


def complexity_table(
    df: DataFrame,
    label: str,
    fold: str,
    folds: int,
    depth: int = 10,
    seed: int = 123,
    weight: str = WEIGHT,
) -> DataFrame:
    """(complexity, n_splits, rel_error, cv_error, cv_std), the root alone first: a row per subtree of
    the pruning sequence. Errors and complexity are relative to the error of the root.

    A fold's own sequence is read at the geometric mean of neighbouring complexities. ``fold`` numbers
    the folds (0, 1, ...). Without rows, or with one label, the table has the root only, with errors
    of 0.
    """
    spark = df.sparkSession
    kind = "complexity double, n_splits int, rel_error double, cv_error double, cv_std double"
    if df.isEmpty():
        return spark.createDataFrame([(0.0, 0, 0.0, 0.0, 0.0)], kind)
    with persisted(df) as data:
        model = fit_tree(data, label, depth, seed, weight)
        found = pruning_sequence(tree_shape(model), leaf_counts(model, data, label, weight))
        between = [math.sqrt(a.complexity * b.complexity) for a, b in zip(found[:-1], found[1:], strict=True)]
        between.append(math.inf)
        wrong, total = [0.0] * len(found), 0.0
        for k in range(folds):
            rest, held = data.where(F.col(fold) != k), data.where(F.col(fold) == k)
            if rest.isEmpty() or held.isEmpty():
                continue
            part = fit_tree(rest, label, depth, seed, weight)
            learnt, seen = (leaf_counts(part, x, label, weight) for x in (rest, held))
            sequence = pruning_sequence(tree_shape(part), learnt)
            total += sum(w for labels in seen.values() for w in labels.values())
            for i, complexity in enumerate(between):
                best = [s for s in sequence if s.complexity <= complexity][-1]
                wrong[i] += held_out_error(best, learnt, seen)
    root = found[-1].error or 1.0
    rows = []
    for subtree, w in zip(reversed(found), reversed(wrong), strict=True):
        std = math.sqrt(max(w - w * w / total, 0.0)) if total else 0.0
        rows.append((subtree.complexity / root, len(subtree.leaves) - 1, subtree.error / root, w / root, std / root))
    return spark.createDataFrame(rows, kind)
