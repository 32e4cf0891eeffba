"""What each feature contributes to a boosted tree model's score of a row: exact Shapley values over tree paths.

A tree's value for a set of known features follows the row's way at splits on these and goes both ways, weighted by how many
training rows went there, at the others. So a leaf counts with a product over the features on its path: for a known one
whether the row meets all its splits there, for an unknown one the share of rows that did. The Shapley weights of all
subsets follow from the coefficients of a product of such terms, which is carried along the path for all rows of a
batch at once (Lundberg and others 2020; Yang 2022). The trees are broadcast: their size is the model's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Tree:
    """Nodes from the root; of an inner node the feature, the threshold (at most: left) and both ways, of a leaf the value."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    weight: float = 1.0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to."""
        feature, threshold, left, right = (np.array(c) for c in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(len(self.feature)):
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
        return at

    def paths(self, cover: Sequence[float]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
        """Of each leaf the value and, by feature, the interval it lets through and the share of rows that came through."""
        out, todo = [], [(0, {})]
        while todo:
            node, met = todo.pop()
            f = self.feature[node]
            if f < 0:
                out.append((self.value[node] * self.weight, met))
                continue
            low, high, share = met.get(f, (-np.inf, np.inf, 1.0))
            part = lambda child: share * (cover[child] / cover[node] if cover[node] else 0.0)  # noqa: B023, E731
            todo.append((self.left[node], met | {f: (low, min(high, self.threshold[node]), part(self.left[node]))}))
            todo.append((self.right[node], met | {f: (max(low, self.threshold[node]), high, part(self.right[node]))}))
        return out


def trees_of(model) -> list[Tree]:
    """The trees of a Spark tree ensemble; splits on categories are an error."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        made = Tree([], [], [], [], [], float(weight))
        todo = [(tree._call_java("rootNode"), None)]
        while todo:
            node, link = todo.pop()
            number = len(made.feature)
            if link is not None:
                link[0][link[1]] = number
            inner = node.getClass().getSimpleName() == "InternalNode"
            if inner and node.split().getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("contributions are made for splits on numbers")
            made.feature.append(node.split().featureIndex() if inner else -1)
            made.threshold.append(node.split().threshold() if inner else 0.0)
            made.value.append(node.prediction())
            made.left.append(-1)
            made.right.append(-1)
            if inner:
                todo += [(node.leftChild(), (made.left, number)), (node.rightChild(), (made.right, number))]
        out.append(made)
    return out


def _columns(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)], axis=1) if n else np.empty((batch.num_rows, 0))


def covers(rows: DataFrame, trees: list[Tree], features: Sequence[str]) -> list[list[float]]:
    """How many rows come to each node of each tree; tasks count leaves, and only the counts are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(t.feature), dtype=np.int64) for t in trees]
        for batch in batches:
            x = _columns(batch, len(features))
            for c, t in zip(counts, trees, strict=True):
                c += np.bincount(t.leaves(x), minlength=len(c))
        at = [(i, int(j), int(c[j])) for i, c in enumerate(counts) for j in np.flatnonzero(c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in at], pa.int64()) for k in range(3)], names=["tree", "leaf", "n"])

    numbers = rows.select(*[F.col(c).cast("double") for c in features])
    out = [[0.0] * len(t.feature) for t in trees]
    for r in numbers.mapInArrow(run, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        out[r["tree"]][r["leaf"]] = float(r["n"])
    for t, c in zip(trees, out, strict=True):
        for node in reversed(range(len(c))):  # parents stand before their children
            if t.feature[node] >= 0:
                c[node] = c[t.left[node]] + c[t.right[node]]
    return out


def shapley(x: np.ndarray, paths: list[tuple[float, dict[int, tuple[float, float, float]]]]) -> tuple[np.ndarray, float]:
    """Contributions of each feature to each row, and the value without any feature known."""
    out, base = np.zeros(x.shape), 0.0
    for value, met in paths:
        m, shares = len(met), np.array([s for _, _, s in met.values()])
        base += value * float(np.prod(shares))
        if not m:
            continue
        passes = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, (low, high, _) in met.items()]).astype(float)
        weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        for i, f in enumerate(met):
            terms = np.zeros((m, len(x)))  # by how many of the other features are known
            terms[0] = 1.0
            for j in range(m):
                if j != i:
                    known = terms[:-1] * passes[j]
                    terms *= shares[j]
                    terms[1:] += known
            out[:, f] += value * (passes[i] - shares[i]) * (weights @ terms)
    return out, base


def contributions(df: DataFrame, model, training: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` with ``base_value``, one contribution a feature (``c_`` and its name), and their sum ``raw``.

    ``raw`` is what the trees sum up to, in the model's own units and not a probability. ``training`` gives the nodes' weights.
    Nulls in features are taken as not a number, which goes right at every split.
    """
    trees = trees_of(model)
    paths = [p for t, c in zip(trees, covers(training, trees, features), strict=True) for p in t.paths(c)]
    shared = df.sparkSession.sparkContext.broadcast(paths)
    names = [f"c_{f}" for f in features]
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(c, T.DoubleType()) for c in ["base_value", *names, "raw"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch, len(features))
            x = np.where(np.isnan(x), np.inf, x)  # compared with any threshold neither is at most it
            own, base = shapley(x, shared.value)
            arrays = [*batch.columns[len(features) :], pa.array(np.full(len(x), base)), *(pa.array(own[:, i]) for i in range(len(names))), pa.array(base + own.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)], *keep).mapInArrow(run, schema)
