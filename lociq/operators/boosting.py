"""Gradient-boosted trees for several classes: second-order boosting over histograms of gradients."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.scratch import stored

_ONE = 1 << 24  # gradients are summed as whole numbers of this fraction, so that the order of the rows does not matter
_KEPT_ROUNDS = 8  # rounds after which margins are written again instead of being added up from trees


@dataclass
class Tree:
    """A tree of fixed depth as arrays: node i has the children 2 i + 1 and 2 i + 2. A row goes right if the bin of ``feature`` is above
    ``cut``; nodes without a split send all rows left. ``leaf`` is the value at each of the lowest nodes, from the left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of every row at that depth."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.cut[at])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[self.place(bins, _depth(self)) - len(self.feature)]


def _depth(tree: Tree) -> int:
    return len(tree.leaf).bit_length() - 1


@dataclass
class Boosted:
    """A fitted model: for each round one tree for each class, over the features' bins between ``edges``."""

    classes: list[str]
    names: list[str]
    edges: list[np.ndarray]
    rounds: list[list[Tree]]

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Of each feature the number of edges below the value; a missing value is in the first bin."""
        return np.stack([np.searchsorted(e, np.nan_to_num(values[:, i], nan=-np.inf), side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds[first:]:
            out += np.stack([t.values(bins) for t in trees], axis=1)
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.bins(values)))

    def probability(self, rows: DataFrame) -> Column:
        """array<double> of the classes' probabilities for the rows' feature columns."""
        width = len(self.names)

        def score(columns: pd.Series) -> pd.Series:
            values = np.array(columns.tolist(), dtype=float).reshape(-1, width)
            return pd.Series(list(self.probabilities(values)))

        return F.pandas_udf(score, "array<double>")(F.array(*[F.col(c).cast("double") for c in self.names]))

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [[[t.feature.tolist(), t.cut.tolist(), t.leaf.tolist()] for t in r] for r in self.rounds]
        text = json.dumps({"classes": self.classes, "names": self.names, "edges": [e.tolist() for e in self.edges], "rounds": trees})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        kept = json.loads(spark.read.text(path, wholetext=True).first()[0])
        tree = lambda f, c, v: Tree(np.array(f), np.array(c), np.array(v))
        return cls(kept["classes"], kept["names"], [np.array(e) for e in kept["edges"]], [[tree(*t) for t in r] for r in kept["rounds"]])


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss for each row and class, in whole numbers of 1 / _ONE."""
    p = softmax(margins)
    hit = np.arange(p.shape[1]) == label[:, None]
    return np.rint((p - hit) * _ONE).astype(np.int64), np.rint(np.maximum(p * (1 - p), 1e-6) * _ONE).astype(np.int64)


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, n_bins: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(node, feature, bin, 2): sums of the gradients and curvatures of the rows in each bin of each node."""
    out = np.zeros((nodes, bins.shape[1], n_bins, 2), np.int64)
    for i in range(bins.shape[1]):
        np.add.at(out, (node, i, bins[:, i], 0), g)
        np.add.at(out, (node, i, bins[:, i], 1), h)
    return out


def best_splits(sums: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of each node's best split, from its histogram; feature 0 and the last bin (all rows left) if none gains.

    A split gains what second-order boosting expects the loss to fall by; both sides need a curvature of ``least``. Ties go to the first feature
    and the lowest cut.
    """
    left = np.cumsum(sums, axis=2)[:, :, :-1] / _ONE
    whole = (sums.sum(axis=2) / _ONE)[:, :, None]
    right = whole - left
    worth = lambda s: np.square(s[..., 0]) / (s[..., 1] + l2)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), worth(left) + worth(right) - worth(whole), -1.0)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), at] > 1e-9
    n_bins = sums.shape[2]
    return np.where(found, at // (n_bins - 1), 0), np.where(found, at % (n_bins - 1), n_bins - 1)


def edges_of(rows: DataFrame, names: list[str], n_bins: int) -> list[np.ndarray]:
    """Different quantiles of each feature, at most ``n_bins`` - 1, from one aggregation with mergeable sketches."""
    shares = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"e{i}") for i, c in enumerate(names)]).first()
    return [np.unique(np.array(e, dtype=float)) if e else np.zeros(0) for e in found]


def fit(rows: DataFrame, names: list[str], label: str, classes: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, n_bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Fit on rows with feature columns ``names`` (missing ones count as the lowest) and the class's name in ``label``; rows of other
    labels are left out, without any the model gives all classes the same chance.

    Rows are binned and written once. In each round and at each depth every task sums gradients over its own rows into
    histograms (class, node, feature, bin); Spark adds those up, and what comes to the driver has at most classes x 2 ** depth x
    features x ``n_bins`` rows, whatever the table's size. Sums are whole numbers: partitions and lost tasks don't change a tree.
    """
    code = (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int")
    known = rows.filter(F.col(label).isin(*classes)).select(code.alias("label"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    inputs = [f"x{i}" for i in range(len(names))]
    model = Boosted(list(classes), list(names), edges_of(known, inputs, n_bins), [])
    k, width = len(classes), len(names)

    def bin_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"label": pdf["label"], "bins": [b.tobytes() for b in model.bins(pdf[inputs].to_numpy(float))], "margins": [np.zeros(k)] * len(pdf)})

    schema = "label int, bins binary, margins array<double>"
    table = stored(known.mapInPandas(bin_rows, schema), "boosting")
    since = 0  # the first round that is not in the table's margins yet

    def state(pdf: pd.DataFrame, so_far: Boosted, first: int) -> tuple[np.ndarray, np.ndarray]:
        bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, width)
        return bins, np.stack(pdf["margins"].to_list()) + so_far.margins(bins, first)

    def summed(level: int, trees: list[Tree], first: int) -> np.ndarray:
        so_far = Boosted(model.classes, model.names, model.edges, list(model.rounds))
        start, nodes = 2**level - 1, 2**level

        def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((k, nodes, width, n_bins, 2), np.int64)
            for pdf in parts:
                if len(pdf):
                    bins, margins = state(pdf, so_far, first)
                    g, h = gradients(margins, pdf["label"].to_numpy())
                    for c in range(k):
                        out[c] += histogram(bins, trees[c].place(bins, level) - start, nodes, n_bins, g[:, c], h[:, c])
            flat = out.reshape(-1, 2)
            cells = np.flatnonzero(flat[:, 1])
            yield pd.DataFrame({"cell": cells, "g": flat[cells, 0], "h": flat[cells, 1]})

        out = np.zeros((k * nodes * width * n_bins, 2), np.int64)
        for cell, g, h in table.mapInPandas(add, "cell long, g long, h long").groupBy("cell").agg(F.sum("g"), F.sum("h")).collect():
            out[cell] = g, h
        return out.reshape(k, nodes, width, n_bins, 2)

    for _ in range(rounds):
        inner = 2**depth - 1
        trees = [Tree(np.zeros(inner, np.int64), np.full(inner, n_bins - 1), np.zeros(inner + 1)) for _ in range(k)]
        for level in range(depth):
            sums = summed(level, trees, since)
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            for c in range(k):
                trees[c].feature[at], trees[c].cut[at] = best_splits(sums[c], l2, least)
                if level == depth - 1:  # the leaves' sums are on either side of the last cuts
                    under = np.arange(n_bins)[None] <= trees[c].cut[at][:, None]
                    own = sums[c][np.arange(2**level), trees[c].feature[at]]
                    sides = np.stack([np.where(under[..., None], own, 0).sum(axis=1), np.where(under[..., None], 0, own).sum(axis=1)], axis=1).reshape(-1, 2) / _ONE
                    trees[c].leaf[:] = -rate * sides[:, 0] / (sides[:, 1] + l2)
        model.rounds.append(trees)
        if len(model.rounds) - since >= _KEPT_ROUNDS and len(model.rounds) < rounds:
            kept, first = Boosted(model.classes, model.names, model.edges, list(model.rounds)), since

            def step(parts: Iterator[pd.DataFrame], kept: Boosted = kept, first: int = first) -> Iterator[pd.DataFrame]:
                for pdf in parts:
                    if len(pdf):
                        yield pdf.assign(margins=list(state(pdf, kept, first)[1]))

            table, since = stored(table.mapInPandas(step, schema), "boosting"), len(model.rounds)
    return model
