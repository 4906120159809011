"""A classifier with a Gaussian kernel, by seeded random features, with probabilities calibrated on rows it was not fitted on."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.scratch import stored

HELD_OUT = 5  # one row in so many is left to the calibration


def directions(width: int, features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies and phases: the mean of products of the cosines tends to exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (width, features)), rng.uniform(0, 2 * np.pi, features)


def mapped(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """The random features of each row, and a column of ones."""
    z = np.sqrt(2 / len(phases)) * np.cos(x @ frequencies + phases)
    return np.hstack([z, np.ones((len(x), 1))])


def newton_sums(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the squared hinge loss, over the rows inside the margin: sum of z z' and of y z. y is 1 or -1."""
    inside = y * (z @ weights) < 1
    return z[inside].T @ z[inside], z[inside].T @ y[inside]


def newton_step(gram: np.ndarray, cross: np.ndarray, cost: float) -> np.ndarray:
    """Weights that are best if the same rows stay inside the margin; the constant is not drawn to zero."""
    ridge = np.eye(len(gram)) / cost
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(gram + ridge, cross)


def calibration_step(a: float, b: float, g: np.ndarray, h: np.ndarray) -> tuple[float, float]:
    """A Newton step of the sigmoid's slope and constant, damped by a small ridge."""
    da, db = np.linalg.solve(h + 1e-6 * np.eye(2), g)
    return a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))


@dataclass
class KernelModel:
    """Features are centred and scaled, mapped to random features, and weighed for each class against the rest; a sigmoid of each margin, and
    these over their sum, are the probabilities."""

    classes: list[str]
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # a row for each class
    sigmoids: np.ndarray  # slope and constant for each class

    def margins(self, values: np.ndarray) -> np.ndarray:
        x = (np.nan_to_num(values, nan=0.0) - self.mean) / self.scale
        return mapped(x, self.frequencies, self.phases) @ self.weights.T

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.margins(values) * self.sigmoids[:, 0] + self.sigmoids[:, 1], -500, 500)))
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def probability(self, rows: DataFrame) -> Column:
        """array<double> of the classes' probabilities for the rows' feature columns."""
        width = len(self.names)

        def score(columns: pd.Series) -> pd.Series:
            return pd.Series(list(self.probabilities(np.array(columns.tolist(), dtype=float).reshape(-1, width))))

        return F.pandas_udf(score, "array<double>")(F.array(*[F.col(c).cast("double") for c in self.names]))

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {k: getattr(self, k).tolist() for k in ("mean", "scale", "frequencies", "phases", "weights", "sigmoids")}
        spark.createDataFrame([(json.dumps({"classes": self.classes, "names": self.names} | arrays),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KernelModel:
        kept = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(kept["classes"], kept["names"], *[np.array(kept[k]) for k in ("mean", "scale", "frequencies", "phases", "weights", "sigmoids")])


def fit(rows: DataFrame, names: list[str], label: str, classes: list[str], features: int = 96, gamma: float | None = None, cost: float = 1.0, seed: int = 42, most_steps: int = 8) -> KernelModel:
    """Fit on rows with feature columns ``names`` (a missing value counts as 0) and the class's name in ``label``; other labels are left out.

    The squared hinge loss of each class against the rest is minimised by Newton steps over the rows inside the margin: each is
    one pass in which every task sums (features + 1) squared numbers over its rows, and Spark adds these up; the driver solves a
    system of that size. The sigmoids are fitted likewise on one row in HELD_OUT, chosen by a hash of its features, that took no
    part in the margins. ``gamma`` is by default one over the number of features. The state does not grow with the rows.
    """
    code = (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("int")
    inputs = [f"x{i}" for i in range(len(names))]
    known = rows.filter(F.col(label).isin(*classes)).select(code.alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in zip(names, inputs, strict=True)])
    moments = known.agg(*[f(x) for x in inputs for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([m or 0.0 for m in moments[::2]])
    scale = np.array([s if s else 1.0 for s in moments[1::2]])
    frequencies, phases = directions(len(names), features, gamma or 1 / len(names), seed)
    k, width = len(classes), features + 1
    model = KernelModel(list(classes), list(names), mean, scale, frequencies, phases, np.zeros((k, width)), np.tile([1.0, 0.0], (k, 1)))
    held = F.pmod(F.xxhash64(*inputs), F.lit(HELD_OUT)) == 0
    table = stored(known.withColumn("held", held), "kernel")

    def passed(weights: np.ndarray, todo: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = {c: np.zeros((width, width + 1)) for c in todo}
            for pdf in parts:
                z = mapped((pdf[inputs].to_numpy(float) - mean) / scale, frequencies, phases)
                for c in todo:
                    gram, cross = newton_sums(z, np.where(pdf["label"].to_numpy() == c, 1.0, -1.0), weights[c])
                    out[c][:, :-1] += gram
                    out[c][:, -1] += cross
            for c in todo:
                yield pd.DataFrame({"class": c, "cell": np.arange(width * (width + 1)), "v": out[c].ravel()})

        sums = {c: np.zeros(width * (width + 1)) for c in todo}
        for r in table.filter("NOT held").mapInPandas(add, "class int, cell int, v double").groupBy("class", "cell").agg(F.sum("v").alias("v")).collect():
            sums[r["class"]][r["cell"]] = r["v"]
        return {c: (s.reshape(width, -1)[:, :-1], s.reshape(width, -1)[:, -1]) for c, s in sums.items()}

    todo = list(range(k))
    for _ in range(most_steps):
        before = model.weights.copy()
        for c, (gram, cross) in passed(before, todo).items():
            model.weights[c] = newton_step(gram, cross, cost)
        todo = [c for c in todo if np.abs(model.weights[c] - before[c]).max() > 1e-6]
        if not todo:
            break

    def weigh(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"label": pdf["label"], "m": list(model.margins(pdf[inputs].to_numpy(float)))})

    margins = stored(table.filter("held").mapInPandas(weigh, "label int, m array<double>"), "kernel-margins")
    for _ in range(10):
        sums = []
        for c in range(k):
            m, p = F.get("m", c), F.lit(1.0) / (1 + F.exp(-(float(model.sigmoids[c][0]) * F.get("m", c) + float(model.sigmoids[c][1]))))
            off, curve = p - F.when(F.col("label") == c, 1.0).otherwise(0.0), p * (1 - p)
            sums += [F.sum(off * m), F.sum(off), F.sum(curve * m * m), F.sum(curve * m), F.sum(curve)]
        found = margins.agg(*sums).first()
        if found[0] is None:
            break
        before = model.sigmoids.copy()
        for c in range(k):
            ga, gb, haa, hab, hbb = found[5 * c : 5 * c + 5]
            model.sigmoids[c] = calibration_step(*before[c], np.array([ga, gb]), np.array([[haa, hab], [hab, hbb]]))
        if np.abs(model.sigmoids - before).max() < 1e-6:
            break
    return model
