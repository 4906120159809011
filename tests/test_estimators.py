"""Boosted trees and the kernel classifier against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators import boosting, kernel, learning, reports

CLASSES = list(learning.CLASSES)


def blobs(seed=0, n=900):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    y = np.where(x[:, 0] * x[:, 1] > 0.3, 0, np.where(np.abs(x[:, 2]) > 0.8, 1, 2))
    flip = rng.random(n) < 0.05
    return x, np.where(flip, (y + 1) % 3, y)


def frame(spark, x, y, parts=3):
    rows = [(*map(float, r), CLASSES[c], "1", i, "A", "C") for i, (r, c) in enumerate(zip(x, y, strict=True))]
    names = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", label string, chrom string, pos int, ref string, alt string").repartition(parts), names


def plain_boosting(x, y, edges, rounds, depth, rate, l2=1.0, least=1.0):
    """Depth by depth over the rows themselves: margins after all rounds."""
    bins = np.stack([(x[:, i][:, None] > e[None]).sum(axis=1) for i, e in enumerate(edges)], axis=1)
    margins = np.zeros((len(x), 3))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for c in range(3):
            g, h = p[:, c] - (y == c), np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)

            def grow(rows, left_depth, g=g, h=h, c=c):
                if left_depth == 0:
                    step[rows, c] = -rate * g[rows].sum() / (h[rows].sum() + l2) if len(rows) else 0
                    return
                best, where = 1e-9, None
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                for f in range(x.shape[1]):
                    for cut in range(bins[rows, f].max(initial=0)):
                        a, b = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if h[a].sum() >= least and h[b].sum() >= least and worth(a) + worth(b) - worth(rows) > best + 1e-7:
                            best, where = worth(a) + worth(b) - worth(rows), (f, cut)
                if where is None:
                    return grow(rows, left_depth - 1)
                f, cut = where
                grow(rows[bins[rows, f] <= cut], left_depth - 1)
                grow(rows[bins[rows, f] > cut], left_depth - 1)

            grow(np.arange(len(x)), depth)
        margins += step
    return margins


def test_boosting_equals_a_plain_version(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "_KEPT_ROUNDS", 2)  # margins are written again in between
    x, y = blobs()
    rows, names = frame(spark, x, y)
    model = boosting.fit(rows, names, "label", CLASSES, rounds=5, depth=2, rate=0.5, n_bins=16)
    plain = plain_boosting(x, y, model.edges, 5, 2, 0.5)
    assert np.allclose(model.margins(model.bins(x)), plain, atol=1e-5)
    again = boosting.fit(rows.repartition(7), names, "label", CLASSES, rounds=5, depth=2, rate=0.5, n_bins=16)
    assert np.array_equal(again.margins(again.bins(x)), model.margins(model.bins(x)))
    learning.save(model, str(tmp_path / "m"))
    kept = learning.load(str(tmp_path / "m"), "boosted")
    got = learning.classified(kept, rows)
    assert np.allclose([[r["p_het"], r["p_hom"], r["p_novar"]] for r in got.orderBy("pos").collect()], model.probabilities(x))
    assert reports.accuracy(reports.confusion(got)).first()[0] > 0.7
    learning.save_bundle(model, got, str(tmp_path / "b"))
    loaded, tables = learning.load_bundle(spark, str(tmp_path / "b"), "boosted")
    assert loaded.names == names and tables["scores"].columns == ["accuracy", "variant_f1"] and tables["report"].count() == 3


def test_boosting_bears_odd_tables(spark):
    x, y = blobs(n=60)
    rows, names = frame(spark, x, y)
    none = boosting.fit(rows.limit(0), names, "label", CLASSES, rounds=1)
    assert np.allclose(none.probabilities(x), 1 / 3)
    odd = rows.withColumns({"f0": F.lit(None).cast("double"), "f1": F.lit(7.0), "label": F.when(F.col("pos") < 5, "unknown").otherwise(F.col("label"))})
    model = boosting.fit(odd, names, "label", CLASSES, rounds=2)
    assert all(abs(sum(r) - 1) < 1e-9 for r in model.probabilities(np.full((3, 4), np.nan)))


def plain_kernel(x, y, model, held, cost=1.0, steps=8):
    z = kernel.mapped((x - model.mean) / model.scale, model.frequencies, model.phases)
    weights = np.zeros((3, z.shape[1]))
    for c in range(3):
        sign, w = np.where(y == c, 1.0, -1.0), np.zeros(z.shape[1])
        for _ in range(steps):
            some = ~held & (sign * (z @ w) < 1)
            ridge = np.eye(z.shape[1]) / cost
            ridge[-1, -1] = 1e-9
            new = np.linalg.solve(z[some].T @ z[some] + ridge, z[some].T @ sign[some])
            done, w = np.abs(new - w).max() < 1e-6, new
            if done:
                break
        weights[c] = w
    return weights


def test_kernel_equals_a_plain_version_and_beats_a_line_on_rings(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 900)
    angle, radius = rng.uniform(0, 2 * np.pi, 900), 1 + y + rng.normal(0, 0.15, 900)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1).round(4)
    rows, names = frame(spark, x, y)
    model = kernel.fit(rows, names, "label", CLASSES, features=64, gamma=1.0)
    held = np.array([r[0] for r in rows.orderBy("pos").select(F.pmod(F.xxhash64(*names), F.lit(kernel.HELD_OUT)) == 0).collect()])
    assert np.allclose(model.weights, plain_kernel(x, y, model, held), atol=1e-4)
    learning.save(model, str(tmp_path / "m"))
    got = learning.classified(learning.load(str(tmp_path / "m"), "kernel"), rows)
    p = np.array([[r["p_het"], r["p_hom"], r["p_novar"]] for r in got.orderBy("pos").collect()])
    assert np.allclose(p, model.probabilities(x)) and np.allclose(p.sum(axis=1), 1)
    one = np.hstack([x, np.ones((900, 1))])
    line = np.linalg.lstsq(one, np.eye(3)[y], rcond=None)[0]
    right = (p.argmax(axis=1) == y).mean()
    assert right > 0.95 > 0.6 > ((one @ line).argmax(axis=1) == y).mean()
    sure = p.max(axis=1) > 0.9  # calibrated: where it says nine in ten, at least that many are right
    assert (p.argmax(axis=1) == y)[sure].mean() > 0.9
    wanted, m = y[held], model.margins(x[held])
    for c in range(3):  # the sigmoid's derivatives vanish at the fitted values
        q = 1 / (1 + np.exp(-(m[:, c] * model.sigmoids[c, 0] + model.sigmoids[c, 1])))
        assert abs((q - (wanted == c)).mean()) < 0.02


def test_kernel_bears_odd_tables(spark):
    x, y = blobs(n=60)
    rows, names = frame(spark, x, y)
    none = kernel.fit(rows.limit(0), names, "label", CLASSES, features=8)
    assert np.allclose(none.probabilities(x).sum(axis=1), 1)
    model = kernel.fit(rows.withColumns({"f0": F.lit(None).cast("double"), "f1": F.lit(7.0)}), names, "label", CLASSES, features=8)
    assert np.isfinite(model.probabilities(np.full((3, 4), np.nan))).all()


def test_search_takes_the_best_settings(spark):
    x, y = blobs(n=300)
    rows, names = frame(spark, x, y)
    grid = [{"rounds": 1, "depth": 1, "rate": 0.01}, {"rounds": 4, "depth": 3, "rate": 0.5}]
    assert learning.search(rows, "boosted", tuple(names), grid, folds=2) == grid[1]


@pytest.mark.parametrize("name", ["boosted_scores", "kernel_scores"])
def test_queries_score_held_out_variants(spark, sf_dir, name):
    from lociq import catalog

    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 20 and np.allclose(got[["p_het", "p_hom", "p_novar"]].sum(axis=1), 1)
    assert set(got.predicted) <= set(CLASSES) and got.label.notna().all()
