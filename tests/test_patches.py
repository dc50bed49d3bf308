"""Patch features cover the whole grid."""

import numpy as np

from plotwise.operators import texture
from plotwise.plans import bindings
from plotwise.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_patch_has_features(spark):
    got = {r.id: np.array(r.features) for r in QUERIES["ml02_fft_features"](spark, SF).collect()}
    patches: dict = {}
    across = -(-bindings.width(spark, SF)[0] // 16)
    for r in bindings.cells(spark, SF).collect():
        patches.setdefault(r.row // 16 * across + r.col // 16, {})[r.row % 16, r.col % 16] = float(r.v)
    assert set(got) == set(patches)
    hann = np.outer(np.hanning(16), np.hanning(16))
    y, x = np.fft.fftfreq(16)[:, None] * 16, np.arange(9)[None, :]
    radius, angle = np.hypot(y, x), np.mod(np.arctan2(y, x), np.pi)
    where = np.minimum(angle / np.pi * 8, 7).astype(int) * 4 + np.minimum(radius / radius.max() * 4, 3).astype(int)
    assert any(len(p) < 256 for p in patches.values())
    for k, p in patches.items():
        mean = sum(p.values()) / len(p)
        z = np.array([[p.get((i, j), mean) for j in range(16)] for i in range(16)])
        size = np.abs(np.fft.rfft2(z * hann))
        size[0, 0] = 0
        f = np.array([size[where == b].sum() for b in range(32)])
        assert tuple(got[k][32:]) == (f.argmax() // 4 / 8, f.argmax() % 4 / 4)
        assert np.allclose(got[k][:32], f / f.sum(), atol=1e-5)


def test_forests_learn_and_teach_themselves(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 300)
    x = rng.normal(0, 0.6, (300, 4)) + np.eye(4)[label] * 3
    rows = [(i, int(label[i]), [float(v) for v in x[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>")
    options = {"trees": 10, "depth": 5}
    fitted = texture.fit_forest(df.where("id < 150"), "x", **options)
    part = texture.classify(fitted, df.where("id >= 150"), "x").collect()
    assert sum(r.pred == r.label for r in part) > 140 and all(1 / 3 <= r.conf <= 1 for r in part)
    own = texture.fit_summary(fitted, df.where("id < 150"), "x").collect()
    assert sum(r.n for r in own) == 150 and sum(r.hits for r in own) > 145
    weights = {r.feature: r.importance for r in texture.importances(spark, fitted).collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights[3] == min(weights.values())
    # six labelled rows of each class, the rest taught by the forest's own sure predictions
    few = df.where("id < 18")
    again = texture.self_train(few, df.where("id >= 18"), "id", "x", rounds=1, floor=0.6, cap=50, **options)
    hits = lambda f: sum(r.pred == r.label for r in texture.classify(f, df.where("id >= 18"), "x").collect())
    assert hits(again) >= hits(texture.fit_forest(few, "x", **options)) - 3 and hits(again) > 250
