"""Scores over tiles and whole lag surfaces against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from contrapair.operators import scoring as sc


def tables(spark, rng, items, templates, length):
    y, w, k = rng.normal(10, 1, (items, length)), rng.normal(0, 1, (items, length)), rng.normal(0, 1, (templates, length))
    a = spark.createDataFrame([(i, y[i].tolist(), w[i].tolist()) for i in range(items)], "id int, y array<double>, w array<double>").repartition(3)
    b = spark.createDataFrame([(f"k{j}", k[j].tolist()) for j in range(templates)], "K string, tk array<double>")
    return a, b, {(i, f"k{j}"): (np.corrcoef(w[i], y[i] * k[j])[0, 1], np.corrcoef(w[i], k[j])[0, 1]) for i in range(items) for j in range(templates)}


@pytest.mark.parametrize("tile,lot,length", [(4096, 8 << 20, 70), (16, 8 << 20, 70), (16, 2000, 64), (7, 300, 5), (64, 1, 64)])
def test_tiles_lots_and_parts_give_the_same_scores(spark, monkeypatch, tile, lot, length):
    monkeypatch.setattr(sc, "TILE", tile)
    monkeypatch.setattr(sc, "LOT_BYTES", lot)
    items, templates, want = tables(spark, np.random.default_rng(tile), 9, 23, length)
    got = {(r["id"], r["K"]): (r["rho_mult"], r["rho_add"]) for r in sc.score(items, templates).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_scores_collect_no_templates(spark, monkeypatch):
    monkeypatch.setattr(sc, "LOT_BYTES", 1000)
    items, templates, _ = tables(spark, np.random.default_rng(0), 4, 40, 33)  # ten times what a lot holds
    plan = sc.score(items, templates)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "collect_list" not in plan and "Subquery" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_flat_arrays_and_no_rows(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 3.0])], "id int, y array<double>, w array<double>")
    templates = spark.createDataFrame([("k", [1.0, 5.0])], "K string, tk array<double>")
    assert [(r["rho_mult"], r["rho_add"]) for r in sc.score(items, templates).collect()] == [(0.0, 0.0)]
    assert sc.score(items, templates.limit(0)).collect() == [] and sc.score(items.limit(0), templates).collect() == []


def direct_surface(w, z):
    """Sums over all displacements one by one."""
    w, z = ((a - a.mean()) / np.sqrt(((a - a.mean()) ** 2).sum()) for a in (w, z))
    h, v = w.shape
    return np.array([[(np.roll(w, (-r, -c), (0, 1)) * z).sum() for c in range(v)] for r in range(h)])


def test_surface_is_the_direct_sum():
    rng = np.random.default_rng(4)
    w, z = rng.normal(size=(2, 64, 64)), rng.normal(size=(2, 64, 64))
    fast = sc.lag_surface(w, z)
    for i in range(2):
        assert np.abs(fast[i] - direct_surface(w[i], z[i])).max() < 1e-9


@pytest.mark.parametrize("height,width,exclude", [(1, 50, 11), (12, 9, 3), (6, 5, 1)])
def test_peaks_on_a_torus(spark, near, height, width, exclude):
    rng = np.random.default_rng(height)
    k = rng.normal(size=(height, width))
    shift = (height // 2, width // 3)
    w = np.roll(k, shift, (0, 1)) + 0.1 * rng.normal(size=k.shape)
    y = np.full(k.shape, 2.0)
    row = (1, y.ravel().tolist(), w.ravel().tolist(), k.ravel().tolist())
    df = spark.createDataFrame([row], "id int, y array<double>, w array<double>, tk array<double>")
    got = sc.peak_energy(df, exclude=exclude, width=width).first()
    c = direct_surface(w, 2 * k)
    far = np.array([[min(r, height - r) > exclude // 2 or min(s, width - s) > exclude // 2 for s in range(width)] for r in range(height)])
    energy = (c[far] ** 2).mean()
    assert (got["shift_row"], got["shift_col"], got["shift"]) == (*shift, shift[0] * width + shift[1])
    near(got["pce0"], np.sign(c[0, 0]) * c[0, 0] ** 2 / energy, 1e-9)
    near(got["pce_max"], c[shift] ** 2 / energy, 1e-9)


def test_fields_that_are_no_grid(spark):
    df = spark.createDataFrame([([1.0] * 10, [1.0, 2.0] * 5, [3.0, 1.0] * 5)], "y array<double>, w array<double>, tk array<double>")
    for width, exclude in ((4, 1), (5, 11)):
        with pytest.raises(PySparkException):
            sc.peak_energy(df, width=width, exclude=exclude).collect()
