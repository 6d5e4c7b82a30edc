"""Poisson weights against plain counting and against drawing; windows, tasks, ties."""

import hashlib
from statistics import median

import numpy as np
import pytest

from dosebin.operators import poisson
from dosebin.operators.bootstrap import bootstrap_bins, bootstrap_replicates

P = (1 << 31) - 1


def by_hand(rows, key, seed, b):
    digest = hashlib.md5(f"{seed}|{key}|{b}".encode()).hexdigest()
    c = [int(digest[8 * i : 8 * i + 8], 16) & ((1 << 28) - 1) for i in range(4)]

    def hashed(z):
        return (c[3] * z**3 + c[2] * z**2 + c[1] * z + c[0]) % P

    drawn = []
    for x, number in rows:
        h = hashed((hashed(number % P) + number // P % P) % P)
        drawn += [x] * int((h >= poisson.LIMITS).sum())
    return (np.mean(drawn), median(drawn)) if drawn else (None, None)


def test_weights_are_poisson():
    coef = np.random.default_rng(1).integers(0, 1 << 28, (400, 4))
    w = poisson.weights(coef, np.arange(3000) * 977_777_777_777)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    sums = w.sum(axis=1)  # of a replicate: Poisson with mean 3000
    assert sums.var() == pytest.approx(3000, rel=0.25)


@pytest.fixture(scope="module")
def cells(spark):
    r = np.random.default_rng(4)
    hot = np.round(r.normal(10, 2, 4000), 3)
    hot[:1400] = 10.001  # a third of the bin is one value, near the middle
    rows = [("hot", 1, float(x), int(i * 10**13 + 5)) for i, x in enumerate(hot)]
    rows += [("few", k, float(k * x), 9 + x) for k in (1, 2) for x in range(k * 3)] + [("few", None, 1.0, 77), ("few", 1, None, 78), (None, 1, 2.5, 79)]
    return spark.createDataFrame(rows, "k string, bin_id int, norm_psmad2 double, cell_id long").repartition(5)


def test_replicates_against_plain_counting(spark, cells, monkeypatch):
    monkeypatch.setattr(poisson, "HELD_BINS", 2)  # sums of a bin leave a task several times
    monkeypatch.setattr(poisson, "WINDOW", 3)
    monkeypatch.setattr(poisson, "WEIGHED_AT_ONCE", 5000)
    got = bootstrap_replicates(cells, ["k"], n_boot=6, seed=2, mode="poisson").collect()
    rows = [r for r in cells.collect() if r.bin_id is not None and r.norm_psmad2 is not None]
    sizes = {}
    for r in got:
        own = [(x.norm_psmad2, x.cell_id) for x in rows if (x.k, x.bin_id) == (r.k, r.bin_id)]
        sizes[r.k, r.bin_id] = len(own)
        mean, mid = by_hand(own, f"{'NULL' if r.k is None else r.k}|{r.bin_id}", 2, r.replicate_no)
        assert r.n_cells == len(own) and (r.boot_mean, r.boot_median) == (mean, mid) if mean is None else (
            (r.boot_mean, r.boot_median) == (pytest.approx(mean), pytest.approx(mid)))
    assert len(got) == 6 * len(sizes) and len(sizes) == 4
    again = bootstrap_replicates(cells.coalesce(1), ["k"], n_boot=6, seed=2, mode="poisson").collect()
    key = lambda r: (str(r.k), r.bin_id, r.replicate_no)
    for a, b in zip(sorted(got, key=key), sorted(again, key=key)):
        assert key(a) == key(b) and (a.boot_median == b.boot_median) and a.boot_mean == (b.boot_mean and pytest.approx(b.boot_mean))


def test_intervals_are_close_to_those_of_drawing(cells):
    """Within a fifth of the interval's width, at 500 replicates."""
    hot = cells.where("k = 'hot'")
    a, b = (bootstrap_bins(hot, ["k"], n_boot=500, seed=3, mode=m).first() for m in ("exact", "poisson"))
    for s in ("mean", "median"):
        names = [f"{s}_norm_psmad2{e}" for e in ("", "_low", "_high")]
        width = a[names[2]] - a[names[1]]
        assert all(abs(a[n] - b[n]) <= 0.2 * width + 1e-3 for n in names)
    with pytest.raises(ValueError):
        bootstrap_bins(hot, ["k"], mode="other")
