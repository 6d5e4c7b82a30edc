"""Resampling against a direct count, and slices of a large bin against whole bins."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosebin.operators import bootstrap
from dosebin.operators.bootstrap import bootstrap_bins, bootstrap_replicates

P = (1 << 31) - 1
Z = 500_000_003


def by_hand(values, key, seed, b):
    """Mean and median of replicate b with unbounded integers."""
    values = sorted(values)
    n = len(values)
    digest = hashlib.md5(f"{seed}|{key}|{b}".encode()).hexdigest()
    c = [int(digest[8 * i : 8 * i + 8], 16) & ((1 << 28) - 1) for i in range(4)]
    drawn = [values[(((c[3] * i**3 + c[2] * i**2 + c[1] * i + c[0]) % P) * n) >> 31] for i in range(Z, Z + n)]
    return np.mean(drawn), np.median(drawn)


def bins_frame(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("a", 1, float(x)) for x in rng.normal(5, 1, 41)]
    rows += [("a", 2, float(x)) for x in rng.integers(0, 4, 30)]
    rows += [("b", 1, 3.25), ("b", None, 9.0), ("b", 2, None)]
    return spark.createDataFrame(rows, "k string, bin_id int, norm_psmad2 double")


def test_replicates_match_direct_count(spark):
    df = bins_frame(spark)
    got = bootstrap_replicates(df, ["k"], n_boot=7, seed=11).collect()
    assert len(got) == 3 * 7
    pdf = df.toPandas().dropna()
    for r in got:
        values = pdf[(pdf.k == r.k) & (pdf.bin_id == r.bin_id)].norm_psmad2.tolist()
        mean, median = by_hand(values, f"{r.k}|{r.bin_id}", 11, r.replicate_no)
        assert (r.boot_mean, r.boot_median, r.n_cells) == (pytest.approx(mean), pytest.approx(median), len(values))


def test_one_cell_bin(spark):
    row = bootstrap_bins(bins_frame(spark), ["k"], n_boot=5).where("k = 'b'").first()
    assert row.mean_norm_psmad2 == row.mean_norm_psmad2_low == row.mean_norm_psmad2_high == 3.25
    assert row.n_cells == 1


def test_same_seed_any_partitions(spark):
    df = bins_frame(spark)
    one = bootstrap_bins(df.coalesce(1), ["k"], n_boot=20, seed=5).orderBy("k", "bin_id").toPandas()
    many = bootstrap_bins(df.repartition(7), ["k"], n_boot=20, seed=5).orderBy("k", "bin_id").toPandas()
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-12)
    other = bootstrap_bins(df, ["k"], n_boot=20, seed=6).orderBy("k", "bin_id").toPandas()
    assert not np.allclose(one.mean_norm_psmad2, other.mean_norm_psmad2)


def test_low_mean_high(spark):
    rows = bootstrap_bins(bins_frame(spark), ["k"], n_boot=50).collect()
    for r in rows:
        for s in ("mean", "median"):
            x = r[f"{s}_norm_psmad2"]
            assert r[f"{s}_norm_psmad2_low"] - 1e-9 <= x <= r[f"{s}_norm_psmad2_high"] + 1e-9


def tree_by_hand(n_cells, block, text):
    """Counts per block: every draw alone, digit by digit, with unbounded integers."""

    def value(c, z):
        z += Z
        return (c[3] * z**3 + c[2] * z**2 + c[1] * z + c[0]) % P

    def coefficients(t):
        digest = hashlib.md5(t.encode()).hexdigest()
        return [int(digest[8 * i : 8 * i + 8], 16) & ((1 << 28) - 1) for i in range(4)]

    counts = {}

    def split(i, j, n):
        if j - i == 1:
            counts[i] = n
            return
        mid, size = (i + j) // 2, min(n_cells, j * block) - i * block
        c, rest, open_, left = coefficients(f"{text}|{i}|{j}"), (mid - i) * block, n, 0
        for digit in range(48):
            if not rest or not open_:
                break
            coins = [value(c, digit * 2**25 + k // 30) >> (k % 30) & 1 for k in range(open_)]
            rest *= 2
            if rest >= size:
                rest -= size
                left += coins.count(0)
                open_ = coins.count(1)
            else:
                open_ = coins.count(0)
        split(i, mid, left)
        split(mid, j, n - left)

    split(0, -(-n_cells // block), n_cells)
    return [counts[i] for i in range(len(counts))], coefficients, value


def test_tree_against_single_coins():
    for n, block in ((100, 7), (64, 8), (1000, 333), (9, 100), (41, 40)):
        texts = ["3|a|1", "3|a|2"]
        got = bootstrap.block_counts(n, block, texts)
        for row, text in zip(got, texts):
            assert row.tolist() == tree_by_hand(n, block, text)[0] and row.sum() == n


def test_draws_fall_evenly():
    """Block counts have a binomial's mean and variance, and draws of more than one part add up."""
    texts = [f"1|x|{b}" for b in range(4000)]
    counts = bootstrap.block_counts(1000, 300, texts)  # 300, 300, 300, 100
    for k, share in enumerate((0.3, 0.3, 0.3, 0.1)):
        assert counts[:, k].mean() == pytest.approx(1000 * share, abs=4 * (1000 * share * (1 - share) / 4000) ** 0.5)
        assert counts[:, k].var() == pytest.approx(1000 * share * (1 - share), rel=0.12)
    assert np.corrcoef(counts[:, 0], counts[:, 1])[0, 1] == pytest.approx(-0.43, abs=0.06)


def test_draws_of_a_small_bin_fall_evenly():
    """Every position of a bin is drawn as often as any other, by the first draws too."""
    coef = bootstrap._coefficients([f"1|x|{b}" for b in range(8000)])
    drawn = bootstrap._hash(coef, bootstrap.FIRST + np.arange(5)) * 8 >> 31
    for k in range(5):
        assert np.abs(np.bincount(drawn[:, k], minlength=8) - 1000).max() < 4.5 * 1000**0.5


def test_more_draws_than_a_split_holds(monkeypatch):
    monkeypatch.setattr(bootstrap, "SPLIT_DRAWS", 100)
    texts = [f"1|x|{b}" for b in range(500)]
    counts = bootstrap.block_counts(1000, 500, texts)
    assert set(counts.sum(axis=1)) == {1000} and counts[:, 0].var() == pytest.approx(250, rel=0.3)


@pytest.mark.parametrize("slice_cells", [64, 1500, 100_000])
def test_slices_do_not_change_any_number(spark, slice_cells):
    """A hot bin in slices of several widths, with a value held by a third of its cells."""
    rng = np.random.default_rng(0)
    x = rng.normal(10, 2, 3000)
    x[:1000] = 11.0
    df = spark.createDataFrame(
        pd.DataFrame({"k": "hot", "bin_id": 1, "norm_psmad2": x})
    ).unionByName(spark.createDataFrame([("cold", 1, 1.0), ("cold", 1, 2.0)], "k string, bin_id long, norm_psmad2 double"))
    got = bootstrap_replicates(df, ["k"], n_boot=12, seed=1, slice_cells=slice_cells, block_cells=64).collect()
    assert len(got) == 24 and {r.n_cells for r in got if r.k == "hot"} == {3000}
    ordered = np.sort(x)
    for r in got:
        if r.k == "hot":
            text = f"1|hot|1|{r.replicate_no}"
            counts, coefficients, value = tree_by_hand(3000, 64, text)
            drawn = []
            for i, n in enumerate(counts):
                c, own = coefficients(f"{text}|{i}|{i + 1}"), ordered[64 * i : 64 * i + 64]
                drawn += [own[value(c, z) * len(own) >> 31] for z in range(n)]
            assert (r.boot_mean, r.boot_median) == (pytest.approx(np.mean(drawn)), pytest.approx(np.median(drawn)))


def test_intervals_are_those_of_the_mean(spark):
    df = spark.range(2000).select(
        F.lit("k").alias("k"), F.lit(1).alias("bin_id"), (F.col("id") % 500).cast("double").alias("norm_psmad2")
    )
    r = bootstrap_bins(df, ["k"], n_boot=400, slice_cells=100, block_cells=50).first()
    assert r.n_cells == 2000
    assert r.mean_norm_psmad2 == pytest.approx(249.5, abs=1)
    assert r.mean_norm_psmad2_high - r.mean_norm_psmad2_low == pytest.approx(2 * 1.96 * 144.3 / 2000**0.5, rel=0.15)


def test_positions_are_the_scaled_hashes():
    rng = np.random.default_rng(8)
    for rows, count, size in ((1, 1, 1), (1, 67_001, 65_536), (40, 65, 9), (300, 1000, 1000), (5, 128, 65_535)):
        coef = rng.integers(0, 1 << 28, (rows, 4))
        coef[0] = (1 << 28) - 1
        want = bootstrap._hash(coef, Z + np.arange(count)) * size >> 31
        assert np.array_equal(bootstrap._positions(coef, count, size), want)


def test_powers_of_draw_numbers_are_taken_once_a_span(monkeypatch):
    """A replicate of a large bin hashed each of its draw numbers for itself."""
    hashed = []
    keep = bootstrap._hash
    monkeypatch.setattr(bootstrap, "_hash", lambda coef, z: hashed.append(len(z)) or keep(coef, z))
    n, texts = 60_000, ["a", "b", "c"]
    bootstrap._resample(np.arange(n, dtype=float), 0, np.full((3, 1), n), np.zeros(3, np.int64), n, 1 << 16, texts)
    assert sum(hashed) <= 3 * (n // 32)


def test_trees_are_walked_for_many_replicates_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("a", 1, float(x)) for x in rng.normal(0, 1, 500)], "k string, bin_id int, norm_psmad2 double")
    seen = []
    keep = bootstrap._sliced_bins
    monkeypatch.setattr(bootstrap, "_sliced_bins", lambda *a: seen.append(a[-1]) or keep(*a))

    def got():
        reps = bootstrap_replicates(df, ["k"], n_boot=70, seed=3, slice_cells=64, block_cells=16)
        return reps.orderBy("replicate_no").toPandas()

    many = got()
    monkeypatch.setattr(bootstrap, "WALKED_AT_ONCE", 1)
    one = got()
    assert seen[0] > 1 and seen[1] == 1 and len(one) == 70
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-12)


def test_draws_are_counted_not_sorted(monkeypatch):
    """Every replicate's positions were sorted and their values fetched one by one."""
    rng = np.random.default_rng(6)
    cells, texts = np.sort(rng.normal(4, 1, 5000)), [f"2|x|{b}" for b in range(60)]
    asked = []
    keep = bootstrap._positions
    monkeypatch.setattr(bootstrap, "_positions", lambda *a: asked.append(a) or keep(*a))
    sums, low, high = bootstrap._resample(cells, 0, np.full((60, 1), 5000), np.zeros(60, np.int64), 5000, 1 << 16, texts)
    drawn = cells[bootstrap._hash(bootstrap._coefficients(texts), Z + np.arange(5000)) * 5000 >> 31]
    assert np.allclose(sums, drawn.sum(axis=1), rtol=1e-13)
    ranked = np.sort(drawn, axis=1)
    assert np.array_equal(low, ranked[:, 2499]) and np.array_equal(high, ranked[:, 2500])
    assert [len(a[0]) for a in asked] == [26, 26, 8]  # replicates that are counted together


def test_infinite_values_count_only_where_drawn():
    cells, texts = np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]), [f"5|x|{b}" for b in range(300)]
    with np.errstate(invalid="ignore"):
        sums, low, _ = bootstrap._resample(cells, 0, np.full((300, 1), 5), np.zeros(300, np.int64), 5, 1 << 16, texts)
        drawn = cells[bootstrap._hash(bootstrap._coefficients(texts), Z + np.arange(5)) * 5 >> 31]
        assert np.array_equal(sums, drawn.sum(axis=1), equal_nan=True)
    assert np.array_equal(low, np.sort(drawn, axis=1)[:, 2])
    assert {-np.inf, np.inf} < set(sums[~np.isnan(sums)]) and np.isnan(sums).any() and np.isfinite(sums).any()


def test_middle_draws_are_found_by_lots(monkeypatch):
    """The counts of all positions were added up one by one for every replicate."""
    rng = np.random.default_rng(8)
    cells, texts = np.sort(rng.normal(0, 1, 6500)), [f"3|x|{b}" for b in range(40)]
    added, keep = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda a, *rest, **more: added.append(np.size(a)) or keep(a, *rest, **more))
    _, low, high = bootstrap._resample(cells, 0, np.full((40, 1), 6500), np.zeros(40, np.int64), 6500, 1 << 16, texts)
    ranked = np.sort(cells[bootstrap._hash(bootstrap._coefficients(texts), Z + np.arange(6500)) * 6500 >> 31], axis=1)
    assert np.array_equal(low, ranked[:, 3249]) and np.array_equal(high, ranked[:, 3250])
    assert sum(added) < 40 * 6500 / 10


def test_only_blocks_of_the_middle_are_counted(monkeypatch):
    """Draws of every block of a large bin were counted by position, though counts tell the middle draw alone."""
    rng = np.random.default_rng(11)
    cells, texts = np.sort(rng.normal(2, 1, 5000)), [f"4|x|{b}" for b in range(30)]
    counts = bootstrap.block_counts(5000, 500, texts)
    asked, keep = [], bootstrap._times_drawn
    monkeypatch.setattr(bootstrap, "_times_drawn", lambda *a: asked.append(a) or keep(*a))
    sums, low, high = bootstrap._resample(cells, 0, counts, np.zeros(30, np.int64), 5000, 500, texts)
    assert 0 < len(asked) <= 4
    for r, text in enumerate(texts):
        drawn = []
        for k, n in enumerate(counts[r]):
            coef = bootstrap._coefficients([f"{text}|{k}|{k + 1}"])
            drawn.append(cells[500 * k : 500 * k + 500][bootstrap._hash(coef, Z + np.arange(n))[0] * 500 >> 31])
        drawn = np.sort(np.concatenate(drawn))
        assert sums[r] == pytest.approx(drawn.sum(), rel=1e-12) and (low[r], high[r]) == (drawn[2499], drawn[2500])


def test_draws_of_wide_blocks_do_not_depend_on_the_rows_done_together():
    """Blocks of many cells are counted and fetched a replicate at a time, others many at once."""
    rng = np.random.default_rng(12)
    n = np.array([9000, 1, 8999, 0])
    coef = bootstrap._coefficients([f"9|{b}" for b in range(4)])
    for size in (8191, 8192, 9001):
        held = np.sort(rng.normal(0, 1, size))
        drawn = [bootstrap._hash(coef[r : r + 1], Z + np.arange(k))[0] * size >> 31 for r, k in enumerate(n)]
        times = bootstrap._times_drawn(coef, n, size)
        sums = bootstrap._drawn_sums(coef, n, held)
        for r, own in enumerate(drawn):
            assert np.array_equal(times[r, :size], np.bincount(own, minlength=size)) and not times[r, size:].any()
            assert sums[r] == pytest.approx(held[own].sum(), abs=1e-9)


def test_hashes_at_the_ends_of_their_range():
    """Quotients by the prime are right where the hash is 0 or the largest, in narrow and wide spans."""
    rng = np.random.default_rng(13)
    for i in (0, 63, 64, 127, 128, 255, 4096, 9001):
        for want in (0, 1, P - 1):
            c = [int(x) for x in rng.integers(0, 1 << 28, 3)]
            first = (want - sum(x * (Z + i) ** (k + 1) for k, x in enumerate(c))) % P
            for count, size in ((i + 1, 1000), (9500, 1 << 16), (9500, 65_535)):
                assert bootstrap._positions(np.array([[first, *c]]), count, size)[0, i] == want * size >> 31


def test_codes_stand_for_keys(spark, monkeypatch):
    """Cells that carry codes get the draws of the keys; no text travels with them."""
    df = bins_frame(spark).unionByName(spark.createDataFrame([(None, 1, 2.0), (None, 1, 4.0)], "k string, bin_id int, norm_psmad2 double"))
    names = spark.createDataFrame([(7, "a"), (9, "b"), (11, None)], "code long, k string")
    coded = df.join(names.withColumnRenamed("k", "name"), F.col("k").eqNullSafe(F.col("name"))).drop("k", "name")
    want = sorted(map(repr, bootstrap_bins(df, ["k"], n_boot=9, seed=2).drop("k").collect()))
    sent, keep = [], bootstrap._whole_bins
    monkeypatch.setattr(bootstrap, "_whole_bins", lambda rows, *a: sent.append(rows) or keep(rows, *a))
    got = bootstrap_bins(coded, ["code"], n_boot=9, seed=2, names=names)
    assert sorted(map(repr, got.drop("code").collect())) == want and len(want) == 4
    assert "string" not in dict(sent[0].dtypes).values()
    large = bootstrap_bins(coded, ["code"], n_boot=9, seed=2, names=names, slice_cells=16, block_cells=8)
    plain = bootstrap_bins(df, ["k"], n_boot=9, seed=2, slice_cells=16, block_cells=8)
    a, b = (x.select("n_cells", "bin_id", "median_norm_psmad2").collect() for x in (large, plain))
    assert sorted(a) == sorted(b)
    with pytest.raises(ValueError):
        bootstrap_bins(coded, ["code"], names=names, mode="poisson")
