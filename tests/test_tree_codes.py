"""Sums over codes of several columns, and customer features in one aggregate."""

import datetime as dt

import numpy as np
import pytest

from tidecast.operators import customers, trees

HIGHEST = [63, 12, 63, 3, 1, 0, 34]


def table(n=5000, seed=9):
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, h + 1, n) for h in HIGHEST]).astype(np.uint8), rng


def test_codes_hold_every_bin():
    bins, rng = table()
    codes = trees.Codes.of(bins, HIGHEST)
    assert len(codes.groups) < len(bins) and codes.shape == bins.shape
    f, at = rng.integers(0, len(bins), 300), rng.integers(0, bins.shape[1], 300)
    assert np.array_equal(codes[f, at], bins[f, at]) and np.array_equal(codes.take(at)[f, np.arange(300)], bins[f, at])


@pytest.mark.parametrize("scale, slots", [(1, 1), (1, 2), (1, 40), (1 << 24, 2)])
def test_sums_by_chunks_are_those_of_all_rows(monkeypatch, scale, slots):
    """Also where Hessians and counts do not fit one double (a large scale)."""
    monkeypatch.setattr(trees, "CHUNK_ROWS", 1 << 10)
    bins, rng = table()
    n = bins.shape[1]
    g, h, c = rng.integers(-(1 << 20), 1 << 20, n).astype(float), rng.integers(0, 1 << 20, n) * float(scale), rng.integers(0, 4, n).astype(np.uint8)
    slot, columns = rng.integers(0, slots, n).astype(np.int16), np.array([0, 1, 3, 4, 6])
    sums = trees._Sums(trees.Codes.of(bins, HIGHEST), slots, columns)
    for a in range(0, n, sums.chunk):
        b = min(a + sums.chunk, n)
        at = np.flatnonzero(c[a:b] > 0)
        sums.add(a, b, at, slot[a:b][at], [x[a:b][at] for x in (g, h, c)])
    at = np.flatnonzero(c > 0)
    assert np.array_equal(sums.total(), trees.histogram(bins, at, slot[at], slots, columns, (g, h, c.astype(float))))


def test_leaves_of_rows_are_those_of_a_walk():
    bins, rng = table()
    n = bins.shape[1]
    sums = np.rint(rng.normal(size=n) * 1000 + 400 * (bins[0] > 20)), np.full(n, trees._UNIT), np.ones(n, np.uint8)
    leaf = np.zeros(n, np.int32)
    tree = trees.grow(trees.Job("boost", 1, 4), 1.0, bins, sums, np.arange(len(bins)), leaf)
    assert len(tree.feature) > 5 and np.array_equal(leaf, tree.walk(bins))


def test_training_rows_of_the_large_tables_grow_locally():
    data = trees.Binned("", None, list(customers.CHURN_FEATURES), [], 4_314_528)
    assert data.bytes <= trees.LOCAL_BYTES


def test_customer_features_are_one_aggregate(spark):
    day = dt.date(2024, 1, 1)
    rows = [(f"c{i % 4}", day + dt.timedelta(days=i * i % 17), f"{i}", "n", 1.5 * i) for i in range(30)] + [("c9", None, "x", "n", 2.0), ("c9", None, "y", "n", 2.0)]
    inv = spark.createDataFrame(rows, "customer_no string, invoice_date date, invoice_number string, customer_name string, amount double")
    got = customers.customer_features(inv)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    r = {x.customer_no: x for x in got.collect()}
    for c in ("c0", "c1", "c2", "c3"):
        days = sorted(d for k, d, *_ in rows if k == c)
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        assert r[c].frequency == len(days) and r[c].median_gap == np.median(gaps) and r[c].min_gap == min(gaps) and r[c].max_gap == max(gaps)
        assert abs(r[c].avg_gap - np.mean(gaps)) < 1e-12 and abs(r[c].gap_std - np.std(gaps, ddof=1)) < 1e-9 and r[c].peak_quarter == 1
    # Two orders without a date: counted, their gap is a zero one, no quarter.
    assert (r["c9"].frequency, r["c9"].min_gap, r["c9"].peak_quarter, r["c9"].monetary) == (2, 0.0, None, 4.0)
