"""All runs of a fit travel with a cell once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import factor


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_a_fit_are_not_shuffled_with_the_cells(spark):
    spark_rows = spark.range(10).select(F.col("id").alias("item_id"), (F.col("id") % 3).alias("user_id"), F.lit(2.0).alias("rating"))
    a, b = (factor.start(spark_rows, 2, c, 3) for c in ("item_id", "user_id"))
    met = factor._both(factor.views(spark_rows)[0], a, b)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in met.splitlines() if "Join" in line and "Inner, (" in line]
    assert joins and not any("run#" in line for line in joins)


def plain_fit(cells, d, runs, least_gain):
    """The rule by plain numpy, one run after the other: the least error and its factors. A cell without a rating counts for the squares alone."""
    items, users = sorted({i for i, _, _ in cells}), sorted({u for _, u, _ in cells})
    i, u = (np.array([ids.index(c[k]) for c in cells]) for k, ids in ((0, items), (1, users)))
    on = np.array([c[2] is not None for c in cells])
    r = np.array([c[2] or 0.0 for c in cells])
    value = np.sqrt(r[on].mean() / d)
    best = (np.inf,)
    for run in range(runs):
        a, b = (factor.started(np.array(ids), value, d, runs)[:, run].copy() for ids in (items, users))

        def half(mine, me, other, of):
            for s in range(d):
                rest = (r - (mine[me] * other[of]).sum(1) + mine[me, s] * other[of, s]) * on
                num, den = (np.bincount(me, x, len(mine)) for x in (rest * other[of, s], other[of, s] ** 2))
                mine[:, s] = np.divide(num, den, out=np.zeros_like(num), where=den != 0)

        def error():
            return np.sqrt((((r - (a[i] * b[u]).sum(1)) ** 2)[on]).mean())

        last, new = np.inf, error()
        while last - new >= least_gain:
            half(a, i, b, u)
            half(b, u, a, i)
            last, new = new, error()
        best = min(best, (new, run, dict(zip(items, a)), dict(zip(users, b))), key=lambda x: x[:2])
    return best


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_fit_in_blocks_is_the_plain_one(spark, monkeypatch, block):
    monkeypatch.setattr(factor, "BLOCK_CELLS", block)
    monkeypatch.setattr(factor, "FEW_CELLS", min(block, factor.FEW_CELLS))
    rng = np.random.default_rng(4)
    cells = [(int(i) - 3, int(u) << 40, None if rng.random() < 0.1 else float(rng.integers(1, 6))) for i in range(15) for u in rng.integers(0, 25, 9)]
    rated = spark.createDataFrame([*cells, (None, 5, 1.0), (5, None, 2.0)], "item_id long, user_id long, rating double")
    mean = np.mean([c[2] for c in cells if c[2] is not None] + [1.0, 2.0])
    started = factor.started
    want_mean = np.mean([c[2] for c in cells if c[2] is not None])
    a, b, error = factor.fit(rated, restarts=2)
    got = {r.id: r.f for r in a.collect()}, {r.id: r.f for r in b.collect()}
    monkeypatch.setattr(factor, "started", lambda ids, value, d, runs: started(ids, value * np.sqrt(mean / want_mean), d, runs))
    want = plain_fit(cells, 2, 3, 0.005)
    assert abs(error - want[0]) < 1e-9
    for g, w in zip(got, want[2:], strict=True):
        assert g.keys() == w.keys() and all(np.allclose(g[k], w[k], atol=1e-7) for k in w)


def test_starts_are_those_of_the_table(spark):
    rows = spark.createDataFrame([(-7, 1, 2.0), (3, 1, 4.0), (1 << 50, 2, 5.0)], "item_id long, user_id long, rating double")
    got = {(r.run, r.id): r.f for r in factor.start(rows, 3, "item_id", 4).collect()}
    ids = np.array([-7, 3, 1 << 50])
    want = factor.started(ids, np.sqrt(11 / 3 / 3), 3, 4)
    assert got == {(run, int(i)): want[k, run].tolist() for k, i in enumerate(ids) for run in range(4)}


def test_a_sweep_writes_two_tables(spark, monkeypatch):
    written, write = [], factor.materialize
    monkeypatch.setattr(factor, "materialize", lambda df, name: written.append(name) or write(df, name))
    rows = spark.range(40).select((F.col("id") % 8).alias("item_id"), (F.col("id") % 5).alias("user_id"), (F.col("id") % 4 + 1.0).alias("rating"))
    factor.fit(rows, sweeps=3, least_gain=-1.0, restarts=1)
    base = len(written)
    factor.fit(rows, sweeps=5, least_gain=-1e9, restarts=1)
    assert len(written) - 2 * base == 4


def test_fit_of_nothing(spark):
    a, b, error = factor.fit(spark.createDataFrame([], "item_id long, user_id long, rating double"))
    assert (a.count(), b.count(), error) == (0, 0, 0.0)
