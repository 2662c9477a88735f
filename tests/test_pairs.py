"""Sums of item pairs: lists by item against a plain count, and no pair is shuffled."""

from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import cf, prep
from shelfmark.plans.registry import ORACLES, QUERIES


def plain(rows):
    by_user, out = defaultdict(list), defaultdict(list)
    for u, i, r in rows:
        by_user[u].append((i, r))
    for rated in by_user.values():
        known = [r for _, r in rated if r is not None]
        mean = sum(known) / len(known) if known else None
        for i, x in rated:
            for j, y in rated:
                if i < j:
                    out[i, j].append((x, y, mean))

    def total(terms):
        terms = [t for t in terms if t is not None]
        return sum(terms) if terms else None

    def over(ps, f, *need):
        return total(f(*p) if all(p[k] is not None for k in need) else None for p in ps)

    return {
        k: (len(ps), over(ps, lambda x, y, m: x * y, 0, 1), over(ps, lambda x, y, m: x * x, 0), over(ps, lambda x, y, m: y * y, 1), over(ps, lambda x, y, m: (x - y) ** 2, 0, 1), over(ps, lambda x, y, m: (x - m) * (y - m), 0, 1))
        for k, ps in out.items()
    }


@pytest.mark.parametrize("block, item_block, some, far", [(256, 20_000, False, 0), (4, 20_000, True, 0), (4, 3, True, 1 << 40)])
def test_sums_of_lists_equal_a_plain_count(spark, monkeypatch, block, item_block, some, far):
    rng = np.random.default_rng(3)
    rows = [(u, int(i) + far * (int(i) % 2), float(rng.integers(1, 6)) + (0.1 if some and i % 7 == 0 else 0)) for u in range(20) for i in rng.integers(0, 30, rng.integers(1, 25))]
    rows += [(50, 1, None), (50, 2, 2.0), (50, 3, 3.0), (51, 1, 4.0)] if some else []
    monkeypatch.setattr(cf, "SUM_PAIRS", 50)
    lists = cf.partners
    monkeypatch.setattr(cf, "partners", lambda r: lists(r, block, item_block))
    got = cf.pair_sums(cf.with_mean(spark.createDataFrame(rows, "user_id long, item_id long, rating double"))).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        for a, b in zip((r.n, r.s12, r.s11, r.s22, r.d2, r.c12), want[r.item_1, r.item_2], strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)


def test_rounding_is_that_of_decimals(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.0000005, -0.0000005, 1.0000015, 2.5e-7, 1e12 + 0.1234567, float("nan"), float("inf"), None, *(rng.integers(0, 10**8, 500) / 10**7).tolist(), *rng.normal(0, 3, 2000).tolist()]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (4, 6, 9):
        assert x.where(~cf.rounded("x", places).eqNullSafe(F.round("x", places))).count() == 0


def test_no_pair_is_shuffled(spark):
    plan = cf.item_cosine(cf.ratings(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "item_2" in line for line in plan.splitlines())


def test_pairs_travel_in_few_bytes(spark):
    rng = np.random.default_rng(5)
    rows = [(u, int(i), float(x)) for u in range(300) for i, x in zip(rng.integers(0, 20_000, 60), rng.integers(1, 6, 60), strict=True)]
    packs = cf.partners(spark.createDataFrame(rows, "user_id long, item_id long, rating double")).agg(F.sum(F.octet_length("pack"))).first()[0]
    assert packs < 3 * 300 * 60 * 59 / 2


def test_packs_give_back_what_they_hold():
    rng = np.random.default_rng(6)
    for values in (rng.integers(-5, 5, 100), rng.integers(0, 1 << 60, 100), rng.normal(0, 1, 100), rng.integers(0, 9, 100) / 2, np.zeros(0), np.array([0.0, -0.0, 1e300, np.nan, np.inf])):
        (back,) = cf.unpack(cf.pack([cf.narrowed(values)]))
        assert np.array_equal(back.astype(values.dtype), values, equal_nan=values.dtype.kind == "f") and (np.signbit(back) == np.signbit(values)).all()


def test_no_score_is_a_row_of_a_shuffle(spark):
    train, targets = cf.train_and_targets(spark, "/root/testdata/sf0.001")
    plan = cf.neighbours(train, targets)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any(c in line for line in exchanges for c in ("item_2", "neighbour", "metric"))


def test_rounding_of_arrays_is_that_of_columns(spark):
    values = [0.0, 2.5e-10, 1.4999999995, 0.1234567885, 1e12 + 0.1234567894, *np.random.default_rng(9).normal(0, 3, 500).tolist()]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(F.round("x", 9)).collect()]
    assert cf.rounded_array(np.array(values), 9).tolist() == want


def test_held_ratings_without_item_or_training_keep_their_row(spark):
    train = cf.with_mean(spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 10, 5.0), (2, 11, 1.0), (2, 12, 3.0), (3, 12, 3.0), (3, 11, 2.0)], "user_id long, item_id long, rating double"))
    held = spark.createDataFrame([("dev", 1, 12, 3.0), ("dev", 1, None, 3.0), ("dev", 9, 10, 3.0), ("eval", 1, 12, 4.0)], "part string, user_id long, item_id long, actual double")
    got = {(r.part, r.user_id, r.item_id): (r.neighbours, r.mean) for r in cf.answered(train, held, ("euc",)).collect()}
    assert got == {("dev", 1, 12): ([10, 11], 3.0), ("eval", 1, 12): ([10, 11], 3.0), ("dev", 1, None): (None, 3.0), ("dev", 9, 10): (None, None)}


def test_tasks_hold_neighbouring_items(spark, monkeypatch):
    monkeypatch.setattr(cf, "SUM_PAIRS", 200)
    rng = np.random.default_rng(8)
    rows = [(100 * c + u, 1000 * c + int(i), float(rng.integers(1, 6))) for c in range(8) for u in range(20) for i in rng.choice(100, 20, replace=False)]
    sums = cf.pair_sums(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), ("n",))
    spans = sums.groupBy(F.spark_partition_id()).agg(F.min("item_1"), F.max("item_1"), F.sum("n")).collect()
    assert len(spans) >= 4 and sum(r[2] - r[1] for r in spans) < 1.5 * 7100
    assert sum(r[3] for r in spans) == 8 * 20 * 190 and max(r[3] for r in spans) < 3 * 8 * 20 * 190 / len(spans)


def test_both_orders_are_written_in_twice_the_bytes_of_one(spark, tmp_path):
    size = {}
    for name in ("item_pair_cosine", "item_pair_cosine_ordered"):
        QUERIES[name](spark, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/{name}")
        size[name] = sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))
    assert size["item_pair_cosine_ordered"] < 2.5 * size["item_pair_cosine"]


def test_split_is_one_exchange_by_user(spark):
    plan = prep.split(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(" in line for line in plan.splitlines()) == 1


def test_split_of_repeated_and_missing_values_is_that_of_sql(spark, tmp_path):
    rng = np.random.default_rng(10)
    orders = [(k, None if k % 9 == 0 else k % 9) for k in range(60)]
    lines = [(k, n, None if (k + n) % 7 == 0 else int(rng.integers(0, 4)), None if (k * n) % 11 == 10 else float(rng.integers(1, 4))) for k in range(60) for n in range(int(rng.integers(0, 5)))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"WITH {prep.SPLIT} SELECT user_id, item_id, rating, part FROM split").fetchall()
    assert sorted(map(str, map(tuple, prep.split(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_pairs_nobody_asks_for_are_not_summed(monkeypatch):
    buckets = cf.Buckets(np.zeros(0, np.int64), np.ones(1, np.int64), {})
    of = pa.list_(pa.struct([("item_id", pa.int64()), ("rating", pa.float64())]))

    def packs(lists, others, mean):
        batch = pa.RecordBatch.from_arrays([pa.array(mean, pa.float64()), pa.array([[(i, float(r)) for i, r in x] for x in lists], of), pa.array(others, of)], ["mean", "l", "m"])
        return [p for b in cf._item_lists(buckets, True)(iter([batch])) for p in b.column("pack").to_pylist()]

    pairs = packs([[(i, i % 5 + 1) for i in range(200)]], [None], [2.0])
    questions = packs([[(7, 0.0)]], [[(9, 0.0), (11, 0.0)]], [2 * 3])
    summed, sizes = cf._summed, []
    monkeypatch.setattr(cf, "_summed", lambda held: sizes.append(sum(len(h[0]) for h in held)) or summed(held))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 2, pa.int32()), pa.array([0, 1]), pa.array([*questions, *pairs], pa.binary())], ["bucket", "kind", "pack"])
    (got,) = [cf.unpack(p) for b in cf._answers(64, ("euc",))(iter([batch])) for p in b.column("pack").to_pylist()]
    assert sizes == [2] and [c.tolist() for c in got] == [[3, 0], [7, 7], [9, 11], [2.0, 1.0]]


def test_counts_without_a_corater_broadcast_nothing(spark):
    plan = QUERIES["no_corated_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_counts_without_a_corater_equal_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(cf, "ASK_TARGETS", 3)
    rng = np.random.default_rng(12)
    cells = {(u, int(i)) for u in range(30) for i in rng.integers(0, 60, rng.integers(0, 9))}
    asked = {(u, int(i)) for u in range(32) for i in rng.integers(0, 70, 10)}
    train = spark.createDataFrame([(u, i, 3.0, 3.0) for u, i in cells] + [(1, None, 3.0, 3.0), (40, None, 2.0, 2.0), (41, 3, 2.0, 2.0), (41, 4, 2.0, 2.0)], "user_id long, item_id long, rating double, mean double")
    targets = spark.createDataFrame([*asked, (1, None), (None, 5), (40, 5), (41, None)], "user_id long, item_id long")
    of = defaultdict(set)
    for u, i in cells:
        of[u].add(i)
    met = {(i, j) for items in [*of.values(), {3, 4}] for i in items for j in items}
    want, total = [], defaultdict(int)
    for u, i in sorted(asked):
        if of[u] - {i}:
            none = sum((i, j) not in met for j in of[u] - {i})
            total[u] += none
            want.append((u, i, none, total[u]))
    assert sorted(map(tuple, cf.no_corated(train, targets).collect())) == want


def test_no_prediction_is_a_row(spark):
    plan = QUERIES["accuracy_rmse_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "preds" not in plan


@pytest.mark.parametrize("name", ["accuracy_rmse_report", "accuracy_by_k"])
def test_reports_of_missing_values_are_those_of_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(cf, "JUDGED", 7)
    rng = np.random.default_rng(11)
    orders = [(k, None if k % 13 == 12 else k % 12) for k in range(90)]
    lines = [(k, n, None if (k + n) % 17 == 0 else int(rng.integers(0, 14)), None if (k * n) % 19 == 18 else float(rng.integers(1, 6))) for k in range(90) for n in range(int(rng.integers(0, 6)))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    keys = [c for c in ("part", "metric", "normalized", "k") if c in want]
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 100
    for c in want.columns:
        assert (got[c] == want[c]).all() if c in keys else np.allclose(got[c].astype(float), want[c].astype(float), atol=1.01e-6 if c == "accuracy" else 1.01e-4, equal_nan=True)


def test_split_sorts_ratings_once(spark):
    plan = prep.split(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line for line in plan.splitlines()) == 2  # the ratings, and what is left of them


def test_items_of_text_are_summed_too(spark):
    rows = [("u", "b", 2.0), ("u", "a", 3.0), ("v", "a", 1.0), ("v", "b", 4.0), ("v", "10", 5.0), ("v", None, 5.0)]
    got = {(r.item_1, r.item_2): (r.n, r.s12) for r in cf.pair_sums(spark.createDataFrame(rows, "user_id string, item_id string, rating double"), ("n", "s12")).collect()}
    assert got == {("a", "b"): (2, 10.0), ("10", "a"): (1, 5.0), ("10", "b"): (1, 20.0)}
