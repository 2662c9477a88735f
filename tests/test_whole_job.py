"""Queries give the whole job where the SQL or the given tables are too small to notice a cut."""

import numpy as np
import pytest

from shelfmark.operators import factor
from shelfmark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_text_of_documents_with_large_ids_is_merged(spark, tmp_path):
    sf = put(
        spark, tmp_path,
        documents=([(1, "a"), (1000, "b"), (70_000, "c"), (70_001, "not wanted")], "doc_id long, text string"),
        conversations=([(1000, 1, "y"), (1000, 0, "x"), (1, 0, None)], "conv_id long, turn long, text string"),
        pages=([(70_000, "u"), (5, "v")], "page_id long, url string"),
        part=([(1,), (5,), (1000,), (70_000,)], "p_partkey long"),
    )
    got = {r.id: (r.text, r.n) for r in QUERIES["multi_source_text"](spark, sf).collect()}
    assert got == {1: ("a ", 2), 5: ("v", 1), 1000: ("b x y", 3), 70_000: ("c u", 2)}


def test_pairs_with_one_common_user_have_a_cosine(spark, tmp_path):
    lines = [(1, 1, 10, 1.0), (1, 2, 20, 5.0), (1, 3, 30, 4.0), (2, 1, 10, 2.0), (2, 2, 20, 2.0), (3, 1, 40, 1.0), (4, 1, 50, 1.0), (4, 2, 60, None)]
    sf = put(
        spark, tmp_path,
        lineitem=(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double"),
        orders=([(1, 7), (2, 8), (3, 9), (4, 6)], "o_orderkey long, o_custkey long"),
    )
    got = {(r.item_1, r.item_2): r.score for r in QUERIES["corated_cosine_raw"](spark, sf).collect()}
    assert got == {(10, 20): round(9 / (5**0.5 * 29**0.5), 6), (10, 30): 1.0, (20, 30): 1.0, (50, 60): None}


def test_vectors_are_projected_on_all_components_that_reach_the_limit(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.array(frame["embedding"].tolist(), float)
    value, vector = np.linalg.eigh(np.cov(x.T))
    kept = vector[:, value >= 0.015][:, ::-1]
    assert kept.shape[1] > 8
    rows = {r.vec_id: r.projected for r in QUERIES["pca_project"](spark, SF).collect()}
    got = np.array([rows[i] for i in frame["vec_id"]])
    assert got.shape == (len(x), kept.shape[1])
    assert np.allclose(np.abs(got), np.abs(x @ kept), atol=1e-5)  # the sign of an eigenvector is free


def reconstructed(cells):
    """Every rated cell by plain numpy: centre by item, then by user, one sweep, both means back, clip."""
    items, users = sorted({i for i, _ in cells}), sorted({u for _, u in cells})
    x = np.full((len(items), len(users)), np.nan)
    for (i, u), r in cells.items():
        x[items.index(i), users.index(u)] = r
    by_item = np.nanmean(x, 1, keepdims=True)
    by_user = np.nanmean(x - by_item, 0, keepdims=True)
    d, c = x - by_item - by_user, np.sqrt(np.nanmean(x))
    a = np.nanmean(d, 1, keepdims=True) / c
    a[np.abs(a) < 1e-9] = 0
    squares = np.nansum(np.where(np.isnan(d), np.nan, a * a), 0, keepdims=True)
    b = np.divide(np.nansum(d * a, 0, keepdims=True), squares, out=np.zeros_like(squares), where=squares > 0)
    pred = np.clip(a * b + by_item + by_user, 0, 9)
    return {(i, u): pred[items.index(i), users.index(u)] for i, u in cells}


def same(got, want):
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_reconstruction_adds_both_means(spark):
    u = factor.utility(factor.ratings(spark, SF)).collect()
    got = {(r.item_id, r.user_id): r.pred for r in QUERIES["uv_reconstruct"](spark, SF).collect()}
    assert same(got, reconstructed({(r.item_id, r.user_id): float(r.rating) for r in u}))


def test_reconstruction_of_a_full_block_is_the_means(spark, tmp_path):
    rating = {(i, u): float((i * i + 2 * u + i * u) % 5 + 1) for i in range(3) for u in range(3)}
    sf = put(
        spark, tmp_path,
        lineitem=([(u, i, i, r) for (i, u), r in rating.items()], "l_orderkey long, l_linenumber long, l_partkey long, l_quantity double"),
        orders=([(u, u) for u in range(3)], "o_orderkey long, o_custkey long"),
    )
    x = np.array([[rating[i, u] for u in range(3)] for i in range(3)])
    want = {(i, u): x[i].mean() + x[:, u].mean() - x.mean() for i, u in rating}
    got = {(r.item_id, r.user_id): r.pred for r in QUERIES["uv_reconstruct"](spark, sf).collect()}
    assert same(got, want)


def test_every_part_has_five_urls(spark, tmp_path):
    sf = put(spark, tmp_path, part=([(3, 1), (4, 2), (5, None)], "p_partkey long, p_size int"))
    got = {(r.p_partkey, r.page): r.url for r in QUERIES["paged_urls"](spark, sf).collect()}
    assert got == {(k, n): f"https://books.example/item/{k}?page={n}" for k in (3, 4, 5) for n in range(1, 6)}


def errors_of_sweeps(cells, d=2, least_gain=0.005):
    """The error at the start and after each sweep, by plain numpy, until the gain is small."""
    items, users = sorted({i for i, _ in cells}), sorted({u for _, u in cells})
    m = np.full((len(items), len(users)), np.nan)
    for (i, u), r in cells.items():
        m[items.index(i), users.index(u)] = r
    f = np.sqrt(np.nanmean(m) / d)
    a, b, known = np.full((len(items), d), f), np.full((len(users), d), f), ~np.isnan(m)

    def sweep(m, known, a, b):
        for s in range(d):
            rest = np.where(known, m - a @ b.T + np.outer(a[:, s], b[:, s]), 0)
            a[:, s] = rest @ b[:, s] / (known @ b[:, s] ** 2)

    errors = [np.sqrt(np.nanmean((m - a @ b.T) ** 2))]
    while len(errors) < 2 or errors[-2] - errors[-1] >= least_gain:
        sweep(m, known, a, b)
        sweep(m.T, known.T, b, a)
        errors.append(np.sqrt(np.nanmean((m - a @ b.T) ** 2)))
    return errors


def test_fit_ends_by_its_rule(spark):
    rng = np.random.default_rng(9)
    cells = {(i, u): float(rng.integers(1, 6)) for i in range(12) for u in range(12) if rng.random() < 0.6}
    want = errors_of_sweeps(cells)
    assert len(want) - 1 > 4
    _, _, error = factor.fit(spark.createDataFrame([(i, u, r) for (i, u), r in cells.items()], "item_id long, user_id long, rating double"))
    assert abs(error - want[-1]) < 1e-6


def test_fit_without_an_error_to_compare_is_refused(spark):
    cells = [(1, 1, float("nan")), (1, 2, 2.0)]
    with pytest.raises(ValueError, match="nan"):
        factor.fit(spark.createDataFrame(cells, "item_id long, user_id long, rating double"))
