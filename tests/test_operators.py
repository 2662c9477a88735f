import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import words
from shelfmark.operators import cf, factor, profile, text

SF = "/root/testdata/sf0.001"


def test_confidence_meets_at_the_threshold(spark):
    got = spark.createDataFrame([(1.0,), (2.5,), (5.0,)], "p double").select(cf.confidence(F.col("p")).alias("c")).collect()
    assert [round(r.c, 6) for r in got] == [0.0, 50.0, 100.0]


def test_neighbours_against_plain_python(spark):
    rng = np.random.default_rng(3)
    cells = {(u, i): float(rng.integers(1, 6)) for u in range(8) for i in rng.choice(10, 5, replace=False)}
    train = cf.with_mean(spark.createDataFrame([(u, int(i), r) for (u, i), r in cells.items()], "user_id long, item_id long, rating double"))
    targets = spark.createDataFrame([(u, 3) for u in range(8)], "user_id long, item_id long")
    got = {(r.user_id, r.neighbour): r.score for r in cf.neighbours(train, targets).where("metric = 'euc'").collect()}
    want = {}
    for u in range(8):
        for i in {i for v, i in cells if v == u} - {3}:
            both = [v for v in range(8) if (v, 3) in cells and (v, i) in cells]
            if both:
                want[u, int(i)] = round(sum((cells[v, 3] - cells[v, i]) ** 2 for v in both) ** 0.5, 9)
    assert got == want


def test_similarities_are_bounded_and_predictions_in_range(spark):
    from shelfmark.plans.registry import QUERIES

    assert QUERIES["item_pair_cosine"](spark, SF).where("abs(score) > 1.000001").count() == 0
    assert QUERIES["knn_predict_norm"](spark, SF).where("pred < 1 or pred > 5").count() == 0
    c = QUERIES["confusion_summary"](spark, SF).first()
    assert c.tp + c.fp + c.fn + c.tn == c.n


def test_text_functions(spark):
    row = spark.range(1).select(words.sentences(F.lit("A b. C! d?")).alias("s"), words.clean_tokens(F.lit("<b>It's</b> the “Dog’s” end, &amp; (more)!")).alias("t"), words.caveat(F.lit("than2")).alias("c")).first()
    assert row.s == ["A b", " C", " d"]
    assert row.t == ["it", "the", "dog", "end", "more"]
    assert tuple(row.c) == ("after", "than")


def test_modifiers_of_two_words_and_contractions(spark):
    rows = [(1, "this is good thing"), (2, "this isn’t good thing"), (3, "it isn't good thing"), (4, "is not good thing"), (5, "not very good thing"), (6, "far from good thing"), (7, "at least good thing"), (8, "least good thing"), (9, "rather than good thing"), (10, "rather good thing"), (11, "do not do not good thing"), (12, "do nothing good thing")]
    got = {r.doc_id: r.weight for r in text.sentiment_of(spark.createDataFrame(rows, "doc_id int, text string"), [("good", 1)], ["thing"]).collect()}
    assert got == {1: 1, 2: -1, 3: -1, 4: -1, 5: -2, 6: -1, 7: 1, 8: -1, 9: 1, 10: 2, 11: 1, 12: 1}


def test_blocks_of_a_user_give_each_pair_once(spark):
    rng = np.random.default_rng(5)
    rows = [(u, int(i), float(rng.integers(1, 6))) for u, n in ((1, 40), (2, 3), (3, 1)) for i in rng.permutation(60)[:n]]
    r = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    got = sorted(map(tuple, cf.corated(r, 4).select("user_id", "item_1", "item_2", "r1", "r2").collect()))
    assert got == sorted((u, i, j, x, y) for u, i, x in rows for v, j, y in rows if u == v and i < j)


def test_quartiles_hang_on_no_exchange(spark):
    from shelfmark.operators import prep

    ids = spark.range(5000).select((F.col("id") * 7919 % 10_007).alias("item_id"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = sorted((r.item_id, r.place, r.quarter, r.rank) for r in prep.quarters(ids.repartition(5), "item_id").collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [g[1] for g in got] == list(range(5000))
    assert all(q == p // 1250 and k == 1250 - p % 1250 for _, p, q, k in got)


def test_best_of_restarts_is_no_worse(spark):
    rng = np.random.default_rng(2)
    u = spark.createDataFrame([(i, j, float(rng.integers(1, 6))) for i in range(8) for j in range(8) if rng.random() < 0.6], "item_id long, user_id long, rating double")
    a, b, error = factor.fit(u, d=2, restarts=3)
    assert error <= factor.fit(u, d=2)[2] + 1e-9
    fs = {r.id: r.f for r in a.collect()}, {r.id: r.f for r in b.collect()}
    gaps = [(r.rating - np.dot(fs[0][r.item_id], fs[1][r.user_id])) ** 2 for r in u.collect()]
    assert abs(np.sqrt(np.mean(gaps)) - error) < 1e-9
    assert {tuple(r.f) for r in factor.start(u, 2, "item_id", ones=True).collect()} == {(1.0, 1.0)}


def test_cold_items_and_small_users_go(spark, tmp_path):
    from shelfmark.operators import cf as c, prep

    orders = [(k, k // 10) for k in range(60)]
    lines = [(k, n, 5 if n < 3 else 100 + k, float(k % 7 + n)) for k, _ in orders for n in range(4)] + [(999, 1, 5, 1.0), (999, 2, 6, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([*orders, (999, 77)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert 77 not in {r.user_id for r in prep.users_min3(spark, str(tmp_path)).collect()}
    split = prep.split(spark, str(tmp_path)).collect()
    cold = {r.item_id for r in split if r.part == "dev"} - {r.item_id for r in split if r.part == "train"}
    assert cold and {r.item_id for r in c.cold_items(spark, str(tmp_path)).collect()} == cold


def test_trained_prediction_is_the_trainers(spark):
    rows = [("u", f"d{i}", int(v[0] == "1"), v) for i, v in enumerate(["10", "11", "01", "00", "10", "01"])]
    vectors = spark.createDataFrame(rows, "user_id string, doc_id string, good int, vector string")
    x, y = np.array([[float(c) for c in r[3]] for r in rows]), np.array([r[2] for r in rows], float)
    w = profile.fit_scaling(x, y, np.ones(len(rows)))
    weights = spark.createDataFrame([("u", k, j + 1, float(v)) for k, row in enumerate(w) for j, v in enumerate(row)], "user_id string, class int, place int, weight double")
    got = {r.doc_id: r.prob_good for r in profile.linear_scores(vectors, weights).collect()}
    f = np.concatenate([x, (2 - x.sum(1))[:, None]], 1)
    want = 1 / (1 + np.exp(f @ (w[0] - w[1])))
    assert all(abs(got[r[1]] - p) < 1e-6 for r, p in zip(rows, want))


def test_tags_and_lemmas_are_pluggable(spark):
    df = spark.createDataFrame([("dogs",), ("run",)], "term string")
    assert [r.term for r in text.tagged_nouns(df, lambda ws: ["NNS" if w == "dogs" else "VB" for w in ws]).collect()] == ["dogs"]
    df = spark.createDataFrame([("dogs", "n")], "word string, pos string")
    assert text.lemmatized(df, lambda w, p: w.rstrip("s")).first().lemma == "dog"


def test_tf_sums_to_one(spark):
    tok = text.tokens(spark, SF)
    assert text.term_frequency(tok, text.vocabulary(tok)).groupBy("doc_id").agg(F.sum("tf").alias("t")).where("abs(t - 1) > 1e-9").count() == 0


def test_factorisation_finds_a_rank_one_matrix(spark):
    cells = [(i, u, float((i + 1) * (u + 1)) / 4) for i in range(4) for u in range(5) if (i + u) % 3]
    _, _, error = factor.fit(spark.createDataFrame(cells, "item_id long, user_id long, rating double"), d=1, sweeps=6, least_gain=1e-9)
    assert error < 0.05


@pytest.mark.parametrize("method", ["logistic", "scaling"])
def test_classifiers_learn_a_plain_rule(method):
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    y, n = np.array([0, 0, 1, 1], float), np.ones(4) * 10
    if method == "logistic":
        w = profile.fit_logistic(x, y, n)
        p = 1 / (1 + np.exp(-(np.concatenate([x, np.ones((4, 1))], 1) @ w)))
    else:
        w = profile.fit_scaling(x, y, n)
        f = np.concatenate([x, (2 - x.sum(1))[:, None]], 1)
        p = 1 / (1 + np.exp(f @ (w[0] - w[1])))
    assert ((p > 0.5) == (y > 0)).all()
