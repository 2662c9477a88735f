"""Content profiles: feature selection and per-user good/bad classifiers over long-form document weights.

A user is a document source, a rated item a labelled document, its rating the quality label. Absent weights are zeros:
sums run over present rows and divide by class sizes, and where a zero itself is needed the grid of a user's documents
and its few selected features is made explicit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.stages import materialize
from ..sources.tables import table
from .cf import _PRED_30, cells, confidence, predicted, rates
from .text import SENT, TOK, sentiment, tf_idf

N_FEATURES, N_CANDIDATES = 10, 20

LAB = f"""{TOK}, lb AS (SELECT d.source AS user_id, d.doc_id, l.quality AS good FROM labels l JOIN documents d USING (doc_id)),
wl AS (SELECT user_id, good, doc_id, term, weight FROM tfidf JOIN lb USING (doc_id)),
nc AS (SELECT user_id, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (good = 0) AS n_bad FROM lb GROUP BY 1)"""
TERM = """tmag AS (SELECT user_id, term, round(sum(abs(weight)), 6) AS mag, sum(weight) FILTER (good = 1) AS sg, sum(weight) FILTER (good = 0) AS sb FROM wl GROUP BY 1, 2),
cand AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mag DESC, term) AS c FROM tmag),
pf AS (SELECT user_id, term, mean_good, mean_bad, row_number() OVER (PARTITION BY user_id ORDER BY round(mean_good - mean_bad, 6), term) AS rank
  FROM (SELECT user_id, term, coalesce(sg, 0) / nullif(n_good, 0) AS mean_good, coalesce(sb, 0) / nullif(n_bad, 0) AS mean_bad FROM cand JOIN nc USING (user_id) WHERE c <= 20 AND n_good > 0 AND n_bad > 0)),
sel AS (SELECT * FROM pf WHERE rank <= 10)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, doc_id, good."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("user_id"))
    return table(spark, sf, "labels").join(docs, "doc_id").select("user_id", "doc_id", F.col("quality").alias("good"))


def class_sizes(lab: DataFrame) -> DataFrame:
    return lab.groupBy("user_id").agg(F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))


def matrix(spark: SparkSession, sf: str, data_type: str = "tfidf") -> DataFrame:
    """doc_id, term, weight of one matrix; both: with src, 0 for TF-IDF and 1 for sentiment."""
    if data_type == "both":
        return matrix(spark, sf, "tfidf").withColumn("src", F.lit(0)).unionByName(matrix(spark, sf, "sentiment").withColumn("src", F.lit(1)))
    return {"tfidf": tf_idf, "sentiment": sentiment}[data_type](spark, sf)


def weighted(spark: SparkSession, sf: str, data_type: str = "tfidf") -> tuple[DataFrame, DataFrame]:
    """Weights of labelled documents, written once for the branches that read them, and the labels."""
    lab = labelled(spark, sf)
    return materialize(matrix(spark, sf, data_type).join(lab, "doc_id"), "labelled-weights"), lab


def top_by_class(w: DataFrame, n: int = N_FEATURES) -> DataFrame:
    """Per user and class the n terms of largest absolute weight (ties: by term)."""
    mag = w.groupBy("user_id", "good", "term").agg(F.round(F.sum(F.abs("weight")), 6).alias("magnitude"))
    rank = F.row_number().over(Window.partitionBy("user_id", "good").orderBy(F.desc("magnitude"), "term"))
    return mag.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def term_sums(w: DataFrame) -> DataFrame:
    return w.groupBy("user_id", "term").agg(F.round(F.sum(F.abs("weight")), 6).alias("mag"), F.sum(F.when(F.col("good") == 1, F.col("weight"))).alias("sg"), F.sum(F.when(F.col("good") == 0, F.col("weight"))).alias("sb"))


def paired(w: DataFrame, sizes: DataFrame, n: int = N_FEATURES, candidates: int = N_CANDIDATES) -> DataFrame:
    """The candidates of largest magnitude, then those with the smallest difference good - bad of class means."""
    c = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("mag"), "term"))
    cand = term_sums(w).withColumn("c", c).where(F.col("c") <= candidates).join(sizes.where("n_good > 0 and n_bad > 0"), "user_id")
    means = cand.select("user_id", "term", (F.coalesce("sg", F.lit(0.0)) / F.col("n_good")).alias("mean_good"), (F.coalesce("sb", F.lit(0.0)) / F.col("n_bad")).alias("mean_bad"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.round(F.col("mean_good") - F.col("mean_bad"), 6), "term"))
    return means.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def determine_features(spark, sf, data_type: str = "tfidf", pairing: str = "paired", mixing: str = "independent") -> DataFrame:
    """The feature selection that the arguments name: user_id, src, term, rank and, unpaired, good.

    data_type: tfidf, sentiment or both; pairing: paired or unpaired; mixing: of both matrices, independent halves or
    TF-IDF features with their sentiment twins.
    """
    if data_type == "both" and mixing == "by_tfidf":
        t = feature_select_mixed_by_tfidf(spark, sf)
        twin = t.where("twin = 1").select("user_id", F.lit(1).alias("src"), "term", "rank")
        return t.select("user_id", F.lit(0).alias("src"), "term", "rank").unionByName(twin)
    kinds = ["tfidf", "sentiment"] if data_type == "both" else [data_type]
    parts = []
    for kind in kinds:
        n = N_FEATURES // len(kinds)
        w, lab = weighted(spark, sf, kind)
        got = paired(w, class_sizes(lab), n) if pairing == "paired" else top_by_class(w, n)
        parts.append(got.select("user_id", F.lit(["tfidf", "sentiment"].index(kind)).alias("src"), "term", "rank", *(["good"] if pairing == "unpaired" else [])))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def selected(spark, sf):
    w, lab = weighted(spark, sf)
    return w, lab, paired(w, class_sizes(lab))


_UNPAIRED = "un AS (SELECT * FROM (SELECT user_id, good, term, round(sum(abs(weight)), 6) AS magnitude, row_number() OVER (PARTITION BY user_id, good ORDER BY round(sum(abs(weight)), 6) DESC, term) AS rank FROM wl GROUP BY 1, 2, 3) WHERE rank <= 10)"


@query("feature_select_unpaired", f"WITH {LAB}, {_UNPAIRED} SELECT * FROM un")
def feature_select_unpaired(spark, sf):
    return top_by_class(weighted(spark, sf)[0]).select("user_id", "good", "term", "magnitude", "rank")


@query("feature_select_paired", f"WITH {LAB}, {TERM} SELECT user_id, term, round(mean_good, 6) AS mean_good, round(mean_bad, 6) AS mean_bad, rank FROM sel")
def feature_select_paired(spark, sf):
    return selected(spark, sf)[2].select("user_id", "term", F.round("mean_good", 6).alias("mean_good"), F.round("mean_bad", 6).alias("mean_bad"), "rank")


@query("feature_select_mixed_indep", f"""WITH {LAB}, {TERM}, {SENT.replace("md AS", "md_ AS").replace("JOIN md USING", "JOIN md_ USING")},
t2 AS (SELECT user_id, term, row_number() OVER (PARTITION BY user_id ORDER BY round(sum(abs(weight)), 6) DESC, term) AS rank FROM sv JOIN lb USING (doc_id) GROUP BY user_id, term)
SELECT user_id, 0 AS src, term, c AS rank FROM cand WHERE c <= 5 UNION ALL SELECT user_id, 1, term, rank FROM t2 WHERE rank <= 5""")
def feature_select_mixed_indep(spark, sf):
    """Half of the features from each matrix: 0 TF-IDF, 1 sentiment."""
    lab = labelled(spark, sf)
    by = Window.partitionBy("user_id").orderBy(F.desc("mag"), "term")
    parts = [term_sums(m.join(lab, "doc_id")).select("user_id", F.lit(i).alias("src"), "term", F.row_number().over(by).cast("long").alias("rank")) for i, m in enumerate((tf_idf(spark, sf), sentiment(spark, sf)))]
    return parts[0].unionByName(parts[1]).where(F.col("rank") <= N_FEATURES // 2)


@query("feature_select_mixed_by_tfidf", f"""WITH {LAB}, {TERM}, {SENT.replace("md AS", "md_ AS").replace("JOIN md USING", "JOIN md_ USING")},
tw AS (SELECT user_id, cand.term, c, (s.term IS NOT NULL)::INT AS twin FROM cand LEFT JOIN (SELECT DISTINCT term FROM sv) s USING (term)),
cu AS (SELECT *, sum(1 + twin) OVER (PARTITION BY user_id ORDER BY c) AS size FROM tw)
SELECT user_id, term, c AS rank, twin, size::BIGINT AS size FROM cu WHERE size - 1 - twin < 10""")
def feature_select_mixed_by_tfidf(spark, sf):
    """TF-IDF features in order, each with its sentiment twin where there is one, until N are reached (may exceed by one)."""
    w, _ = weighted(spark, sf)
    twins = sentiment(spark, sf).select("term").distinct().withColumn("has", F.lit(1))
    ranked = term_sums(w).select("user_id", "term", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("mag"), "term")).alias("rank")).where(F.col("rank") <= N_FEATURES)
    t = ranked.join(twins, "term", "left").withColumn("twin", F.coalesce("has", F.lit(0)))
    size = F.sum(1 + F.col("twin")).over(Window.partitionBy("user_id").orderBy("rank"))
    return t.withColumn("size", size).where(F.col("size") - 1 - F.col("twin") < N_FEATURES).select("user_id", "term", F.col("rank").cast("long").alias("rank"), "twin", "size")


_SENT_LAB = f"""{SENT.replace("md AS", "md_ AS").replace("JOIN md USING", "JOIN md_ USING")}"""


@query("feature_select_sentiment_paired", f"WITH {LAB}, {_SENT_LAB}, {TERM.replace('FROM wl', 'FROM (SELECT user_id, good, doc_id, term, weight FROM sv JOIN lb USING (doc_id))')} SELECT user_id, 1 AS src, term, rank FROM sel")
def feature_select_sentiment_paired(spark, sf):
    return determine_features(spark, sf, "sentiment", "paired").select("user_id", "src", "term", "rank")


@query("feature_select_both_unpaired", f"""WITH {LAB}, {_SENT_LAB}, wb AS (SELECT 0 AS src, user_id, good, term, weight FROM wl UNION ALL SELECT 1, user_id, good, term, weight FROM sv JOIN lb USING (doc_id))
SELECT user_id, src, good, term, rank FROM (SELECT src, user_id, good, term, row_number() OVER (PARTITION BY src, user_id, good ORDER BY round(sum(abs(weight)), 6) DESC, term) AS rank FROM wb GROUP BY 1, 2, 3, 4) WHERE rank <= 5""")
def feature_select_both_unpaired(spark, sf):
    return determine_features(spark, sf, "both", "unpaired")


@query("training_features", f"WITH {LAB}, {TERM} SELECT user_id, rank, term, good, count(*) AS n_docs, count(*) FILTER (x <> 0) AS n_with, round(sum(x), 6) AS total FROM (SELECT lb.user_id, lb.good, sel.term, sel.rank, coalesce(t.weight, 0) AS x FROM lb JOIN sel USING (user_id) LEFT JOIN tfidf t ON t.doc_id = lb.doc_id AND t.term = sel.term) GROUP BY 1, 2, 3, 4")
def training_features(spark, sf):
    """A report of the features that teach: per user, feature and class the documents, those with the feature, and its weight."""
    g = grid(*selected(spark, sf))
    return g.groupBy("user_id", "rank", "term", "good").agg(F.count("*").alias("n_docs"), F.count_if(F.col("weight") != 0).alias("n_with"), F.round(F.sum("weight"), 6).alias("total"))


@query("feature_overlap_dedup", f"WITH {LAB}, {_UNPAIRED} SELECT DISTINCT user_id, term FROM un")
def feature_overlap_dedup(spark, sf):
    return top_by_class(weighted(spark, sf)[0]).select("user_id", "term").distinct()


@query("feature_concat", f"WITH {LAB}, {_UNPAIRED} SELECT user_id, good, term FROM un WHERE good = 0 UNION ALL SELECT user_id, good, term FROM un WHERE good = 1")
def feature_concat(spark, sf):
    top = top_by_class(weighted(spark, sf)[0]).select("user_id", "good", "term")
    return top.where("good = 0").unionByName(top.where("good = 1"))


@query("feature_cutoffs", f"WITH {LAB}, {TERM} SELECT user_id, term, round((mean_good + mean_bad) / 2, 6) AS cutoff, round(mean_good - mean_bad, 6) <= 0 AS is_max FROM sel")
def feature_cutoffs(spark, sf):
    return with_cutoffs(selected(spark, sf)[2]).select("user_id", "term", F.round("cutoff", 6).alias("cutoff"), "is_max")


def with_cutoffs(features: DataFrame) -> DataFrame:
    """The midpoint of the class means; is_max: the feature is on at or below it."""
    return features.withColumn("cutoff", (F.col("mean_good") + F.col("mean_bad")) / 2).withColumn("is_max", F.round(F.col("mean_good") - F.col("mean_bad"), 6) <= 0)


def grid(w: DataFrame, lab: DataFrame, features: DataFrame) -> DataFrame:
    """Each user's documents times its selected features, with explicit zeros."""
    cell = lab.join(features, "user_id")
    return cell.join(w.select("doc_id", "term", "weight"), ["doc_id", "term"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


GRID = "g AS (SELECT lb.user_id, lb.doc_id, lb.good, sel.term, sel.rank, sel.mean_good, sel.mean_bad, coalesce(t.weight, 0) AS x FROM lb JOIN sel USING (user_id) LEFT JOIN tfidf t ON t.doc_id = lb.doc_id AND t.term = sel.term)"
_BIN = "b AS (SELECT *, CASE WHEN round(mean_good - mean_bad, 6) <= 0 THEN round(x - (mean_good + mean_bad) / 2, 9) <= 0 ELSE round(x - (mean_good + mean_bad) / 2, 9) > 0 END AS f FROM g)"


def binary_vectors(spark, sf) -> DataFrame:
    """user_id, doc_id, good, vector: a string of 0 and 1 in feature order."""
    w, lab, sel = selected(spark, sf)
    below = F.round(F.col("weight") - F.col("cutoff"), 9) <= 0
    on = F.when(F.col("is_max"), below).otherwise(~below).cast("int").cast("string")
    return grid(w, lab, with_cutoffs(sel)).groupBy("user_id", "doc_id", "good").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("rank", on.alias("f")))), lambda s: s["f"])).alias("vector"))


@query("feature_vectors_binary", f"WITH {LAB}, {TERM}, {GRID}, {_BIN} SELECT user_id, doc_id, good, string_agg(f::INT::VARCHAR, '' ORDER BY rank) AS vector FROM b GROUP BY 1, 2, 3")
def feature_vectors_binary(spark, sf):
    return binary_vectors(spark, sf)


@query("feature_vectors_scaled", f"WITH {LAB}, {TERM}, {GRID} SELECT user_id, doc_id, term, round(coalesce(x / nullif(sum(x) OVER (PARTITION BY user_id, doc_id), 0), 0), 6) AS value FROM g")
def feature_vectors_scaled(spark, sf):
    total = F.sum("weight").over(Window.partitionBy("user_id", "doc_id"))
    return grid(*selected(spark, sf)).select("user_id", "doc_id", "term", F.round(F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)), 6).alias("value"))


@query("identical_vectors", f"WITH {LAB}, {TERM}, {GRID}, {_BIN} SELECT user_id, vector, count(*) AS n FROM (SELECT user_id, doc_id, string_agg(f::INT::VARCHAR, '' ORDER BY rank) AS vector FROM b GROUP BY 1, 2) GROUP BY 1, 2")
def identical_vectors(spark, sf):
    return binary_vectors(spark, sf).groupBy("user_id", "vector").agg(F.count("*").alias("n"))


_NB = "nbp AS (SELECT user_id, good, term, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-12 THEN 0.05 ELSE stddev_pop(x) END AS sd FROM g GROUP BY 1, 2, 3)"


def nb_params(g: DataFrame) -> DataFrame:
    sd = F.stddev_pop("weight")
    return g.groupBy("user_id", "good", "term").agg(F.avg("weight").alias("mean"), F.when(sd < 1e-12, 0.05).otherwise(sd).alias("sd"))


@query("naive_bayes_params", f"WITH {LAB}, {TERM}, {GRID}, {_NB} SELECT user_id, good, term, round(mean, 6) AS mean, round(sd, 6) AS sd FROM nbp")
def naive_bayes_params(spark, sf):
    return nb_params(grid(*selected(spark, sf))).select("user_id", "good", "term", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_NBP = f"""{LAB}, {TERM}, {GRID}, {_NB},
pd AS (SELECT g.user_id, doc_id, g.good AS actual, nbp.good AS class, exp(greatest(-700, -pow(x - mean, 2) / (2 * sd * sd))) / (sd * sqrt(2 * pi())) AS p, -pow(x - mean, 2) / (2 * sd * sd) < -700 AS under FROM g JOIN nbp ON nbp.user_id = g.user_id AND nbp.term = g.term),
ll AS (SELECT user_id, doc_id, actual, sum(CASE WHEN under THEN -10000 ELSE ln(p) END) FILTER (class = 1) + ln(0.5) AS lg, sum(CASE WHEN under THEN -10000 ELSE ln(p) END) FILTER (class = 0) + ln(0.5) AS lb FROM pd GROUP BY 1, 2, 3),
np AS (SELECT user_id, doc_id, actual, 1 / (1 + exp(least(700, greatest(-700, lb - lg)))) AS prob_good FROM ll
  UNION ALL SELECT user_id, doc_id, good, CASE WHEN n_bad = 0 THEN 1.0 ELSE 0.0 END FROM lb JOIN nc USING (user_id) WHERE n_bad = 0 OR n_good = 0)"""


def nb_predictions(spark, sf, smoothed: bool = False) -> DataFrame:
    """user_id, doc_id, actual, prob_good. Users of one class get 1 or 0; an underflowing density counts -10000.

    smoothed: the class prior is (class size + 1) / (documents + 2), else 0.5 for both.
    """
    w, lab, sel = selected(spark, sf)
    g = grid(w, lab, sel)
    p = nb_params(g).withColumnRenamed("good", "class")
    z = -F.pow(F.col("weight") - F.col("mean"), F.lit(2)) / (2 * F.col("sd") * F.col("sd"))
    log_p = F.when(z < -700, -10000.0).otherwise(F.ln(F.exp(z) / (F.col("sd") * np.sqrt(2 * np.pi))))
    both = g.select("user_id", "doc_id", "good", "term", "weight").join(p, ["user_id", "term"])
    ll = both.groupBy("user_id", "doc_id", F.col("good").alias("actual")).agg(*[F.sum(F.when(F.col("class") == c, log_p)).alias(n) for c, n in ((1, "lg"), (0, "lb"))])
    if smoothed:
        ll = ll.join(class_sizes(lab), "user_id").withColumns({"lg": F.col("lg") + F.ln(F.col("n_good") + 1), "lb": F.col("lb") + F.ln(F.col("n_bad") + 1)})
    gap = F.least(F.lit(700.0), F.greatest(F.lit(-700.0), F.col("lb") - F.col("lg")))
    two = ll.select("user_id", "doc_id", "actual", (1 / (1 + F.exp(gap))).alias("prob_good"))
    one = lab.join(class_sizes(lab).where("n_good = 0 or n_bad = 0"), "user_id").select("user_id", "doc_id", F.col("good").alias("actual"), F.when(F.col("n_bad") == 0, 1.0).otherwise(0.0).alias("prob_good"))
    return two.unionByName(one)


@query("naive_bayes_predict", f"WITH {_NBP} SELECT user_id, doc_id, actual, round(prob_good, 4) AS prob_good FROM np")
def naive_bayes_predict(spark, sf):
    return nb_predictions(spark, sf).select("user_id", "doc_id", "actual", F.round("prob_good", 4).alias("prob_good"))


@query("naive_bayes_smoothed", f"WITH {_NBP.replace('SELECT user_id, doc_id, actual, 1 / (1 + exp(least(700, greatest(-700, lb - lg)))) AS prob_good FROM ll', 'SELECT user_id, doc_id, actual, 1 / (1 + exp(least(700, greatest(-700, lb + ln(n_bad + 1) - lg - ln(n_good + 1))))) AS prob_good FROM ll JOIN nc USING (user_id)')} SELECT user_id, doc_id, actual, round(prob_good, 4) AS prob_good FROM np")
def naive_bayes_smoothed(spark, sf):
    """With Laplace's class prior, (class size + 1) / (documents + 2)."""
    return nb_predictions(spark, sf, smoothed=True).select("user_id", "doc_id", "actual", F.round("prob_good", 4).alias("prob_good"))


@query("user_result_summary", f"WITH {_NBP} SELECT user_id, sum(actual)::BIGINT AS n_good, count(*) AS n, round(avg(((prob_good > 0.5) = (actual = 1))::INT), 6) AS fraction_correct FROM np GROUP BY 1")
def user_result_summary(spark, sf):
    hit = ((F.col("prob_good") > 0.5) == (F.col("actual") == 1)).cast("int")
    return nb_predictions(spark, sf).groupBy("user_id").agg(F.sum("actual").alias("n_good"), F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("fraction_correct"))


_HY = f"""{_PRED_30}, cf AS (SELECT item_id, avg(CASE WHEN pred <= 2.5 THEN 100 / 3.0 * pred - 100 / 3.0 ELSE 20 * pred END) AS cf FROM pr WHERE metric = 'cos' GROUP BY 1),
{_NBP}, hy AS (SELECT doc_id, actual, cf, prob_good AS cb, cf / 100 * 0.5 + prob_good * 0.5 AS blend FROM np JOIN cf ON cf.item_id = np.doc_id)"""


def hybrid(spark, sf) -> DataFrame:
    """doc_id, actual, cf (mean confidence of the item), cb (content probability), blend."""
    cf = predicted(spark, sf, (30,), ("F",)).where("metric = 'cos'").groupBy(F.col("item_id").alias("doc_id")).agg(F.avg(confidence(F.col("pred"))).alias("cf"))
    return nb_predictions(spark, sf).join(cf, "doc_id").select("doc_id", "actual", "cf", F.col("prob_good").alias("cb"), (F.col("cf") / 100 * 0.5 + F.col("prob_good") * 0.5).alias("blend"))


@query("hybrid_blend", f"WITH {_HY} SELECT doc_id, actual, round(cf + 1e-9, 4) AS cf, round(cb + 1e-9, 4) AS cb, round(blend + 1e-9, 4) AS blend FROM hy")
def hybrid_blend(spark, sf):
    return hybrid(spark, sf).select("doc_id", "actual", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("cf", "cb", "blend")])


@query("hybrid_confusion", f"WITH {_HY}, c AS (SELECT count(*) AS n, count(*) FILTER (blend > 0.5 AND actual = 1) AS tp, count(*) FILTER (blend > 0.5 AND actual = 0) AS fp, count(*) FILTER (blend <= 0.5 AND actual = 1) AS fn, count(*) FILTER (blend <= 0.5 AND actual = 0) AS tn FROM hy) SELECT *, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c")
def hybrid_confusion(spark, sf):
    return hybrid(spark, sf).agg(*cells(F.col("blend") > 0.5, F.col("actual") == 1)).select("*", *rates())


def patterns(spark, sf) -> DataFrame:
    """user_id, vector, good, n: at most 2 * 2**N_FEATURES rows a user, however many documents it has."""
    return counted(binary_vectors(spark, sf))


def counted(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("user_id", "vector", "good").agg(F.count("*").alias("n"))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights and intercept of an L2-penalised logistic regression on counted rows; the intercept is free."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.diag([*np.ones(x.shape[1]) / c, 1e-9])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (n * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_scaling(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (classes x features) by generalised iterative scaling: log ratios of empirical to expected counts."""
    f = np.concatenate([x, (x.shape[1] - x.sum(1))[:, None]], 1)  # rows sum to one constant
    top = f.sum(1).max()
    w = np.zeros((2, f.shape[1]))
    seen = np.stack([(n * (y == k))[:, None] * f for k in (0, 1)]).sum(1) + 1e-3
    for _ in range(rounds):
        s = f @ w.T
        p = np.exp(s - s.max(1)[:, None])
        p /= p.sum(1)[:, None]
        expected = np.stack([(n * p[:, k])[:, None] * f for k in (0, 1)]).sum(1) + 1e-3
        step = np.log(seen / expected) / top
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _by_user(probability):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[float(c) for c in v] for v in pdf["vector"]])
        return pdf[["user_id", "vector", "good", "n"]].assign(prob_good=np.round(probability(x, pdf["good"].to_numpy(float), pdf["n"].to_numpy(float)), 6))

    return run


_PATTERN = "user_id string, vector string, good int, n long, prob_good double"


@query("maxent_predict")
def maxent_predict(spark, sf):
    """Logistic regression per user over counted patterns of binary features."""
    return patterns(spark, sf).groupBy("user_id").applyInPandas(_by_user(lambda x, y, n: 1 / (1 + np.exp(-(np.concatenate([x, np.ones((len(x), 1))], 1) @ fit_logistic(x, y, n))))), _PATTERN)


@query("maxent_iis")
def maxent_iis(spark, sf):
    """Iterative scaling per user over the same patterns."""

    def probability(x, y, n):
        w = fit_scaling(x, y, n)
        f = np.concatenate([x, (x.shape[1] - x.sum(1))[:, None]], 1)
        return 1 / (1 + np.exp(f @ (w[0] - w[1])))

    return patterns(spark, sf).groupBy("user_id").applyInPandas(_by_user(probability), _PATTERN)


@query("maxent_linear_predict", f"WITH {LAB}, {TERM}, {GRID}, {_BIN} SELECT user_id, doc_id, round(1 / (1 + exp(-sum(CASE WHEN f THEN 1.0 / rank ELSE -0.5 / rank END))), 6) AS prob_good FROM b GROUP BY 1, 2")
def maxent_linear_predict(spark, sf):
    """Softmax of two linear scores under fixed weights: 1 / rank if a feature is on, else -0.5 / rank."""
    bits = F.transform(F.split("vector", ""), lambda c: c)
    score = F.aggregate(F.zip_with(bits, F.sequence(F.lit(1), F.length("vector")), lambda b, i: F.when(b == "1", 1.0 / i).otherwise(-0.5 / i)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return binary_vectors(spark, sf).select("user_id", "doc_id", F.round(1 / (1 + F.exp(-score)), 6).alias("prob_good"))


def maxent_weights(patterns: DataFrame) -> DataFrame:
    """user_id, class, place (features from 1, then the slack feature), weight: trained by scaling from zero weights."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([[float(c) for c in v] for v in pdf["vector"]])
        w = fit_scaling(x, pdf["good"].to_numpy(float), pdf["n"].to_numpy(float))
        return pd.DataFrame([(pdf["user_id"].iloc[0], k, j + 1, float(v)) for k, row in enumerate(w) for j, v in enumerate(row)], columns=["user_id", "class", "place", "weight"])

    return patterns.groupBy("user_id").applyInPandas(train, "user_id string, class int, place int, weight double")


def linear_scores(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id, doc_id, prob_good: the softmax of each class's sum of weights of the features that are on.

    A user's weights are one map by place, so that a document stays one row.
    """
    lead = F.sum(F.when(F.col("class") == 1, F.col("weight")).otherwise(-F.col("weight")))
    by_user = weights.groupBy("user_id", "place").agg(lead.alias("lead")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "lead"))).alias("leads"))

    def of(place: Column) -> Column:
        return F.coalesce(F.try_element_at("leads", place.cast("int")), F.lit(0.0))

    bits = F.filter(F.split("vector", ""), lambda c: c != "")
    on = F.aggregate(F.transform(bits, lambda b, i: b.cast("double") * of(i + 1)), F.lit(0.0), lambda t, v: t + v)
    slack = F.aggregate(bits, F.lit(0.0), lambda t, b: t + 1 - b.cast("double")) * of(F.length("vector") + 1)
    return vectors.join(by_user, "user_id").select("user_id", "doc_id", F.round(1 / (1 + F.exp(-(on + slack))), 6).alias("prob_good"))


@query("maxent_trained_predict")
def maxent_trained_predict(spark, sf):
    """Class probabilities of every labelled document under trained weights."""
    vectors = materialize(binary_vectors(spark, sf), "binary-vectors")
    return linear_scores(vectors, maxent_weights(counted(vectors)))
