"""Rating preparation: scales, splits, histograms, catalogues, order and index operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.stages import materialize
from ..sources.sinks import pending, user_lines
from ..sources.tables import pad_id, parse_user_lines, ratings, strip_id, table

R = "r AS (SELECT o_custkey AS user_id, l_partkey AS item_id, 1 + (l_quantity - 1) % 5 AS rating, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
KEY = ["l_orderkey", "l_linenumber", "item_id", "l_quantity"]

SPLIT = f"""{R},
s0 AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY l_orderkey, l_linenumber, item_id, l_quantity) AS rn FROM r),
two AS (SELECT * FROM s0 WHERE n >= 3 AND rn <= 2),
rest AS (SELECT user_id, item_id, rating, min(n) AS n, arg_min(((l_orderkey * 31 + l_linenumber) % 1000) / 1000.0, rn)::DOUBLE AS u FROM s0 a
  WHERE n >= 3 AND rn > 2 AND NOT EXISTS (SELECT 1 FROM two t WHERE t.user_id = a.user_id AND t.item_id = a.item_id AND t.rating = a.rating) GROUP BY 1, 2, 3),
m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS others FROM rest),
split AS (SELECT user_id, item_id, rating, 'train' AS part FROM two
  UNION ALL SELECT user_id, item_id, rating, CASE WHEN others = 1 THEN CASE WHEN u <= 0.5 THEN 'dev' ELSE 'eval' END
    WHEN u <= (0.6::DOUBLE - 2.0::DOUBLE / n) / (1.0::DOUBLE - 2.0::DOUBLE / n) THEN 'train' WHEN u <= (0.8::DOUBLE - 2.0::DOUBLE / n) / (1.0::DOUBLE - 2.0::DOUBLE / n) THEN 'dev' ELSE 'eval' END FROM m)"""


def two_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of two sources: even users on 1..5, odd ones on 0..10 brought to 1..5 by r / 2.5 + 1."""
    r = ratings(spark, sf_dir)
    raw = F.when(F.col("user_id") % 2 == 0, F.col("rating")).otherwise(F.col("l_quantity") % 11)
    return r.select("user_id", "item_id", "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("source"), raw.alias("raw")).withColumn("rating", F.when(F.col("source") == "A", F.col("raw")).otherwise(F.col("raw") / 2.5 + 1))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating, part (train, dev, eval), for users with three ratings or more."""
    w = Window.partitionBy("user_id")
    s0 = ratings(spark, sf_dir).withColumn("rn", F.row_number().over(w.orderBy(*KEY)))
    pair = ["user_id", "item_id", "rating"]
    u = ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 1000) / F.lit(1000.0)
    # the first two of a user stay as they are; of the others, equal ones are one, and none equals those two
    first = [F.max(F.when(F.col("rn") == k, F.struct("item_id", "rating"))).over(w).alias(f"row_{k}") for k in (1, 2)]
    s0 = s0.select("*", F.count("*").over(w).alias("n"), *first).where("n >= 3")
    equal = F.col("user_id").isNotNull() & ((F.col("item_id") == F.col("row_1.item_id")) & (F.col("rating") == F.col("row_1.rating")) | (F.col("item_id") == F.col("row_2.item_id")) & (F.col("rating") == F.col("row_2.rating")))
    rest = s0.where((F.col("rn") <= 2) | ~F.coalesce(equal, F.lit(False))).withColumn("place", F.when(F.col("rn") <= 2, F.col("rn")))
    rest = rest.groupBy(*pair, "place").agg(F.min("n").alias("n"), F.min_by(u, "rn").alias("u"))
    rest = rest.withColumn("others", F.count(F.when(F.col("place").isNull(), 1)).over(w))
    free = 1.0 - 2.0 / F.col("n")
    part = (
        F.when(F.col("place").isNotNull(), "train")
        .when(F.col("others") == 1, F.when(F.col("u") <= 0.5, "dev").otherwise("eval"))
        .when(F.col("u") <= (0.6 - 2.0 / F.col("n")) / free, "train")
        .when(F.col("u") <= (0.8 - 2.0 / F.col("n")) / free, "dev")
        .otherwise("eval")
    )
    return rest.select(*pair, part.alias("part"))


_TWO = f"{R}, two AS (SELECT user_id, item_id, l_orderkey, l_linenumber, l_quantity, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, CASE WHEN user_id % 2 = 0 THEN rating ELSE l_quantity % 11 END AS raw FROM r), sc AS (SELECT *, CASE WHEN source = 'A' THEN raw ELSE raw / 2.5 + 1 END AS rating FROM two)"


@query("ratings_normalized", f"WITH {_TWO} SELECT user_id, item_id, source, raw, round(rating, 6) AS rating FROM sc")
def ratings_normalized(spark, sf):
    return two_scales(spark, sf).select("user_id", "item_id", "source", "raw", F.round("rating", 6).alias("rating"))


@query("utility_matrix", f"WITH {R} SELECT item_id, user_id, sum(rating) AS rating FROM r GROUP BY 1, 2")
def utility_matrix(spark, sf):
    return ratings(spark, sf).groupBy("item_id", "user_id").agg(F.sum("rating").alias("rating"))


@query("isbn_pad_strip", "SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 10 THEN lpad(p_partkey::VARCHAR, 10, '0') ELSE p_partkey::VARCHAR END AS padded, ltrim(lpad(p_partkey::VARCHAR, 10, '0'), '0') AS stripped FROM part")
def isbn_pad_strip(spark, sf):
    padded = pad_id(F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", padded.alias("padded"), strip_id(padded).alias("stripped"))


@query("user_rating_lines", f"WITH {R} SELECT user_id, string_agg('(' || item_id || ', ' || rating::INT || '); ', '' ORDER BY item_id, rating) AS line FROM r GROUP BY 1")
def user_rating_lines(spark, sf):
    return user_lines(ratings(spark, sf))


@query("explode_user_lines", f"WITH {R} SELECT user_id, item_id::VARCHAR AS item_id, rating FROM r")
def explode_user_lines(spark, sf):
    return parse_user_lines(user_lines(ratings(spark, sf)))


@query("distinct_users", f"WITH {R} SELECT DISTINCT user_id FROM r")
def distinct_users(spark, sf):
    return ratings(spark, sf).select("user_id").distinct()


@query("ratings_per_user_hist", f"WITH {R} SELECT n AS n_ratings, count(*) AS n_users FROM (SELECT user_id, count(*) AS n FROM r GROUP BY 1) GROUP BY 1")
def ratings_per_user_hist(spark, sf):
    return ratings(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_ratings")).groupBy("n_ratings").agg(F.count("*").alias("n_users"))


@query("users_min3", f"WITH {R} SELECT user_id, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 2")
def users_min3(spark, sf):
    return ratings(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 2")


@query("user_rating_variation", f"WITH {_TWO} SELECT user_id, count(*) AS total, count(*) FILTER (rating > 2.5) AS good FROM sc GROUP BY 1")
def user_rating_variation(spark, sf):
    return two_scales(spark, sf).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("rating") > 2.5).alias("good"))


@query("train_dev_eval_split", f"WITH {SPLIT} SELECT user_id, item_id, rating, part FROM split")
def train_dev_eval_split(spark, sf):
    return split(spark, sf)


@query("split_counts", f"WITH {SPLIT} SELECT part, count(*) AS n FROM split GROUP BY 1")
def split_counts(spark, sf):
    return split(spark, sf).groupBy("part").agg(F.count("*").alias("n"))


def _catalog(spark, sf, flag):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("item_id")).distinct()


def _returned_few(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity <= 5").select(F.col("l_partkey").alias("item_id"))


@query("catalog_intersect", "SELECT DISTINCT l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def catalog_intersect(spark, sf):
    return _catalog(spark, sf, "A").intersect(_catalog(spark, sf, "R"))


@query("catalog_except", "SELECT l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 5")
def catalog_except(spark, sf):
    return _catalog(spark, sf, "A").subtract(_returned_few(spark, sf))


@query("ratings_union", f"WITH {_TWO} SELECT source, count(*) AS n, round(avg(rating), 6) AS mean FROM sc GROUP BY 1")
def ratings_union(spark, sf):
    both = two_scales(spark, sf)
    a, b = (both.where(F.col("source") == s) for s in "AB")
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


@query("reviews_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def reviews_semi(spark, sf):
    few = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(few, "l_partkey", "left_semi")


@query("reviewer_distinct", f"WITH {R} SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_reviewers FROM r WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
def reviewer_distinct(spark, sf):
    few = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item_id"))
    return ratings(spark, sf).join(few, "item_id", "left_semi").agg(F.count("*").alias("n_reviews"), F.countDistinct("user_id").alias("n_reviewers"))


def with_previous(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """rows with last: the column's value in the row before in the whole order. Ranges of the order are tasks; each takes over the end of the one before."""
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("__p").agg(F.max_by(column, F.struct(*order)).alias("end"))
    # one row per range
    before = ends.select("__p", F.lag("end").over(Window.orderBy("__p")).alias("before"))
    within = Window.partitionBy("__p").orderBy(*order)
    first = F.row_number().over(within) == 1
    return ranged.join(F.broadcast(before), "__p").withColumn("last", F.when(first, F.col("before")).otherwise(F.lag(column).over(within))).drop("__p", "before")


@query("order_change_detect", "SELECT item_id FROM (SELECT l_partkey AS item_id, lag(l_partkey) OVER (ORDER BY l_partkey) AS last FROM lineitem) WHERE last IS NULL OR last <> item_id")
def order_change_detect(spark, sf):
    """Ids where a stream that is sorted by id changes."""
    ids = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"))
    return with_previous(ids, ["item_id"], "item_id").where("last is null or last <> item_id").select("item_id")


@query("order_violations", "SELECT l_orderkey, l_linenumber, item_id, last_id FROM (SELECT l_orderkey, l_linenumber, l_partkey AS item_id, lag(l_partkey) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS last_id FROM lineitem) WHERE item_id < last_id")
def order_violations(spark, sf):
    """Rows of a stream whose id is below that of the row before."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), "l_quantity")
    return with_previous(rows, KEY, "item_id").where("item_id < last").select("l_orderkey", "l_linenumber", "item_id", F.col("last").alias("last_id"))


def quarters(ids: DataFrame, key: str) -> DataFrame:
    """Place and quartile of each id, and rank, its place from the end of the quartile.

    The range partitions are written once with their numbers; counts per range give each its first place, so no task
    sees all rows.
    """
    ranged = materialize(ids.select(key).repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("c"))
    offsets = counts.select("__p", (F.sum("c").over(Window.orderBy("__p")) - F.col("c")).alias("offset"), F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = (F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1 + F.col("offset")).cast("long")
    placed = ranged.join(F.broadcast(offsets), "__p").select(key, place.alias("place"), "total")
    placed = placed.withColumn("quarter", F.least(F.lit(3), F.floor(F.col("place") * 4 / F.col("total"))).cast("int"))
    end = F.ceil((F.col("quarter") + 1) * F.col("total") / 4)
    return placed.select(key, "place", "quarter", (end - F.col("place")).cast("long").alias("rank"))


_Q = "q AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS place, least(3, floor((row_number() OVER (ORDER BY p_partkey) - 1) * 4.0 / count(*) OVER ()))::INT AS quarter FROM part)"


def _item_quarters(spark, sf):
    return quarters(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id")), "item_id")


@query("ntile4", f"WITH {_Q} SELECT item_id, quarter FROM q")
def ntile4(spark, sf):
    return _item_quarters(spark, sf).select("item_id", "quarter")


@query("ntile4_reversed", f"WITH {_Q} SELECT item_id, quarter, row_number() OVER (PARTITION BY quarter ORDER BY place DESC) AS rank FROM q")
def ntile4_reversed(spark, sf):
    return _item_quarters(spark, sf).select("item_id", "quarter", "rank")


@query("dense_index", f"WITH {_Q} SELECT item_id, place AS idx FROM q")
def dense_index(spark, sf):
    return _item_quarters(spark, sf).select("item_id", F.col("place").alias("idx"))


@query("running_group_counts", f"WITH {R} SELECT user_id, l_orderkey, l_linenumber, item_id, count(*) OVER w AS n, sum(rating) OVER w AS total FROM r WINDOW w AS (PARTITION BY user_id ORDER BY l_orderkey, l_linenumber, item_id, l_quantity ROWS UNBOUNDED PRECEDING)")
def running_group_counts(spark, sf):
    """The counters of the current user after each row of a stream sorted by user."""
    w = Window.partitionBy("user_id").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    return ratings(spark, sf).select("user_id", "l_orderkey", "l_linenumber", "item_id", F.count("*").over(w).alias("n"), F.sum("rating").over(w).alias("total"))


@query("inverted_index", f"WITH {R} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT user_id, item_id FROM r) GROUP BY 1")
def inverted_index(spark, sf):
    return ratings(spark, sf).groupBy("user_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("item_id")).cast("array<string>")).alias("items"))


@query("first_n", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1000")
def first_n(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(1000)


@query("head6", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 6")
def head6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(6)


@query("idempotent_pending", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 5)")
def idempotent_pending(spark, sf):
    return pending(table(spark, sf, "part").select("p_partkey"), _returned_few(spark, sf).withColumnRenamed("item_id", "p_partkey"), "p_partkey")


@query("binarize_fixed", f"WITH {R} SELECT user_id, item_id, l_orderkey, l_linenumber, (rating > 2.5)::INT AS good FROM r")
def binarize_fixed(spark, sf):
    return ratings(spark, sf).select("user_id", "item_id", "l_orderkey", "l_linenumber", (F.col("rating") > 2.5).cast("int").alias("good"))


@query("binarize_by_avg", f"WITH {R} SELECT user_id, item_id, l_orderkey, l_linenumber, (rating > avg(rating) OVER (PARTITION BY user_id))::INT AS good FROM r")
def binarize_by_avg(spark, sf):
    mean = F.avg("rating").over(Window.partitionBy("user_id"))
    return ratings(spark, sf).select("user_id", "item_id", "l_orderkey", "l_linenumber", (F.col("rating") > mean).cast("int").alias("good"))


@query("submatrix_semi", f"WITH {R} SELECT item_id, user_id, sum(rating) AS rating FROM r WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY 1, 2")
def submatrix_semi(spark, sf):
    rows = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("item_id"))
    return ratings(spark, sf).join(rows, "item_id", "left_semi").groupBy("item_id", "user_id").agg(F.sum("rating").alias("rating"))


@query("scalar_math", "SELECT l_orderkey, l_linenumber, l_quantity, round(sqrt(l_quantity), 6) AS root, round(1 / (1 + l_quantity), 6) AS similarity, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio, round(pow(l_discount, 2), 6) AS square, round(ln(l_quantity), 6) AS log_, round(exp(-l_discount), 6) AS exp_, abs(l_discount - l_tax) AS gap FROM lineitem")
def scalar_math(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(F.sqrt(q), 6).alias("root"), F.round(1 / (1 + q), 6).alias("similarity"), F.when(d != 0, F.round(t / d, 6)).alias("ratio"), F.round(F.pow(d, F.lit(2)), 6).alias("square"), F.round(F.ln(q), 6).alias("log_"), F.round(F.exp(-d), 6).alias("exp_"), F.abs(d - t).alias("gap"))


@query("date_tag", "SELECT event_id, strftime(ts, '%m%d_%H%M') AS tag, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS next_day FROM events")
def date_tag(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "MMdd_HHmm").alias("tag"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss").alias("next_day"))
