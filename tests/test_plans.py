"""A document's scores come from one row."""

from shelfmark.operators import profile


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_keep_a_document_as_one_row(spark):
    vectors = spark.createDataFrame([("a", 1, "10")], "user_id string, doc_id long, vector string")
    weights = spark.createDataFrame([("a", 1, 1, 0.5)], "user_id string, class int, place int, weight double")
    assert "Generate" not in plan(profile.linear_scores(vectors, weights))
