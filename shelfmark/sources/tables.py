"""Readers: the engine's Parquet tables and the flat-file formats of rating and text collections."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATING_CSV = T.StructType([T.StructField("row_id", T.IntegerType()), T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("rating", T.DoubleType())])
REVIEW_JSON = T.StructType([T.StructField("asin", T.StringType()), T.StructField("reviewerID", T.StringType()), T.StructField("overall", T.DoubleType()), T.StructField("reviewText", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rating: user_id, item_id, rating 1..5, and the columns that together identify the row."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return both.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (1 + (F.col("l_quantity") - 1) % 5).alias("rating"), "l_orderkey", "l_linenumber", "l_quantity")


def rating_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rating events: row_id,user,item,rating."""
    return spark.read.schema(RATING_CSV).csv(path).select("user_id", "item_id", "rating")


def sorted_rating_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted rating files with a header line that holds user_id; blank lines are skipped, ids padded to ten places."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.contains(F.col("value"), F.lit("user_id")))
    part = F.split(F.replace(F.trim("value"), F.lit('"'), F.lit("")), ",")
    return lines.select(F.trim(part[1]).alias("user_id"), pad_id(F.trim(part[2])).alias("item_id"), F.try_to_number(F.trim(part[3]), F.lit("999.99")).cast("double").alias("rating"))


def user_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines `user: (item, rating); (item, rating); ` as one row per rating."""
    lines = spark.read.text(path).where(F.contains(F.col("value"), F.lit(":")))
    user = F.trim(F.substring_index("value", ":", 1))
    return parse_user_lines(lines.select(user.alias("user_id"), F.expr("substring(value, locate(':', value) + 1)").alias("line")))


def parse_user_lines(lines: DataFrame) -> DataFrame:
    """(user_id, line) with `(item, rating); ` entries -> user_id, item_id, rating."""
    entry = F.explode(F.filter(F.split("line", ";"), lambda x: F.trim(x) != ""))
    body = F.btrim(F.trim(F.col("entry")), F.lit("()"))
    return lines.select("user_id", entry.alias("entry")).select("user_id", F.trim(F.split(body, ",")[0]).alias("item_id"), F.trim(F.split(body, ",")[1]).cast("double").alias("rating"))


def review_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEW_JSON).json(path).where("asin is not null")


def raw_asins(spark: SparkSession, path: str) -> DataFrame:
    """Item ids cut from raw JSON lines without parsing them."""
    return spark.read.text(path).select(F.regexp_extract("value", '"asin": "(.{10})"', 1).alias("item_id")).where("item_id <> ''")


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("item_id")).where("item_id <> ''")


def first_field_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Item ids in the first field of a CSV file in a legacy encoding."""
    return spark.read.option("encoding", encoding).csv(path).select(pad_id(F.trim("_c0")).alias("item_id"))


def nested_documents(spark: SparkSession, path: str) -> DataFrame:
    """One-line literals of sentences of words: [['a', 'b'], ['c']]."""
    options = {"allowSingleQuotes": "true"}
    return spark.read.text(path).select(F.from_json("value", "array<array<string>>", options).alias("sentences"))


def subset_csv(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Headerless user,item,rating rows whose item is in ids (item_id)."""
    rows = spark.read.schema("user_id string, item_id string, rating double").csv(path)
    return rows.join(ids.select("item_id").distinct(), "item_id", "left_semi").select("user_id", "item_id", "rating")


def header_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header line; types from the data, blanks around names and values cut."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.toDF(*(c.strip() for c in rows.columns))


def index_literal(spark: SparkSession, path: str) -> DataFrame:
    """One-line literals {'key': 0, 'other': 1} as rows key, idx."""
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    pairs = spark.read.text(path).select(F.from_json("value", "map<string,long>", options).alias("m"))
    return pairs.select(F.explode("m").alias("key", "idx"))


def npz_triples(spark: SparkSession, path: str) -> DataFrame:
    """Compressed sparse rows (data, indices, indptr, shape) in .npz files as file, row, col, value; each file is one task's."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    rows = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(z["indices"].astype(np.int64)), pa.array(z["data"].astype(np.float64))], ["file", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "file string, row long, col long, value double")


def rating_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `1: 3`."""
    return spark.read.text(path).select(F.substring_index("value", ":", 1).cast("int").alias("id"), F.trim(F.substring_index("value", ":", -1)).cast("int").alias("rating")).where("id is not null")


def described_items(spark: SparkSession, path: str) -> DataFrame:
    """Lines `ISBN<id>: <description>`."""
    at = r"^ISBN(\w+): (.*)$"
    return spark.read.text(path).select(F.regexp_extract("value", at, 1).alias("item_id"), F.regexp_extract("value", at, 2).alias("description")).where("item_id <> ''")


def vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines `1: [4, 3, 1, 1]`."""
    return spark.read.text(path).select(F.substring_index("value", ":", 1).cast("int").alias("id"), F.from_json(F.trim(F.substring_index("value", ":", -1)), "array<int>").alias("vector"))


def description_of(payload: Column) -> Column:
    """The description in a book search response, null where there is none."""
    return F.when(F.get_json_object(payload, "$.totalItems").cast("int") > 0, F.get_json_object(payload, "$.items[0].volumeInfo.description"))


def xml_description(payload: Column) -> Column:
    """book/description of an XML response; null where it is empty."""
    return F.nullif(F.trim(F.xpath_string(payload, F.lit("*/book/description"))), F.lit(""))


def pad_id(c: Column) -> Column:
    """Left-pads ids to ten places with zeros; longer ones stay as they are."""
    return F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c)


def strip_id(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))
