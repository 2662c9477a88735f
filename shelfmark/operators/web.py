"""Web and response operators: JSON and XML paths, HTML extraction, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table, xml_description


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("xml_path", "SELECT p_partkey, nullif(trim(p_name), '') AS description FROM part")
def xml_path(spark, sf):
    """A description out of an XML response."""
    payload = F.concat(F.lit("<Response><book><description> "), F.col("p_name"), F.lit(" </description></book></Response>"))
    return table(spark, sf, "part").select("p_partkey", xml_description(payload).alias("description"))


@query("html_title", "SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '') AS heading FROM pages")
def html_title(spark, sf):
    def tag(t):
        return F.nullif(F.regexp_extract("html", f"(?is)<{t}[^>]*>(.*?)</{t}>", 1), F.lit(""))

    return table(spark, sf, "pages").select("page_id", tag("title").alias("title"), tag("h1").alias("heading"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS scheme, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS host, regexp_extract(url, '^\\w+://[^/?#]+([^?#]*)', 1) AS path, TRY_CAST(nullif(regexp_extract(url, '\\d+', 0), '') AS BIGINT) AS number FROM pages")
def url_parts(spark, sf):
    part = lambda p, g: F.regexp_extract("url", p, g)
    return table(spark, sf, "pages").select("page_id", part(r"^(\w+)://", 1).alias("scheme"), part(r"^\w+://([^/?#]+)", 1).alias("host"), part(r"^\w+://[^/?#]+([^?#]*)", 1).alias("path"), F.expr(r"try_cast(nullif(regexp_extract(url, '\\d+', 0), '') as bigint)").alias("number"))


@query("paged_urls", "SELECT p_partkey, page, 'https://books.example/item/' || p_partkey || '?page=' || page AS url FROM part, (SELECT unnest(range(1, 6)) AS page)")
def paged_urls(spark, sf):
    pages = table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("page"))
    return pages.withColumn("url", F.concat(F.lit("https://books.example/item/"), F.col("p_partkey").cast("string"), F.lit("?page="), F.col("page").cast("string")))


@query("scraped_union", "SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def scraped_union(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
