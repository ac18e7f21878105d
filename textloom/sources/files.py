"""Sources and sinks of documents and query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line: doc_id, text. Ids follow the order of files and lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def query_set(spark: SparkSession, path: str, schema: str = "kind string, q string, target long") -> DataFrame:
    """A tab-separated set of queries, taken as it stands (no quoting)."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def posts_xml(spark: SparkSession, path: str) -> DataFrame:
    """Posts from <row .../> lines of an XML dump: doc_id, text without markup, entities resolved."""
    row = spark.read.text(path).filter(F.trim("value").startswith("<row "))
    attribute = lambda name: F.regexp_extract("value", rf'\s{name}="([^"]*)"', 1)

    def unescape(c):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#xA;", "\n"), ("&#xD;", "\r"), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(char))
        return c

    # the body is HTML inside an attribute: resolved once as XML, stripped of tags, resolved as HTML
    body = unescape(F.regexp_replace(unescape(attribute("Body")), r"<[^>]*>", " "))
    title = unescape(attribute("Title"))
    text = F.trim(F.regexp_replace(F.concat_ws(" ", title, body), r"\s+", " "))
    return row.select(attribute("Id").cast("long").alias("doc_id"), text.alias("text")).filter("doc_id IS NOT NULL")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("quote", "").csv(path)
