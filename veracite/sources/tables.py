"""Sources: the given tables, and relations derived from them by fixed rules.

The tables hold no fetch results, so reads, headers, statuses and claims are
derived from ``pages`` by the page's number; the SQL in ``queries`` states the
same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import body_text
from ..operators.signals import with_signals

CLAIM_STARTS, CLAIM_WORDS = (50, 200, 400), 10
SHORT_WALL = "<html><body>Just a moment...</body></html>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt out to all cores where its files would occupy a few only; large tables stay as they lie."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if 2 * rows.rdd.getNumPartitions() > cores else rows.repartition(cores)


def claims_of(body: Column, page_id: Column) -> Column:
    """Ten-word windows of a page's own text, and for every third page a claim that no page holds."""
    words = F.split(body, " ")
    own = [F.when(F.size(words) >= s + CLAIM_WORDS, F.array_join(F.slice(words, s + 1, CLAIM_WORDS), " ")) for s in CLAIM_STARTS]
    absent = F.when(page_id % 3 == 1, F.concat(F.lit("no page says this sentence about number "), page_id.cast("string")))
    return F.filter(F.array(*own, absent), lambda c: c.isNotNull())


def pages_with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages").withColumn("body", body_text(F.col("html")))
    return pages.select("page_id", "url", "html", "body", claims_of(F.col("body"), F.col("page_id")).alias("claims"))


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rungs a page: ``node`` with walls, errors and odd types by number, ``curl`` plain; pages with one URL in order of their numbers."""
    pages = pages_with_claims(spark, sf_dir)
    kind = F.col("page_id") % 7
    landed = F.when(F.col("page_id") % 11 == 0, F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/"))).otherwise(F.col("url"))
    none = F.create_map().cast("map<string,string>")
    node = pages.select(
        "page_id", F.col("page_id").alias("read_ord"), "url", F.lit("node").alias("rung"), F.lit(0).alias("rung_ord"),
        F.when(kind == 0, 404).otherwise(200).alias("status"),
        F.when(kind == 1, F.create_map(F.lit("CF-Mitigated"), F.lit("challenge"))).when(kind == 3, F.create_map(F.lit("Content-Type"), F.lit("application/octet-stream"))).otherwise(none).alias("headers"),
        landed.alias("final_url"), F.when(kind == 2, F.lit(SHORT_WALL)).otherwise(F.col("html")).alias("raw_body"), F.lit("html").alias("body_kind"), "claims",
    )
    curl = pages.select("page_id", F.col("page_id").alias("read_ord"), "url", F.lit("curl").alias("rung"), F.lit(1).alias("rung_ord"), F.lit(200).alias("status"), none.alias("headers"), F.lit("").alias("final_url"), F.col("html").alias("raw_body"), F.lit("html").alias("body_kind"), "claims")
    return node.unionByName(curl)


def signalled_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_signals(raw_reads(spark, sf_dir))
