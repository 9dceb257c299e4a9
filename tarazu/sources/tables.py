"""The tables of a data folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_COLUMNS = ["ID", "DescriptionOfID", "Vat", "Taxable", "RunDate", "ExpirationDate", "CreateDate", "LastEditDate", "Type", "PricingDescription"]
LINE_COLUMNS = ["line_id", "issue_date", "sstid", "sstt", "am", "mu", "fee", "vra", "vam", "labels"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def both_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """The specific and the general section of the catalog; ``row_n`` is unique over both."""
    return table(spark, folder, "fake_catalog").unionByName(table(spark, folder, "fake_catalog_general"))


def is_id(c):
    """13 ASCII digits; false for null."""
    return F.coalesce(c.rlike(r"\A[0-9]{13}\z"), F.lit(False))
