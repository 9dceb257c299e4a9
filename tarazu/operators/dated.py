"""Documents with a time of validity that apply to codes, and the one to cite for a code on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions import jalali

#: A file: ``{"schema_version": 1, "units": [...]}``.
UNITS_SCHEMA = "schema_version int, units array<struct<id:string,kind:string,title:string,body:string,valid_from:string,valid_to:string,source_url:string,applies_to:array<string>,status:string>>"
REVIEWED, PLACEHOLDER = "reviewed", "placeholder"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """The units of JSON files with the version they state, one row each."""
    return spark.read.schema(UNITS_SCHEMA).json(path, multiLine=True).select("schema_version", F.explode_outer("units").alias("u")).select("schema_version", "u.*")


def unit_faults(units: DataFrame, codes: list[str]) -> DataFrame:
    """``(id, fault)``: what makes a unit unusable; a table without rows if all can be used."""
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    open_ = F.col("valid_to").isNull()
    faults = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("schema_version") != 1, F.lit(True)), "schema_version"),
            F.when(F.coalesce("id", F.lit("")) == "", "no_id"),
            F.when(n > 1, "duplicate_id"),
            F.when(~jalali.is_day(F.col("valid_from")) | ~(open_ | jalali.is_day(F.col("valid_to"))), "bad_day"),
            F.when(~open_ & (F.col("valid_to") < F.col("valid_from")), "ends_before_start"),
            F.when(~F.coalesce(F.col("status"), F.lit("")).isin(REVIEWED, PLACEHOLDER), "bad_status"),
            F.when((F.col("status") == REVIEWED) & (F.coalesce("source_url", F.lit("")) == ""), "no_source"),
            F.when(F.size(F.coalesce(F.array_except("applies_to", F.array(*(F.lit(c) for c in codes))), F.array(F.lit("?")))) > 0, "unknown_code"),
        )
    )
    return units.select("id", faults.alias("f")).select("id", F.explode("f").alias("fault"))


def cite(findings: DataFrame, code: str, day: str, units: DataFrame) -> DataFrame:
    """``findings`` with ``unit_id`` and ``is_placeholder``: of the units that apply to the code and are valid on the day (both ends inclusive)
    reviewed ones come first, then the smallest id; null if there is none.  Findings with a null code or day have none.

    The choice is made once for each (code, day), which are few, so no finding meets more than one row.
    """
    by_code = units.select(F.explode("applies_to").alias("__code"), "valid_from", "valid_to", F.struct((F.col("status") != REVIEWED).alias("placeholder"), F.col("id").alias("id")).alias("u"))
    asked = findings.select(F.col(code).alias("__code"), F.col(day).alias("__day")).where("__code IS NOT NULL AND __day IS NOT NULL").distinct()
    holds: Column = (F.col("valid_from") <= F.col("__day")) & (F.col("valid_to").isNull() | (F.col("__day") <= F.col("valid_to")))
    best = asked.join(by_code, "__code").where(holds).groupBy("__code", "__day").agg(F.min("u").alias("u"))
    keyed = findings.withColumns({"__code": F.col(code), "__day": F.col(day)}).drop("unit_id", "is_placeholder")
    return keyed.join(best, ["__code", "__day"], "left").withColumns({"unit_id": F.col("u.id"), "is_placeholder": F.col("u.placeholder")}).drop("__code", "__day", "u")
