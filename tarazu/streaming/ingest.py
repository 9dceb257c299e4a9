"""Records that arrive as a stream: parsed, freed of repeated deliveries, joined with the version in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarazu.operators.parse import RecordSchema, row_reasons, split_records


def first_deliveries(lines: DataFrame, key: str, arrived: str, delay: str = "30 days") -> DataFrame:
    """A stream of lines without those that came before, as far back as the watermark goes.  Rows that come later than that are dropped by the
    watermark; null arrival times never are late and never repeat."""
    return lines.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])


def with_version(lines: DataFrame, versions: DataFrame, key: Column, day: Column) -> DataFrame:
    """A stream of lines with the versions in force, by a stream-static join on the ID with the validity as residual condition."""
    v = versions.select(F.col("sstid").alias("__v"), "valid_from", "valid_to", "rate")
    holds = (key == F.col("__v")) & (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
    return lines.join(v, holds, "left").drop("__v")


def split_to(records: DataFrame, record: str, schema: RecordSchema, loaded: str, rejected: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes the good and the bad records of a stream to two Parquet folders, each exactly once: a batch goes to a folder of its own number, which
    a repeated batch overwrites."""

    def write(batch: DataFrame, n: int) -> None:
        good, bad = split_records(batch.persist(), record, schema)
        good.write.mode("overwrite").parquet(f"{loaded}/batch={n}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        batch.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reasons_by_window(records: DataFrame, record: str, schema: RecordSchema, arrived: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """``(window, reason, n)``: bad records by reason and time of arrival."""
    bad = records.withWatermark(arrived, delay).select(arrived, F.explode(row_reasons(F.col(record), schema)).alias("reason"))
    return bad.groupBy(F.window(arrived, width), "reason").agg(F.count(F.lit(1)).alias("n"))
