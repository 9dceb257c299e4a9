"""Quality rules of catalog rows, versions and the snapshot of a day.

R1 exact copies, R2 several different rows of one (ID, RunDate), R3 an end before its start, R4 an ID that does not have 13 characters.
Copies are flagged; rows with a reason are quarantined, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions import jalali
from tarazu.functions.text import fold_label
from tarazu.sources.tables import CATALOG_COLUMNS


def row_digest(columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's fields, nulls and empty fields alike."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("")) for c in columns or CATALOG_COLUMNS)), 256)


def extra_copies(catalog: DataFrame) -> DataFrame:
    """``row_n`` of every row that equals an earlier one in all ten columns.

    The first of each group is found by a partial aggregate on the row's digest, so a row that was delivered a billion times is one
    row a task; the rest is an anti-join on the unique row number.
    """
    first = catalog.groupBy(row_digest().alias("d")).agg(F.min("row_n").alias("row_n")).select("row_n")
    return catalog.select("row_n").join(first, "row_n", "left_anti")


def classify(catalog: DataFrame) -> DataFrame:
    """The catalog with ``is_extra_copy`` and ``reasons`` (of R2, R3, R4, in this order; null for an extra copy).

    A null or empty end is open.  Nulls in other columns are values like any other; a null ID has no 13 characters.
    """
    first = catalog.groupBy(row_digest().alias("d")).agg(F.min("row_n").alias("row_n"), F.first("ID").alias("ID"), F.first("RunDate").alias("RunDate"))
    keyed = first.select("row_n", F.coalesce("ID", F.lit("")).alias("__id"), F.coalesce("RunDate", F.lit("")).alias("__run"))
    conflicts = keyed.groupBy("__id", "__run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id", "__run", F.lit(True).alias("r2"))
    judged = keyed.join(conflicts, ["__id", "__run"], "left").select("row_n", F.coalesce("r2", F.lit(False)).alias("r2"))
    end = F.coalesce(F.col("ExpirationDate"), F.lit(""))
    r3 = (end != "") & (F.col("RunDate") > end)
    r4 = F.coalesce(F.char_length("ID"), F.lit(0)) != 13
    reasons = F.array_compact(F.array(F.when(F.col("r2"), F.lit("R2")), F.when(r3, F.lit("R3")), F.when(r4, F.lit("R4"))))
    out = catalog.join(judged, "row_n", "left")
    copy = F.col("r2").isNull()
    return out.select(*catalog.columns, copy.alias("is_extra_copy"), F.when(~copy, reasons).alias("reasons"))


def active(classified: DataFrame) -> DataFrame:
    """Rows without a reason, each once."""
    return classified.where(~F.col("is_extra_copy") & (F.size("reasons") == 0))


def in_force(day: Column | str) -> Column:
    """Whether a catalog row holds on a day: from its start to its end, both inclusive."""
    day = F.lit(day) if isinstance(day, str) else day
    end = F.coalesce(F.col("ExpirationDate"), F.lit(""))
    return (F.col("RunDate") <= day) & ((end == "") | (day <= end))


def versions(rows: DataFrame) -> DataFrame:
    """``(row_n, sstid, title, rate, tax_status, id_type, valid_from, valid_to)``: half-open validity; the one place where a day is
    added to an end."""
    end = F.when(F.coalesce(F.col("ExpirationDate"), F.lit("")) != "", jalali.next_day(F.col("ExpirationDate")))
    return rows.select("row_n", F.col("ID").alias("sstid"), F.col("DescriptionOfID").alias("title"), F.expr("try_cast(trim(Vat) AS decimal(18,6))").alias("rate"), tax_status(F.col("Taxable")).alias("tax_status"), F.col("Type").alias("id_type"), F.col("RunDate").alias("valid_from"), end.alias("valid_to"))


def tax_status(c: Column) -> Column:
    """The category as taxable, exempt or out_of_scope; null for anything else."""
    # The three categories.
    names = {"مشمول": "taxable", "معاف": "exempt", "غیر مشمول": "out_of_scope"}
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[fold_label(c)]


def is_general(type_: Column) -> Column:
    """Whether a catalog row's type is one of the general ones."""
    return F.coalesce(type_.contains("عمومی"), F.lit(False))


def snapshot_counts(classified: DataFrame, as_of: str) -> DataFrame:
    """One row with the thirteen counts of a snapshot.  Distinct IDs are counted over one pre-aggregated row an ID."""
    has = lambda r: F.coalesce(F.array_contains("reasons", r), F.lit(False))
    kept = ~F.col("is_extra_copy")
    bad = kept & (F.size("reasons") > 0)
    good = kept & (F.size("reasons") == 0)
    n = lambda c: F.sum(c.cast("long"))
    # Copies carry no (ID, RunDate) of their own to count, so everything adds up over the pairs, then over the IDs.
    by_key = classified.groupBy("ID", "RunDate").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        n(kept).alias("rows_after_r1"),
        n(~kept).alias("r1_extra_copies"),
        F.max((kept & has("R2")).cast("long")).alias("r2_keys"),
        *(n(kept & has(r)).alias(f"{r.lower()}_rows") for r in ("R2", "R3", "R4")),
        n(kept & (F.size("reasons") > 1)).alias("rows_with_several_reasons"),
        F.max(good).alias("a"),
        F.max(bad).alias("q"),
        n(good & in_force(as_of)).alias("index_rows"),
    )
    sums = ["raw_rows", "rows_after_r1", "r1_extra_copies", "r2_keys", "r2_rows", "r3_rows", "r4_rows", "rows_with_several_reasons", "index_rows"]
    by_id = by_key.groupBy("ID").agg(*(F.sum(c).alias(c) for c in sums), F.max("a").alias("a"), F.max("q").alias("q"))
    return by_id.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums),
        F.count(F.lit(1)).alias("raw_ids"),
        F.count_if("a").alias("active_ids"),
        F.count_if(F.col("q") & ~F.col("a")).alias("quarantined_only_ids"),
        F.count_if(F.col("index_rows") > 0).alias("index_ids"),
    )


def id_status(classified: DataFrame) -> DataFrame:
    """``(sstid, is_active, is_quarantined)``: one row an ID."""
    kept = classified.where(~F.col("is_extra_copy") & F.col("ID").isNotNull())
    return kept.groupBy(F.col("ID").alias("sstid")).agg(F.max(F.size("reasons") == 0).alias("is_active"), F.max(F.size("reasons") > 0).alias("is_quarantined"))


def quarantined_only(classified: DataFrame) -> DataFrame:
    return id_status(classified).where("is_quarantined AND NOT is_active").select("sstid")


def lookup_ids(catalog: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """``(sstid, n_rows, any_in_force)`` for each distinct ID asked for; ``any_in_force`` is null if the catalog does not have it."""
    asked = ids.select("sstid").where("sstid IS NOT NULL").distinct()
    history = catalog.groupBy(F.col("ID").alias("sstid")).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(in_force(as_of)).alias("any_in_force"))
    return asked.join(history, "sstid", "left").select("sstid", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "any_in_force")


def output_rows(catalog: DataFrame, as_of: str) -> DataFrame:
    """Rows as they are shown: ``row_n``, the fields with the title on one line, and ``in_force`` (yes or no) on a day."""
    title = F.trim(F.regexp_replace("DescriptionOfID", r"(?U)\s+", " "))
    return catalog.select("row_n", F.col("ID").alias("sstid"), title.alias("title"), "Vat", "Taxable", "Type", "RunDate", "ExpirationDate", F.when(in_force(as_of), "yes").otherwise("no").alias("in_force"))


def history_rows(catalog: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """All rows of the distinct IDs asked for, as :func:`output_rows` shows them; an ID the catalog does not have gives none."""
    asked = ids.select("sstid").where("sstid IS NOT NULL").distinct()
    return output_rows(catalog, as_of).join(asked, "sstid", "left_semi")


def last_types(catalog: DataFrame) -> DataFrame:
    """``(ID, Type)``: the type that the last row of each ID has, by row number."""
    return catalog.where("ID IS NOT NULL").groupBy("ID").agg(F.max_by("Type", "row_n").alias("Type"))


def version_gaps(rows: DataFrame) -> DataFrame:
    """Consecutive versions of an ID by how the next start follows the end: next_day, gap, overlap, open.  Versions of one day are one,
    with the latest end, before the window, so that an entity has at most as many rows as days."""
    end = F.when(F.coalesce(F.col("ExpirationDate"), F.lit("")) != "", jalali.to_days(F.col("ExpirationDate")))
    days = rows.groupBy("ID", jalali.to_days(F.col("RunDate")).alias("s")).agg(F.max(F.coalesce(end, F.lit(2_000_000_000))).alias("e")).where("s IS NOT NULL")
    step = F.lead("s").over(W.partitionBy("ID").orderBy("s")) - F.col("e")
    kind = F.when(F.col("e") == 2_000_000_000, "open").when(step == 1, "next_day").when(step > 1, "gap").otherwise("overlap")
    return days.withColumn("step", step).withColumn("kind", kind).where("step IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n_pairs"))
