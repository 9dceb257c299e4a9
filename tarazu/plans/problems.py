"""The general data-processing problems over catalog and invoice lines: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import jalali
from tarazu.functions.text import fold_label
from tarazu.operators.asof import as_known_at
from tarazu.operators.history import attribute_history, attribute_intervals
from tarazu.operators.intervals import periods_and_gaps
from tarazu.operators.parse import Field, RecordSchema, column_reasons, split_records
from tarazu.sources.tables import CATALOG_COLUMNS, LINE_COLUMNS, both_catalogs, is_id, table


def valid_rows(catalog: DataFrame) -> DataFrame:
    """Catalog rows whose ID is 13 ASCII digits, whose start is a day and whose end is open or a day not before it, with
    ``run_day`` and ``exp_day`` (null if open) as day numbers."""
    end = F.col("ExpirationDate")
    days = catalog.where(is_id(F.col("ID")) & jalali.is_day(F.col("RunDate")))
    days = days.withColumns({"run_day": jalali.to_days(F.col("RunDate")), "exp_day": jalali.to_days(end)})
    return days.where((F.coalesce(end, F.lit("")) == "") | (F.col("exp_day") >= F.col("run_day")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_rows(table(spark, folder, "fake_catalog"))
    found = periods_and_gaps(rows, "ID", F.col("run_day"), F.col("exp_day"), at_least=2)
    return found.select(F.col("ID").alias("id"), "kind", jalali.from_days(F.col("d_from")).alias("d_from"), F.coalesce(jalali.from_days(F.col("d_to")), F.lit("")).alias("d_to"))


def _attributes() -> dict:
    return {"vat": F.expr("try_cast(trim(Vat) AS decimal(18,6))"), "taxable": fold_label(F.col("Taxable"))}


def _history_input(spark: SparkSession, folder: str) -> dict:
    rows = valid_rows(table(spark, folder, "fake_catalog"))
    return {"df": rows, "entity": "ID", "at": F.col("run_day"), "attributes": _attributes(), "rank": [F.col("LastEditDate"), -F.col("row_n")]}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    versions = attribute_history(**_history_input(spark, folder), at_least=2)
    day = lambda c: jalali.from_days(F.col(c))
    return versions.select(F.col("ID").alias("id"), day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("")).alias("valid_to"))


def p2_attribute_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Each attribute's own intervals, for every ID."""
    each = attribute_intervals(**_history_input(spark, folder))
    day = lambda c: jalali.from_days(F.col(c))
    value = F.when(F.col("attribute") == "vat", F.col("value").cast("decimal(18,6)").cast("double").cast("string")).otherwise(F.col("value"))
    return each.select(F.col("ID").alias("id"), "attribute", value.alias("value"), day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("")).alias("valid_to"))


def _with_version(spark: SparkSession, folder: str, carry: dict, attributes: dict, how: str = "inner") -> DataFrame:
    lines = table(spark, folder, "demo_invoices")
    if how == "inner":
        lines = lines.where(is_id(F.col("sstid")) & jalali.is_day(F.col("issue_date")))
    return as_known_at(
        lines,
        valid_rows(both_catalogs(spark, folder)),
        entity="sstid",
        at=jalali.to_days(F.col("issue_date")),
        version_entity="ID",
        valid_from=F.col("run_day"),
        valid_to=F.col("exp_day"),
        prefer=[-jalali.to_days(F.col("LastEditDate")), F.col("row_n")],
        carry=carry,
        attributes=attributes,
        how=how,
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _with_version(spark, folder, {"line_id": F.col("line_id")}, {"row_n": F.col("row_n")}).distinct()


def p4_enriched_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered line with the attributes of its ID on its day, or nulls."""
    carry = {k: F.col(k) for k in ("line_id", "received_at", "issue_date", "sstid")}
    attributes = {"row_n": F.col("row_n"), "catalog_vat": F.col("Vat"), "catalog_taxable": fold_label(F.col("Taxable")), "catalog_type": F.col("Type")}
    return _with_version(spark, folder, carry, attributes, how="left")


AM = Field("am", r"[0-9]{1,14}(?:\.[0-9]{1,6})?", "am")
VRA = Field("vra", r"[0-9]{1,5}(?:\.[0-9]{1,4})?", "vra")
ISSUED = Field("issue_date", jalali.DAY, "issue_date")
ID = Field("ID", "[0-9]{13}", "id")
LINE_SCHEMA = RecordSchema([{f.name: f for f in (AM, VRA, ISSUED)}.get(c, Field(c)) for c in LINE_COLUMNS])
CATALOG_SCHEMA = RecordSchema([{ID.name: ID}.get(c, Field(c)) for c in CATALOG_COLUMNS])


def split_feeds(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The loaded and the rejected records of each feed."""
    raw = table(spark, folder, "raw_records")
    return {feed: split_records(raw.where(F.col("feed") == feed), "record", schema) for feed, schema in (("demo_invoices", LINE_SCHEMA), ("fake_catalog", CATALOG_SCHEMA))}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [rejected.select(F.lit("raw_records").alias("source"), F.col("raw_id").cast("string").alias("row_key"), "reasons") for _, rejected in split_feeds(spark, folder).values()]
    for name, key, schema in (("demo_invoices", "line_id", LINE_SCHEMA), ("fake_catalog", "row_n", CATALOG_SCHEMA)):
        judged = table(spark, folder, name).select(F.lit(name).alias("source"), F.col(key).cast("string").alias("row_key"), column_reasons(schema).alias("reasons"))
        parts.append(judged.where(F.size("reasons") > 0))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("source", "row_key", F.explode("reasons").alias("reason")).distinct()


def p5_loaded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The good records of the line feed, typed."""
    loaded, _ = split_feeds(spark, folder)["demo_invoices"]
    typed = {"am": "decimal(20,6)", "vra": "decimal(9,4)"}
    return loaded.select("raw_id", *((F.col(f"fields.{c}").cast(typed[c]).cast("double") if c in typed else F.col(f"fields.{c}")).alias(c) for c in LINE_COLUMNS))


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p2_attribute_intervals, p4_found, p4_enriched_lines, p5_found, p5_loaded_lines)}


# --- The same in SQL -------------------------------------------------------------------------------------------------

_DAY = jalali.DAY.replace("'", "''")


def day_number_sql(c: str) -> str:
    """Day number of a text day, in DuckDB's SQL."""
    y, m, d = (f"CAST(substr({c}, {a}, {n}) AS INTEGER)" for a, n in ((1, 4), (6, 2), (9, 2)))
    return f"(365 * ({y} - 1) + (8 * {y} + 21) // 33 + CASE WHEN {m} <= 7 THEN 31 * ({m} - 1) ELSE 186 + 30 * ({m} - 7) END + {d} - 1 - 492268)"


def calendar_sql() -> str:
    """A table ``cal(day, n)`` of all days of the years 1398..1410."""
    return f"""cal AS (SELECT day, {day_number_sql("day")} AS n FROM (
  SELECT printf('%04d-%02d-%02d', y, m, d) AS day FROM range(1398, 1411) a(y), range(1, 13) b(m), range(1, 32) c(d)) WHERE regexp_full_match(day, '{_DAY}'))"""


def valid_sql(catalog: str, columns: str) -> str:
    return f"""SELECT {columns}, {day_number_sql("RunDate")} AS s, CASE WHEN coalesce(ExpirationDate, '') <> '' THEN {day_number_sql("ExpirationDate")} ELSE 1000000 END AS e
  FROM {catalog} WHERE regexp_full_match(ID, '[0-9]{{13}}') AND regexp_full_match(RunDate, '{_DAY}')
  AND (coalesce(ExpirationDate, '') = '' OR (regexp_full_match(ExpirationDate, '{_DAY}') AND ExpirationDate >= RunDate))"""


_P1 = f"""WITH {calendar_sql()}, v AS (SELECT DISTINCT ID, s, e FROM ({valid_sql("fake_catalog", "ID")})),
two AS (SELECT * FROM v WHERE ID IN (SELECT ID FROM v GROUP BY ID HAVING count(*) > 1)),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY ID ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM two),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY ID ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
p AS (SELECT ID, g, min(s) AS s, max(e) AS e FROM numbered GROUP BY ID, g),
o AS (SELECT ID, 'period' AS kind, s, e FROM p
  UNION ALL SELECT ID, 'gap', e + 1, nxt - 1 FROM (SELECT ID, e, lead(s) OVER (PARTITION BY ID ORDER BY s) AS nxt FROM p) WHERE nxt IS NOT NULL)
SELECT o.ID AS id, kind, a.day AS d_from, coalesce(b.day, '') AS d_to FROM o JOIN cal a ON a.n = o.s LEFT JOIN cal b ON b.n = o.e"""

#: Every way the three categories are written in the data is one of these after blanks and invisible
#: characters are removed.
_TAXABLE_SQL = "trim(regexp_replace(regexp_replace(replace(replace(replace(Taxable, chr(8204), ' '), 'ي', 'ی'), chr(160), ' '), '[\\x{200B}\\x{200E}\\x{200F}\\x{FEFF}\\x{2060}\\x{00AD}\\x{200D}]', '', 'g'), '\\s+', ' ', 'g'))"

_P2_PICK = f"""v AS ({valid_sql("fake_catalog", f"ID, RunDate, LastEditDate, row_n, CAST(Vat AS DECIMAL(18,6)) AS vat, {_TAXABLE_SQL} AS taxable")}),
picked AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY ID, RunDate ORDER BY LastEditDate DESC, row_n) = 1)"""

_P2 = f"""WITH {_P2_PICK},
changed AS (SELECT * FROM picked WINDOW w AS (PARTITION BY ID ORDER BY RunDate) QUALIFY lag(vat) OVER w IS DISTINCT FROM vat OR lag(taxable) OVER w IS DISTINCT FROM taxable OR lag(RunDate) OVER w IS NULL)
SELECT ID AS id, RunDate AS valid_from, coalesce(lead(RunDate) OVER (PARTITION BY ID ORDER BY RunDate), '') AS valid_to FROM changed QUALIFY count(*) OVER (PARTITION BY ID) >= 2"""

_P2_ATTRIBUTES = f"""WITH {_P2_PICK},
long AS (SELECT ID, RunDate, 'vat' AS attribute, CAST(CAST(vat AS DOUBLE) AS VARCHAR) AS value FROM picked UNION ALL SELECT ID, RunDate, 'taxable', taxable FROM picked),
changed AS (SELECT * FROM long WINDOW w AS (PARTITION BY ID, attribute ORDER BY RunDate) QUALIFY lag(value) OVER w IS DISTINCT FROM value OR lag(RunDate) OVER w IS NULL)
SELECT ID AS id, attribute, value, RunDate AS valid_from, coalesce(lead(RunDate) OVER (PARTITION BY ID, attribute ORDER BY RunDate), '') AS valid_to FROM changed"""

_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"


def _p4_sql(columns: str, kind: str, attributes: str, distinct: str = "") -> str:
    return f"""WITH v AS ({valid_sql(_BOTH, "ID, RunDate, ExpirationDate, LastEditDate, row_n, Vat, Taxable, Type")}),
l AS (SELECT {distinct} {columns}, CASE WHEN regexp_full_match(sstid, '[0-9]{{13}}') AND regexp_full_match(issue_date, '{_DAY}') THEN sstid END AS k FROM demo_invoices),
n AS (SELECT *, row_number() OVER () AS i FROM l),
j AS (SELECT n.*, v.row_n, v.Vat, v.Taxable, v.Type, row_number() OVER (PARTITION BY n.i ORDER BY v.RunDate DESC, v.LastEditDate DESC, v.row_n) AS r
  FROM n {kind} JOIN v ON n.k = v.ID AND v.RunDate <= n.issue_date AND (v.e = 1000000 OR n.issue_date <= v.ExpirationDate))
SELECT {attributes} FROM j WHERE r = 1"""


_P5_TYPED = [("am", f"{AM.pattern}"), ("vra", f"{VRA.pattern}"), ("issue_date", _DAY)]
_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^",]*)'


def _typed_at(i: int, pattern: str) -> str:
    return f"^(?:{_FIELD},){{{i}}}(?:\"(?:{pattern})\"|(?:{pattern}))(?:,|\\z)" if i else f"^(?:\"(?:{pattern})\"|(?:{pattern}))(?:,|\\z)"


_SHAPED = f"^{_FIELD}(?:,{_FIELD}){{9}}\\z"
_P5 = f"""WITH shape AS (SELECT raw_id, feed, record, regexp_matches(record, '^{_FIELD}(?:,{_FIELD})*\\z') AS quoted, regexp_matches(record, '{_SHAPED}') AS ten FROM raw_records),
bad AS (SELECT 'raw_records' AS source, CAST(raw_id AS VARCHAR) AS row_key, CASE WHEN record IS NULL THEN 'field_count' WHEN NOT quoted THEN 'quoting' ELSE 'field_count' END AS reason FROM shape WHERE ten IS NOT TRUE
""" + "".join(
    f"UNION ALL SELECT 'raw_records', CAST(raw_id AS VARCHAR), '{reason}' FROM shape WHERE ten AND feed = '{feed}' AND NOT regexp_matches(record, '{_typed_at(names.index(name), pattern)}')\n"
    for feed, names, name, pattern, reason in [*(("demo_invoices", LINE_COLUMNS, n, p, n) for n, p in _P5_TYPED), ("fake_catalog", CATALOG_COLUMNS, "ID", "[0-9]{13}", "id")]
) + "".join(
    f"UNION ALL SELECT '{t}', CAST({key} AS VARCHAR), '{reason}' FROM {t} WHERE regexp_full_match({c}, '{pattern}') IS NOT TRUE\n"
    for t, key, c, pattern, reason in [*(("demo_invoices", "line_id", n, p, n) for n, p in _P5_TYPED), ("fake_catalog", "row_n", "ID", "[0-9]{13}", "id")]
) + ") SELECT DISTINCT source, row_key, reason FROM bad"


def _part(i: int) -> str:
    raw = f"regexp_extract(record, '^(?:{_FIELD},){{{i}}}({_FIELD})(?:,|\\z)', 1)" if i else f"regexp_extract(record, '^({_FIELD})(?:,|\\z)', 1)"
    return f"CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"


_P5_LOADED = "SELECT raw_id, " + ", ".join((f"CAST({_part(i)} AS DOUBLE)" if c in ("am", "vra") else _part(i)) + f" AS {c}" for i, c in enumerate(LINE_COLUMNS)) + f" FROM raw_records WHERE feed = 'demo_invoices' AND regexp_matches(record, '{_SHAPED}')" + "".join(
    f" AND regexp_matches(record, '{_typed_at(LINE_COLUMNS.index(n), p)}')" for n, p in _P5_TYPED
)

SQL = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p2_attribute_intervals": _P2_ATTRIBUTES,
    "p4_found": _p4_sql("line_id, issue_date", "", "line_id, row_n", "DISTINCT"),
    "p4_enriched_lines": _p4_sql("line_id, received_at, issue_date, sstid", "LEFT", f"line_id, received_at, issue_date, sstid, row_n, Vat AS catalog_vat, {_TAXABLE_SQL} AS catalog_taxable, Type AS catalog_type"),
    "p5_found": _P5,
    "p5_loaded_lines": _P5_LOADED,
}
