"""Quality rules, snapshots, versions and temporal lookups over the catalog and the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import jalali
from tarazu.operators import catalog as cat
from tarazu.operators.dated import cite
from tarazu.operators.evaluation import split_ids
from tarazu.operators.intervals import periods_and_gaps
from tarazu.operators.rates import parse_line, rate_at
from tarazu.plans.problems import _TAXABLE_SQL, calendar_sql, day_number_sql, valid_rows
from tarazu.plans.registry import query
from tarazu.session import stage_table
from tarazu.sources.tables import CATALOG_COLUMNS, both_catalogs, is_id, table

AS_OF = "1403-07-01"
_DAY = jalali.DAY
_TEN = ", ".join(f"coalesce({c}, '')" for c in CATALOG_COLUMNS)
_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"


def classified_sql(source: str = "fake_catalog") -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {_TEN} ORDER BY row_n) AS copy FROM {source}),
c AS (SELECT *, copy > 1 AS is_extra_copy,
  copy = 1 AND count(*) FILTER (copy = 1) OVER (PARTITION BY coalesce(ID, ''), coalesce(RunDate, '')) > 1 AS r2,
  copy = 1 AND coalesce(ExpirationDate, '') <> '' AND coalesce(RunDate > ExpirationDate, false) AS r3,
  copy = 1 AND coalesce(length(ID), 0) <> 13 AS r4 FROM numbered),
act AS (SELECT * FROM c WHERE NOT (is_extra_copy OR r2 OR r3 OR r4))"""


_IN_FORCE = f"RunDate <= '{AS_OF}' AND (coalesce(ExpirationDate, '') = '' OR '{AS_OF}' <= ExpirationDate)"


def classified(spark: SparkSession, folder: str, both: bool = False) -> DataFrame:
    return cat.classify(both_catalogs(spark, folder) if both else table(spark, folder, "fake_catalog"))


@query(f"WITH {classified_sql()} SELECT row_n FROM c WHERE is_extra_copy")
def dq_r1_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return cat.extra_copies(table(spark, folder, "fake_catalog"))


def _reason(spark, folder, r):
    return classified(spark, folder).where(F.array_contains("reasons", r)).select("row_n", "ID")


@query(f"WITH {classified_sql()} SELECT row_n, ID FROM c WHERE r2")
def dq_r2_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return _reason(spark, folder, "R2")


@query(f"WITH {classified_sql()} SELECT row_n, ID FROM c WHERE r3")
def dq_r3_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return _reason(spark, folder, "R3")


@query(f"WITH {classified_sql()} SELECT row_n, ID FROM c WHERE r4")
def dq_r4_length(spark: SparkSession, folder: str) -> DataFrame:
    return _reason(spark, folder, "R4")


@query(f"WITH {classified_sql(_BOTH)} SELECT row_n, is_extra_copy, CASE WHEN NOT is_extra_copy THEN concat_ws(',', CASE WHEN r2 THEN 'R2' END, CASE WHEN r3 THEN 'R3' END, CASE WHEN r4 THEN 'R4' END) END AS reasons FROM c")
def dq_classify(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder, both=True).select("row_n", "is_extra_copy", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {classified_sql()}, i AS (SELECT ID, bool_or(NOT (is_extra_copy OR r2 OR r3 OR r4)) AS a, bool_or(r2 OR r3 OR r4) AS q FROM c GROUP BY ID)
SELECT count(*) AS raw_rows, count(*) FILTER (NOT is_extra_copy) AS rows_after_r1, count(*) FILTER (is_extra_copy) AS r1_extra_copies,
  count(DISTINCT (ID, RunDate)) FILTER (r2) AS r2_keys, count(*) FILTER (r2) AS r2_rows, count(*) FILTER (r3) AS r3_rows, count(*) FILTER (r4) AS r4_rows,
  count(*) FILTER (r2::INT + r3::INT + r4::INT > 1) AS rows_with_several_reasons, (SELECT count(*) FROM i) AS raw_ids, (SELECT count(*) FROM i WHERE a) AS active_ids,
  (SELECT count(*) FROM i WHERE q AND NOT a) AS quarantined_only_ids, (SELECT count(*) FROM act WHERE {_IN_FORCE}) AS index_rows, (SELECT count(DISTINCT ID) FROM act WHERE {_IN_FORCE}) AS index_ids FROM c"""
)
def snapshot_counts(spark: SparkSession, folder: str) -> DataFrame:
    return cat.snapshot_counts(classified(spark, folder), AS_OF)


@query(f"WITH {classified_sql()} SELECT ID AS sstid FROM c WHERE NOT is_extra_copy AND ID IS NOT NULL GROUP BY ID HAVING bool_and(r2 OR r3 OR r4)")
def quarantined_only(spark: SparkSession, folder: str) -> DataFrame:
    return cat.quarantined_only(classified(spark, folder))


@query(f"WITH {classified_sql()} SELECT row_n, ID FROM act WHERE {_IN_FORCE}")
def in_force_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return cat.active(classified(spark, folder)).where(cat.in_force(AS_OF)).select("row_n", "ID")


@query(f"WITH {calendar_sql()}, {classified_sql()}, v AS (SELECT row_n, ID, RunDate, nxt.day AS until FROM act LEFT JOIN cal e ON e.day = ExpirationDate LEFT JOIN cal nxt ON nxt.n = e.n + 1) SELECT row_n, ID AS sstid, until AS valid_to FROM v WHERE RunDate <= '{AS_OF}' AND (until IS NULL OR '{AS_OF}' < until)")
def in_force_halfopen(spark: SparkSession, folder: str) -> DataFrame:
    v = cat.versions(cat.active(classified(spark, folder)))
    return v.where((F.col("valid_from") <= AS_OF) & (F.col("valid_to").isNull() | (F.lit(AS_OF) < F.col("valid_to")))).select("row_n", "sstid", "valid_to")


@query("SELECT issue_date, count(*) AS n_lines, coalesce(regexp_full_match(issue_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), false) AS well_formed FROM demo_invoices GROUP BY issue_date")
def date_format_check(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "demo_invoices").groupBy("issue_date").agg(F.count(F.lit(1)).alias("n_lines"))
    return by.withColumn("well_formed", F.coalesce(F.col("issue_date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit(False)))


@query(f"SELECT ID FROM (SELECT ID, count(*) FILTER ({_IN_FORCE}) AS n FROM fake_catalog WHERE regexp_full_match(ID, '[0-9]{{13}}') GROUP BY ID) WHERE n = 1")
def eligible_ids(spark: SparkSession, folder: str) -> DataFrame:
    """IDs of 13 ASCII digits with exactly one row in force."""
    by = table(spark, folder, "fake_catalog").where(is_id(F.col("ID"))).groupBy("ID").agg(F.count_if(cat.in_force(AS_OF)).alias("n"))
    return by.where("n = 1").select("ID")


@query("SELECT DISTINCT CAST(TRY_CAST(Vat AS DECIMAL(18,6)) AS DOUBLE) AS rate FROM fake_catalog")
def distinct_rates(spark: SparkSession, folder: str) -> DataFrame:
    return cat.versions(table(spark, folder, "fake_catalog")).select(F.col("rate").cast("double").alias("rate")).distinct()


@query(f"SELECT row_n, CASE {_TAXABLE_SQL} WHEN 'مشمول' THEN 'taxable' WHEN 'معاف' THEN 'exempt' WHEN 'غیر مشمول' THEN 'out_of_scope' END AS tax_status FROM fake_catalog")
def tax_status_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fake_catalog").select("row_n", cat.tax_status(F.col("Taxable")).alias("tax_status"))


@query(f"SELECT Type, count(*) AS n_rows, coalesce(contains(Type, 'عمومی'), false) AS is_general, count(*) FILTER ({_TAXABLE_SQL} = 'مشمول') AS n_charged FROM {_BOTH} GROUP BY Type")
def is_general(spark: SparkSession, folder: str) -> DataFrame:
    by = both_catalogs(spark, folder).groupBy("Type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(cat.tax_status(F.col("Taxable")) == "taxable").alias("n_charged"))
    return by.withColumn("is_general", cat.is_general(F.col("Type")))


@query(
    f"""WITH v AS (SELECT ID, {day_number_sql("RunDate")} AS s, max(CASE WHEN coalesce(ExpirationDate, '') <> '' THEN {day_number_sql("ExpirationDate")} ELSE 2000000000 END) AS e FROM fake_catalog WHERE regexp_full_match(RunDate, '{_DAY}') GROUP BY ALL),
g AS (SELECT e, lead(s) OVER (PARTITION BY ID ORDER BY s) - e AS step FROM v)
SELECT CASE WHEN e = 2000000000 THEN 'open' WHEN step = 1 THEN 'next_day' WHEN step > 1 THEN 'gap' ELSE 'overlap' END AS kind, count(*) AS n_pairs FROM g WHERE step IS NOT NULL GROUP BY 1"""
)
def version_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return cat.version_gaps(table(spark, folder, "fake_catalog"))


@query("SELECT row_n, sha256(concat_ws(chr(31), " + _TEN + ")) AS digest FROM fake_catalog")
def row_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fake_catalog").select("row_n", cat.row_digest().alias("digest"))


@query(
    f"""WITH a AS (SELECT DISTINCT trim(unnest(string_split(expected_sstid, ';'))) AS sstid FROM eval_golden),
h AS (SELECT ID, count(*) AS n, bool_or({_IN_FORCE}) AS f FROM {_BOTH} GROUP BY ID) SELECT sstid, coalesce(n, 0) AS n_rows, f AS any_in_force FROM a LEFT JOIN h ON a.sstid = h.ID"""
)
def id_lookup(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "eval_golden").select(F.explode(split_ids(F.col("expected_sstid"))).alias("sstid"))
    return cat.lookup_ids(both_catalogs(spark, folder), ids, AS_OF)


_NUM = "regexp_full_match({c}, '[0-9]{{1,{w}}}(\\.[0-9]{{1,{s}}})?') IS TRUE"
_GOOD = {c: _NUM.format(c=c, w=w, s=s) for c, w, s in (("am", 14, 6), ("fee", 14, 6), ("vra", 5, 4), ("vam", 14, 6))}


@query(
    "SELECT DISTINCT line_id, trim(sstid) AS sstid, "
    + ", ".join(f"CASE WHEN {g} THEN CAST(TRY_CAST({c} AS DECIMAL(20,6)) AS DOUBLE) END AS {c}" for c, g in _GOOD.items())
    + f", CASE WHEN {_GOOD['am']} AND {_GOOD['fee']} THEN CAST(CAST(TRY_CAST(am AS DECIMAL(20,6)) AS DECIMAL(19,6)) * CAST(TRY_CAST(fee AS DECIMAL(20,6)) AS DECIMAL(19,6)) AS DOUBLE) END AS base, CASE WHEN regexp_full_match(issue_date, '{_DAY}') IS NOT TRUE THEN 'issue_date' WHEN coalesce(trim(sstid), '') = '' THEN 'sstid' "
    + " ".join(f"WHEN NOT ({g}) THEN '{c}'" for c, g in (("am", _GOOD["am"]), ("fee", _GOOD["fee"]), ("vra", _GOOD["vra"]), ("vam", _GOOD["vam"])))
    + " END AS error FROM demo_invoices"
)
def line_parse(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "demo_invoices").select("line_id", parse_line().alias("p"))
    return p.select("line_id", "p.sstid", *(F.col(f"p.{c}").cast("double").alias(c) for c in ("am", "fee", "vra", "vam", "base")), "p.error").distinct()


@query("SELECT DISTINCT line_id, label FROM (SELECT line_id, unnest(string_split(labels, ';')) AS label FROM demo_invoices) WHERE label <> ''")
def scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of every line, as a set."""
    return table(spark, folder, "demo_invoices").select("line_id", F.explode(F.filter(F.split("labels", ";"), lambda x: x != "")).alias("label")).distinct()


# --- Temporal lookups ------------------------------------------------------------------------------------------------


def _rate_sql(rows: str, pick: str) -> str:
    return f"""WITH {classified_sql(_BOTH)}, v AS (SELECT DISTINCT ID, RunDate, CASE WHEN coalesce(ExpirationDate, '') <> '' THEN ExpirationDate ELSE '9999' END AS e, TRY_CAST(trim(Vat) AS DECIMAL(18,6)) AS rate, DescriptionOfID FROM {rows}),
st AS (SELECT ID, bool_or(NOT (r2 OR r3 OR r4)) AS a, bool_or(r2 OR r3 OR r4) AS q FROM c WHERE NOT is_extra_copy AND ID IS NOT NULL GROUP BY ID),
l AS (SELECT DISTINCT line_id, sstid, issue_date, regexp_full_match(issue_date, '{_DAY}') IS TRUE AS ok FROM demo_invoices),
j AS (SELECT l.*, v.ID, v.RunDate, v.rate, rank() OVER (PARTITION BY line_id, sstid, issue_date ORDER BY v.RunDate DESC) AS r FROM l LEFT JOIN v ON l.ok AND l.sstid = v.ID AND v.RunDate <= issue_date AND issue_date <= v.e),
g AS (SELECT line_id, sstid, issue_date, ok, count(ID) AS n, max(RunDate) AS valid_from, max(rate) AS rate FROM j WHERE r = 1 GROUP BY ALL)
SELECT line_id, g.sstid, issue_date, CASE WHEN NOT ok THEN 'INVALID_DATE' WHEN n = 1 THEN 'OK' WHEN n > 1 THEN 'AMBIGUOUS' WHEN a THEN 'NOT_IN_FORCE' WHEN q THEN 'QUARANTINED_ONLY' ELSE 'NOT_IN_CATALOG' END AS status,
  CASE WHEN n = 1 THEN CAST(rate AS DOUBLE) END AS rate, CASE WHEN n > 0 THEN valid_from END AS valid_from, CAST(n AS INTEGER) AS n_candidates FROM g LEFT JOIN st ON g.sstid = st.ID {pick}"""


def _rates(spark: SparkSession, folder: str, strict: bool) -> DataFrame:
    # Read for the versions and for the IDs' states: classified once.
    c = stage_table(classified(spark, folder, both=True), "classified")
    rows = cat.active(c) if strict else c.where(~F.col("is_extra_copy") & ~F.array_contains("reasons", "R3") & ~F.array_contains("reasons", "R4"))
    got = rate_at(table(spark, folder, "demo_invoices"), cat.versions(rows), cat.id_status(c))
    return got.select("line_id", "sstid", "issue_date", "status", F.col("rate").cast("double").alias("rate"), "valid_from", "n_candidates")


@query(_rate_sql("act", ""))
def rate_at_status(spark: SparkSession, folder: str) -> DataFrame:
    """The version in force of every line's ID, by the active rows only."""
    return _rates(spark, folder, True)


@query(_rate_sql("(SELECT * FROM c WHERE NOT (is_extra_copy OR r3 OR r4))", "WHERE n > 1"))
def rate_at_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that several versions answer when conflicting rows are not quarantined."""
    return _rates(spark, folder, False).where("n_candidates > 1")


_DATES = "(SELECT issue_date AS d FROM demo_invoices UNION SELECT RunDate FROM fake_catalog UNION SELECT ExpirationDate FROM fake_catalog)"


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "fake_catalog")
    return table(spark, folder, "demo_invoices").select(F.col("issue_date").alias("d")).union(f.select("RunDate")).union(f.select("ExpirationDate")).distinct()


@query(f"SELECT d, regexp_full_match(d, '{_DAY}') IS TRUE AS valid FROM {_DATES}")
def jalali_valid(spark: SparkSession, folder: str) -> DataFrame:
    return _dates(spark, folder).select("d", jalali.is_day(F.col("d")).alias("valid"))


@query(f"WITH {calendar_sql()} SELECT d, b.day AS next FROM {_DATES} LEFT JOIN cal a ON a.day = d LEFT JOIN cal b ON b.n = a.n + 1")
def jalali_next_day(spark: SparkSession, folder: str) -> DataFrame:
    return _dates(spark, folder).select("d", jalali.next_day(F.col("d")).alias("next"))


@query(f"WITH {calendar_sql()} SELECT d, b.day AS prev FROM {_DATES} LEFT JOIN cal a ON a.day = d LEFT JOIN cal b ON b.n = a.n - 1")
def jalali_prev_day(spark: SparkSession, folder: str) -> DataFrame:
    return _dates(spark, folder).select("d", jalali.prev_day(F.col("d")).alias("prev"))


CALENDAR = ("1401-01-01", "1405-12-29")


@query(f"WITH {calendar_sql()} SELECT day, CAST(n AS INTEGER) AS n FROM cal WHERE day BETWEEN '{CALENDAR[0]}' AND '{CALENDAR[1]}'")
def calendar_days(spark: SparkSession, folder: str) -> DataFrame:
    lo, hi = (jalali.to_days(F.lit(d)) for d in CALENDAR)
    return spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("n")).select(jalali.from_days(F.col("n")).alias("day"), "n")


@query(
    f"""WITH {calendar_sql()}, v AS (SELECT DISTINCT ID, RunDate, CASE WHEN coalesce(ExpirationDate, '') = '' THEN '9999' ELSE ExpirationDate END AS e FROM fake_catalog WHERE regexp_full_match(ID, '[0-9]{{13}}') AND regexp_full_match(RunDate, '{_DAY}') AND (coalesce(ExpirationDate, '') = '' OR (regexp_full_match(ExpirationDate, '{_DAY}') AND ExpirationDate >= RunDate))),
d AS (SELECT day FROM cal WHERE day BETWEEN '{CALENDAR[0]}' AND '{CALENDAR[1]}')
SELECT ID AS sstid, CAST(count(DISTINCT day) AS INTEGER) AS ok_days, CAST((SELECT count(*) FROM d) - count(DISTINCT day) AS INTEGER) AS gap_days FROM v LEFT JOIN d ON day BETWEEN RunDate AND e GROUP BY ID"""
)
def ok_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days of a range on which an ID is in force, and on which it is not: summed over its continuous periods, not walked day by day."""
    rows = valid_rows(table(spark, folder, "fake_catalog"))
    p = periods_and_gaps(rows, "ID", F.col("run_day"), F.col("exp_day")).where("kind = 'period'")
    lo, hi = (jalali.to_days(F.lit(d)) for d in CALENDAR)
    covered = F.greatest(F.least(F.coalesce("d_to", hi), hi) - F.greatest("d_from", lo) + 1, F.lit(0))
    by = p.groupBy(F.col("ID").alias("sstid")).agg(F.sum(covered).cast("int").alias("ok_days"))
    return by.withColumn("gap_days", (hi - lo + 1 - F.col("ok_days")).cast("int"))


#: Invented documents that apply to two of the reviewers' tags.
UNITS = [("u1", "1401-01-01", "1402-06-31", ["T6"], "placeholder"), ("u2", "1402-01-01", None, ["T6", "T2"], "reviewed"), ("u3", "1403-01-01", None, ["T6"], "reviewed"), ("u0", "1404-01-01", "1404-12-29", ["T6"], "placeholder")]
_UNITS_SQL = ", ".join(f"('{i}', '{a}', {'NULL' if b is None else repr(b)}, {c}, '{st}')" for i, a, b, c, st in UNITS)


@query(
    f"""WITH u(id, f, t, codes, status) AS (VALUES {_UNITS_SQL}), x AS (SELECT id, f, t, unnest(codes) AS code, status FROM u),
l AS (SELECT DISTINCT line_id, issue_date, unnest(string_split(labels, ';')) AS code FROM demo_invoices),
j AS (SELECT l.*, x.id, x.status, row_number() OVER (PARTITION BY line_id, l.code, issue_date ORDER BY status <> 'reviewed', id) AS r FROM l LEFT JOIN x ON l.code = x.code AND f <= issue_date AND (t IS NULL OR issue_date <= t) WHERE l.code <> '')
SELECT line_id, issue_date, code, id AS unit_id, CASE WHEN id IS NOT NULL THEN status <> 'reviewed' END AS is_placeholder FROM j WHERE r = 1"""
)
def citation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The document to cite for each tag of a line on its day."""
    tags = table(spark, folder, "demo_invoices").select("line_id", "issue_date", F.explode(F.split("labels", ";")).alias("code")).where("code <> ''").distinct()
    units = spark.createDataFrame(UNITS, "id string, valid_from string, valid_to string, applies_to array<string>, status string")
    return cite(tags, "code", "issue_date", units)
