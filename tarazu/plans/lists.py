"""Lists of matches, histories, types, typed titles and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.operators import catalog as cat
from tarazu.operators import workload as wl
from tarazu.operators.evaluation import split_ids
from tarazu.operators.rates import line_numbers
from tarazu.plans.quality import AS_OF, _IN_FORCE, classified_sql
from tarazu.plans.registry import query
from tarazu.plans.texts import tokens_sql
from tarazu.plans.workload import _TITLES, _WS, derived_sql, query_sql, titles
from tarazu.session import scratch_path
from tarazu.sources.files import read_csv, write_csv
from tarazu.sources.tables import CATALOG_COLUMNS, both_catalogs, table

_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"
_ASKED = "(SELECT DISTINCT trim(unnest(string_split(expected_sstid, ';'))) AS sstid FROM eval_golden)"
CAP = 21  # one more than a query may mean


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_golden").select(F.explode(split_ids(F.col("expected_sstid"))).alias("sstid"))


@query(
    f"""WITH {classified_sql(_BOTH)}, {_TITLES}, {derived_sql(f'(SELECT * FROM act WHERE {_IN_FORCE} AND row_n % 50 = 0)')}, qq AS (SELECT row_n, list_distinct({tokens_sql(query_sql(1))}) AS q FROM dv),
m AS (SELECT row_n, list_sort(list(DISTINCT ID))[1:{CAP}] AS ids FROM qq JOIN tt ON len(q) > 0 AND list_has_all(t, q) WHERE ID NOT IN (SELECT sstid FROM {_ASKED} WHERE sstid IS NOT NULL) GROUP BY row_n)
SELECT row_n, array_to_string(coalesce(ids, []), ';') AS ids, len(coalesce(ids, [])) AS n_ids FROM qq LEFT JOIN m USING (row_n)"""
)
def token_subset_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The IDs that a query made from a title (row numbers divisible by 50) can mean, without those of the evaluation set, up to a cap."""
    t = titles(spark, folder)
    q = t.where("row_n % 50 = 0").select("row_n", tx.tokenize(wl.build_query(wl.derive(F.col("DescriptionOfID"), F.col("Type")), 1)).alias("wanted"))
    m = wl.match_ids(t, "ID", "tokens", q, "row_n", "wanted", CAP, _asked(spark, folder).withColumnRenamed("sstid", "ID"))
    return m.select("row_n", F.array_join("ids", ";").alias("ids"), "n_ids")


@query(f"SELECT row_n, ID AS sstid, trim(regexp_replace(DescriptionOfID, '{_WS}', ' ', 'g')) AS title, Vat, Taxable, Type, RunDate, ExpirationDate, CASE WHEN {_IN_FORCE} THEN 'yes' ELSE 'no' END AS in_force FROM {_BOTH} WHERE ID IN (SELECT sstid FROM {_ASKED})")
def id_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the IDs that the evaluation set expects, as a lookup shows them."""
    return cat.history_rows(both_catalogs(spark, folder), _asked(spark, folder), AS_OF)


@query(f"SELECT ID, arg_max_null(Type, row_n) AS type FROM {_BOTH} WHERE ID IN (SELECT ID FROM {_BOTH} WHERE {_IN_FORCE}) GROUP BY ID")
def type_attach(spark: SparkSession, folder: str) -> DataFrame:
    """The type of the last row of every ID that has a row in force."""
    rows = both_catalogs(spark, folder)
    return cat.last_types(rows.join(rows.where(cat.in_force(AS_OF)).select("ID").distinct(), "ID", "left_semi")).select("ID", F.col("Type").alias("type"))


_DRAW = lambda i: f"CAST(concat('0x', substr(md5(CAST(row_n AS VARCHAR)), {1 + 6 * i}, 6)) AS BIGINT)"
_HIT = lambda i, share: f"{_DRAW(i)} < {int(share * (1 << 24))}"


@query(
    f"""WITH a AS (SELECT row_n, trim(regexp_replace(replace(CASE WHEN contains(DescriptionOfID, '/') AND {_HIT(0, 0.5)} THEN string_split(DescriptionOfID, '/')[1] ELSE DescriptionOfID END, '/', ' '), '{_WS}', ' ', 'g')) AS t FROM {_BOTH}),
b AS (SELECT row_n, CASE WHEN {_HIT(1, 0.3)} THEN translate(t, 'یک', 'يك') ELSE t END AS t FROM a), c AS (SELECT row_n, CASE WHEN {_HIT(2, 0.3)} THEN translate(t, '{tx.LATIN_DIGITS}', '{tx.PERSIAN_DIGITS}') ELSE t END AS t FROM b),
d AS (SELECT row_n, t, string_split(t, ' ') AS p, {_DRAW(4)} % nullif(len(string_split(t, ' ')) - 1, 0) + 1 AS k FROM c)
SELECT row_n, CASE WHEN {_HIT(3, 0.3)} AND len(p) > 1 THEN concat(array_to_string(p[1:k], ' '), chr(8204), array_to_string(p[k + 1:], ' ')) ELSE t END AS text FROM d"""
)
def seller_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every title as a seller would type it."""
    return both_catalogs(spark, folder).select("row_n", wl.seller_text(F.col("DescriptionOfID"), F.col("row_n")).alias("text"))


@query("WITH x AS (SELECT DISTINCT am FROM demo_invoices WHERE regexp_full_match(am, '[0-9]{1,14}(\\.[0-9]{1,6})?')) SELECT am, regexp_replace(regexp_replace(CAST(CAST(am AS DECIMAL(20,6)) AS VARCHAR), '0+$', ''), '\\.$', '') AS shown FROM x")
def plain_numbers(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "demo_invoices")
    return lines.select("am", line_numbers()["am"].alias("x")).where("x IS NOT NULL").distinct().select("am", tx.plain_number(F.col("x")).alias("shown"))


@query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in CATALOG_COLUMNS) + " FROM fake_catalog")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog written as a CSV to the shared folder and read again: sink and scan keep every row; an empty field is null."""
    path = scratch_path(spark, "catalog-csv")
    columns = [*CATALOG_COLUMNS, "row_n"]
    write_csv(table(spark, folder, "fake_catalog").select(*columns), path, ["row_n"])
    return read_csv(spark, path, columns).select(*CATALOG_COLUMNS)
