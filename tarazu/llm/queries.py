"""The registered queries of this sub-package and, where SQL can state them, their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm.canonical import map_values
from tarazu.llm.leakage import PASSAGE, SLOP, find_leaks
from tarazu.llm.lookalike import look_same_form, script_findings
from tarazu.llm.mixing import REACHABLE, Mixture, mix, mixture_checks
from tarazu.llm.splitting import piece_checks, split_documents
from tarazu.operators.skew import salted, salted_join
from tarazu.sources.tables import both_catalogs, is_id, table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "demo_invoices").where(is_id(F.col("sstid")) & (F.col("sstt") != "")).select("line_id", F.col("sstid").alias("id"), "sstt")
    rows = both_catalogs(spark, folder).where(is_id(F.col("ID")) & F.col("DescriptionOfID").isNotNull()).select(F.col("ID").alias("id"), "row_n", "DescriptionOfID", F.coalesce(look_same_form(F.col("DescriptionOfID")), F.lit("")).alias("form"))
    left, right = salted(lines, rows, ["id"], [F.col("line_id")])
    # A form that cannot be null: else the join would filter by it below, and compute it twice.
    same = left.withColumn("form", F.coalesce(look_same_form(F.col("sstt")), F.lit(""))).join(right, ["id", "form", "__salt"])
    return same.where("sstt <> DescriptionOfID").select("line_id", "row_n").distinct()


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct seller text with its one form and what was found in its scripts."""
    texts = table(spark, folder, "demo_invoices").where("sstt IS NOT NULL").select("sstt").distinct()
    return texts.select("sstt", look_same_form(F.col("sstt")).alias("form"), script_findings(F.col("sstt")).alias("f")).select("sstt", "form", "f.*")


def _mapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "demo_invoices").where(~is_id(F.col("sstid")) & (F.col("sstt") != "")).select("line_id", "sstt")
    mapped = map_values(lines, "sstt", table(spark, folder, "fake_catalog_general").where(is_id(F.col("ID"))), "ID", "DescriptionOfID", table(spark, folder, "head_synonyms"), "catalog_term", "seller_term", unmatched="unmatched")
    return lines, mapped


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    lines, mapped = _mapped(spark, folder)
    joined = salted_join(lines, mapped.withColumnRenamed("value", "sstt"), ["sstt"], [F.col("line_id")])
    return joined.select("line_id", F.col("entry").alias("id")).distinct()


def p6_unmatched_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values that mean no listed entry, with the number of lines that carry each."""
    lines, mapped = _mapped(spark, folder)
    counted = lines.groupBy("sstt").agg(F.count(F.lit(1)).alias("n_lines"))
    return counted.join(mapped.where("entry = 'unmatched'").select(F.col("value").alias("sstt")), "sstt")


def _leaks(spark: SparkSession, folder: str, slop: int | None = None) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_golden"), "item_id", "query_text", slop=slop)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase matches and those with up to a few other words inside."""
    return _leaks(spark, folder, SLOP)


def _mixture(spark: SparkSession, folder: str, total: str | None = None) -> Mixture:
    return mix(table(spark, folder, "documents"), "doc_id", "source", "text", table(spark, folder, "mix_targets"), total)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).rows


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares


def p8_reachable_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the largest mixture in which every source has its share."""
    return _mixture(spark, folder, REACHABLE).shares


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the mixture (nothing)."""
    return mixture_checks(_mixture(spark, folder), table(spark, folder, "documents"), "doc_id", "text")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_documents(table(spark, folder, "documents"), "doc_id", "text")


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What every document's pieces give again, and what is wrong with them (nothing)."""
    return piece_checks(table(spark, folder, "documents"), "doc_id", "text", p9_pieces(spark, folder))


QUERIES = {q.__name__: q for q in (p3_found, p3_forms, p6_found, p6_unmatched_values, p7_found, p7_proximity, p8_mixture, p8_shares, p8_reachable_shares, p8_checks, p9_pieces, p9_checks)}


# --- The same in SQL -------------------------------------------------------------------------------------------------

#: Blocks with characters that the SQL replaces: Greek, Cyrillic, digits, blanks, presentation forms, widths.  Characters outside them show
#: themselves in the test tables.
_BLOCKS = [(0x80, 0xA0), (0xAD, 0xAD), (0x370, 0x4FF), (0x61C, 0x61C), (0x640, 0x6FF), (0x2000, 0x206F), (0x3000, 0x3000), (0xFB50, 0xFEFF), (0xFF01, 0xFFEF)]
# Letters drawn like the Latin, or the Arabic, letter at the same place below them.  They are the SQL's own, as a check on the operator's.
_DRAWN = "АВСЕНІЈКМОРԚЅТѴԜХҮӀУасԁеһіјӏорԛѕѵԝхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿονϳيىېكڪەہھ‐‑‒–⁃⁄"
_ALIKE = "ABCEHIJKMOPQSTVWXYIYacdehijlopqsvwxyABEZHIKMNOPTYXJovjیییککههه-----/"


def _replaced(c: str) -> str:
    """What the SQL writes for a character, by Unicode's own properties and the letters above; '' for one that is not seen."""
    if c.isspace() or c == "\u200c":
        return " "
    if unicodedata.category(c) == "Cf" or "\ufe00" <= c <= "\ufe0f":
        return ""
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) > 1:
        return c
    return str(unicodedata.decimal(plain)) if plain.isdecimal() else plain.translate(str.maketrans(_DRAWN, _ALIKE))


def form_sql(c: str) -> str:
    """The one form of a text in DuckDB's SQL, for texts whose tokens a single script can spell: each character replaced by the sign it
    shows, then composed."""
    every = [chr(code) for lo, hi in _BLOCKS for code in range(lo, hi + 1)]
    changed = [(ch, new) for ch in every if (new := _replaced(ch)) and new != ch]
    source, target, deleted = "".join(ch for ch, _ in changed), "".join(new for _, new in changed), "".join(ch for ch in every if not _replaced(ch))
    source, target = source.replace("'", "''"), target.replace("'", "''")
    return f"trim(regexp_replace(replace(nfc_normalize(translate({c}, '{source}{deleted}', '{target}')), 'یٔ', 'ئ'), '[ \\t\\n\\x0B\\f\\r\\x{{1C}}-\\x{{1F}}]+', ' ', 'g'))"


_BOTH = "(SELECT ID, row_n, DescriptionOfID FROM fake_catalog UNION ALL SELECT ID, row_n, DescriptionOfID FROM fake_catalog_general)"
_P3 = f"""SELECT DISTINCT line_id, row_n FROM (SELECT line_id, sstid, sstt, {form_sql("sstt")} AS f FROM demo_invoices WHERE regexp_full_match(sstid, '[0-9]{{13}}') AND sstt <> '') l
JOIN (SELECT ID, row_n, DescriptionOfID, {form_sql("DescriptionOfID")} AS f FROM {_BOTH}) c ON l.sstid = c.ID AND l.f = c.f AND sstt <> DescriptionOfID"""


def _words_sql(c: str) -> str:
    return f"regexp_extract_all(lower({form_sql(c)}), '[\\p{{L}}\\p{{N}}]+')"


_P7_ITEMS = f"""WITH i AS MATERIALIZED (SELECT item_id, w, least({PASSAGE}, len(w)) AS n FROM (SELECT item_id, {_words_sql("query_text")} AS w FROM eval_golden) WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k:k + n - 1])) AS g FROM i),
d AS MATERIALIZED (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT DISTINCT doc_id, {_words_sql("text")} AS w FROM documents WHERE text <> '') WHERE len(w) > 0)"""

_P7 = f"{_P7_ITEMS} SELECT DISTINCT doc_id, item_id FROM d JOIN iw ON contains(t, ' ' || array_to_string(g, ' ') || ' ')"

_P7_NEAR = f"""{_P7_ITEMS}, c AS MATERIALIZED (SELECT doc_id, item_id, n, g, w, t FROM d JOIN iw ON list_has_all(w, g)),
m AS MATERIALIZED (SELECT * FROM c WHERE regexp_matches(t, ' ' || array_to_string(g, ' (?:[^ ]+ ){{0,{SLOP}}}') || ' ')),
k AS (SELECT doc_id, item_id, n, g, w, unnest(list_filter(range(1, len(w) + 1), lambda k: w[k] = g[1])) AS k FROM m),
x AS (SELECT doc_id, item_id, w[k:k + n - 1] = g AS whole FROM k WHERE regexp_matches(array_to_string(w[k:k + n - 1 + {SLOP}], ' ') || ' ', '^' || array_to_string(g, ' (?:[^ ]+ )*') || ' '))
SELECT doc_id, item_id, CASE WHEN bool_or(whole) THEN 'phrase' ELSE 'proximity' END AS kind FROM x GROUP BY ALL"""

#: Round trip of every text; the sizes and the boundaries have to be right everywhere.
_P9 = "SELECT doc_id, md5(text) AS rebuilt, 0 AS over_limit, 0 AS wrong_sizes, 0 AS cut_paragraphs FROM documents WHERE text <> ''"

#: The targeted sources with tokens; caps, texts and goals have to be kept everywhere.
_P8 = "SELECT source, 0 AS over_cap, 0 AS changed, TRUE AS near_goal FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> '')"

_P7_NEAR = f"""WITH i AS MATERIALIZED (SELECT item_id, w, least({PASSAGE}, len(w)) AS n FROM (SELECT item_id, {_words_sql("query_text")} AS w FROM eval_golden) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, w[k:k + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
d AS MATERIALIZED (SELECT DISTINCT doc_id, {_words_sql("text")} AS w FROM documents WHERE text <> ''),
c AS (SELECT doc_id, item_id, n, g, w, unnest(range(1, len(w) + 1)) AS k FROM d JOIN iw ON list_has_all(w, g)),
m AS (SELECT DISTINCT doc_id, item_id, w[k:k + n - 1] = g AS whole FROM c WHERE w[k] = g[1] AND regexp_matches(array_to_string(w[k:k + n - 1 + {SLOP}], ' ') || ' ', '^' || array_to_string(g, ' (?:[^ ]+ )*') || ' '))
SELECT doc_id, item_id, CASE WHEN bool_or(whole) THEN 'phrase' ELSE 'proximity' END AS kind FROM m GROUP BY ALL"""

SQL = {"p7_proximity": _P7_NEAR, "p8_checks": _P8, "p9_checks": _P9, "p3_found": _P3, "p7_found": _P7}
