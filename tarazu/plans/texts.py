"""Text functions over the catalog's titles, the sellers' texts and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.operators.workload import eligible_noise, noise, vague_only as is_vague
from tarazu.plans.registry import query
from tarazu.sources.tables import both_catalogs, table

_BLANK = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"


def normalize_sql(c: str) -> str:
    source, target = "".join(tx._NORMAL) + tx._DELETED, "".join(tx._NORMAL.values())
    return f"trim(regexp_replace(lower(translate({c}, '{source}', '{target}')), '{_BLANK}+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all({normalize_sql(c)}, '[\\p{{L}}\\p{{N}}_]+')"


def fold_sql(c: str) -> str:
    t = {"ي": "ی", "ك": "ک", **tx._DIGITS}
    return f"translate({c}, '{''.join(t)}', '{''.join(t.values())}')"


@query(f"SELECT DISTINCT sstt, {normalize_sql('sstt')} AS normalized FROM demo_invoices WHERE sstt IS NOT NULL")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "demo_invoices").where("sstt IS NOT NULL").select("sstt").distinct().withColumn("normalized", tx.normalize(F.col("sstt")))


@query(f"SELECT row_n, unnest(t) AS token, CAST(unnest(range(len(t))) AS INTEGER) AS place FROM (SELECT row_n, {tokens_sql('DescriptionOfID')} AS t FROM {_BOTH})")
def tokenize_text(spark: SparkSession, folder: str) -> DataFrame:
    return both_catalogs(spark, folder).select("row_n", F.posexplode(tx.tokenize(F.col("DescriptionOfID"))).alias("place", "token"))


@query(f"SELECT doc_id, CAST(coalesce(len({tokens_sql('text')}), 0) AS INTEGER) AS n_tokens, CAST(coalesce(len(list_distinct({tokens_sql('text')})), 0) AS INTEGER) AS n_distinct FROM documents")
def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    tokens = table(spark, folder, "documents").select("doc_id", F.coalesce(tx.tokenize(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


_SEARCH_BLANK = _BLANK[:-1] + "\\x{200C}]"


@query(f"SELECT DISTINCT DescriptionOfID, regexp_replace(lower({fold_sql('DescriptionOfID')}), '{_SEARCH_BLANK}', '', 'g') AS key FROM fake_catalog WHERE DescriptionOfID IS NOT NULL")
def search_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fake_catalog").where("DescriptionOfID IS NOT NULL").select("DescriptionOfID").distinct().withColumn("key", tx.search_key(F.col("DescriptionOfID")))


_CUT = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}،,/\\\\()\\[\\]:;«»\"'']+"


@query(f"SELECT DISTINCT row_n, w AS token FROM (SELECT row_n, unnest(regexp_split_to_array(replace(lower({fold_sql('DescriptionOfID')}), chr(8204), ''), '{_CUT}')) AS w FROM fake_catalog) WHERE w <> ''")
def silver_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fake_catalog").select("row_n", F.explode(tx.title_tokens(F.col("DescriptionOfID"))).alias("token"))


#: The text searched for and the number of hits reported.
NEEDLE, HITS = "كولر ", 20


@query(f"SELECT row_n, ID FROM fake_catalog WHERE contains(regexp_replace(lower({fold_sql('DescriptionOfID')}), '{_SEARCH_BLANK}', '', 'g'), 'کولر') ORDER BY row_n LIMIT {HITS}")
def substring_search(spark: SparkSession, folder: str) -> DataFrame:
    """The first hits in file order of a text, blanks and keyboard variants ignored."""
    hit = tx.search_key(F.col("DescriptionOfID")).contains(tx.search_key(F.lit(NEEDLE)))
    return table(spark, folder, "fake_catalog").where(hit).select("row_n", "ID").orderBy("row_n").limit(HITS)


# Words that say nothing about the goods.
VAGUE = ["کالا", "خدمات", "متفرقه", "ملزومات", "گوناگون", "خرید", "فروش", "نقدی", "هزینه", "بابت", "فاکتور", "طبق", "سفارش", "عدد", "تست"]


@query(f"SELECT DISTINCT sstt, len(list_filter({tokens_sql('sstt')}, lambda x: NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({VAGUE}, x))) = 0 AS vague FROM demo_invoices WHERE sstt IS NOT NULL")
def vague_only(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "demo_invoices").where("sstt IS NOT NULL").select("sstt").distinct().withColumn("vague", is_vague(F.col("sstt"), VAGUE))


@query("SELECT doc_id, regexp_replace(text, '([\\\\`*_{}\\[\\]()<>#+\\-.!|~$&])', '\\\\\\1', 'g') AS escaped FROM documents")
def md_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.md_escape(F.col("text")).alias("escaped"))


@query("WITH x AS (SELECT DISTINCT unnest([am, fee, vra]) AS number FROM demo_invoices), u AS (SELECT number, string_split(number || '.', '.') AS p FROM x WHERE regexp_full_match(number, '[0-9]{1,14}(\\.[0-9]{1,6})?')) SELECT number, format('{:,}', CAST(p[1] AS BIGINT)) || CASE WHEN rtrim(p[2], '0') <> '' THEN '.' || rtrim(p[2], '0') ELSE '' END AS shown FROM u")
def fmt_num(spark: SparkSession, folder: str) -> DataFrame:
    numbers = table(spark, folder, "demo_invoices").select(F.explode(F.array("am", "fee", "vra")).alias("number")).where(F.col("number").rlike(r"\A[0-9]{1,14}(?:\.[0-9]{1,6})?\z")).distinct()
    return numbers.withColumn("shown", tx.format_number(F.col("number")))


def _pair_key(a: str, b: str) -> str:
    return f"concat(array_to_string({tokens_sql(a)}, ' '), chr(31), array_to_string({tokens_sql(b)}, ' '))"


@query(f"SELECT catalog_term, seller_term, substr(sha1({_pair_key('catalog_term', 'seller_term')}), 1, 10) AS pair_id, CASE WHEN contains(replace(coalesce(note, ''), ' ', ''), 'direction=reversed') THEN 'reversed' ELSE 'original' END AS direction FROM head_synonyms")
def pair_id(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(F.array_join(tx.tokenize(F.col("catalog_term")), " "), F.lit("\x1f"), F.array_join(tx.tokenize(F.col("seller_term")), " "))
    direction = F.when(F.replace(F.coalesce("note", F.lit("")), F.lit(" "), F.lit("")).contains("direction=reversed"), "reversed").otherwise("original")
    return table(spark, folder, "head_synonyms").select("catalog_term", "seller_term", F.substring(F.sha1(key), 1, 10).alias("pair_id"), direction.alias("direction"))


@query(f"SELECT row_n, replace(replace(DescriptionOfID, 'ی', 'ي'), 'ک', 'ك') AS arabic_letters, replace(DescriptionOfID, chr(8204), '') AS no_zwnj, translate(DescriptionOfID, '0123456789', '{tx.PERSIAN_DIGITS}') AS persian_digits, array_to_string(list_filter([CASE WHEN regexp_matches(DescriptionOfID, '[یک]') THEN 'arabic_letters' END, CASE WHEN contains(DescriptionOfID, chr(8204)) THEN 'no_zwnj' END, CASE WHEN regexp_matches(DescriptionOfID, '[0-9]') THEN 'persian_digits' END, CASE WHEN len(list_filter(string_split(DescriptionOfID, ' '), lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 4)) > 0 THEN 'typo' END], lambda x: x IS NOT NULL), ',') AS eligible FROM fake_catalog")
def noise_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The three noise rules that need no chance, and which rules change a title; the fourth, typing errors, is seeded by a hash and tested on its
    properties."""
    t = table(spark, folder, "fake_catalog")
    return t.select("row_n", *(noise(F.col("DescriptionOfID"), r).alias(r) for r in ("arabic_letters", "no_zwnj", "persian_digits")), F.array_join(eligible_noise(F.col("DescriptionOfID")), ",").alias("eligible"))
