"""Query sets made from the catalog: derivation, labels, quotas, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.operators import catalog as cat
from tarazu.operators import workload as wl
from tarazu.operators.rates import line_numbers, percent_of
from tarazu.plans.quality import AS_OF, _IN_FORCE, classified, classified_sql
from tarazu.plans.registry import query
from tarazu.plans.texts import tokens_sql
from tarazu.session import stage_table
from tarazu.sources.tables import both_catalogs, is_id, table

_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _startswith_sql(s: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({s}, '{w}')" for w in words) + ")"


def _contains_sql(s: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({s}, '{w}')" for w in words) + ")"


_WS = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_KIND = (
    f"CASE WHEN regexp_full_match(replace(s, chr(8204), ' '), '(?:(?:برند|مدل|نام تجارتی)\\s+)?فاقد\\s+(?:نام تجارتی|برند|مدل)') OR {_startswith_sql('s', wl.MAKER_STARTS)} OR list_contains({_list(wl.COUNTRIES)}, s) OR {_startswith_sql('s', wl.COUNTRY_STARTS)}"
    f" OR {_contains_sql('s', wl.PACKING)} OR {_contains_sql('s', wl.PAPER_WEIGHT)} OR {_startswith_sql('s', wl.PART_NUMBER_STARTS)} THEN 'out' WHEN {_startswith_sql('s', wl.BRAND_STARTS)} THEN 'named' WHEN i <= 2 AND regexp_full_match(s, '[A-Za-z][A-Za-z0-9 .&+\\-]*') THEN 'latin' ELSE 'attr' END"
)


def derived_sql(rows: str) -> str:
    """``dv(row_n, ID, RunDate, head, brand, attrs)`` of a table of catalog rows."""
    return f"""fl AS (SELECT *, trim(regexp_replace(DescriptionOfID, '{_WS}', ' ', 'g')) AS flat0, coalesce(Type LIKE '%{wl.SERVICE}', false) AS service FROM {rows} WHERE DescriptionOfID IS NOT NULL),
fm AS (SELECT *, CASE WHEN contains(flat0, '{wl.ADMIN_NOTE}') THEN rtrim(substr(flat0, 1, strpos(flat0, '{wl.ADMIN_NOTE}') - 1), ' /') ELSE flat0 END AS flat FROM fl),
pt AS (SELECT *, list_filter(list_transform(CASE WHEN service THEN string_split(flat, '/') ELSE string_split(regexp_replace(flat, '/\\s*شرکت[^/]*\\z', ''), '،') END, lambda s: trim(s)), lambda s: s <> '') AS parts FROM fm),
sg AS (SELECT row_n, unnest(parts[2:]) AS s, unnest(range(1, len(parts))) AS i FROM pt), kd AS (SELECT row_n, s, i, {_KIND} AS k FROM sg),
br AS (SELECT row_n, min(i) AS i, arg_min(CASE WHEN k = 'named' THEN regexp_replace(s, '^(?:نام تجارتی |[^ ]+ )', '') ELSE s END, i) AS brand FROM kd WHERE k IN ('named', 'latin') GROUP BY row_n),
ats AS (SELECT kd.row_n, list(s ORDER BY kd.i) AS attrs FROM kd LEFT JOIN br USING (row_n) WHERE k <> 'out' AND kd.i IS DISTINCT FROM br.i GROUP BY kd.row_n),
dv AS (SELECT pt.row_n, pt.ID, pt.RunDate, pt.Type, pt.DescriptionOfID, parts[1] AS head, brand, coalesce(attrs, []) AS attrs FROM pt LEFT JOIN br USING (row_n) LEFT JOIN ats USING (row_n))"""


def derived(rows: DataFrame) -> DataFrame:
    return rows.where("DescriptionOfID IS NOT NULL").withColumn("d", wl.derive(F.col("DescriptionOfID"), F.col("Type")))


@query(f"WITH {derived_sql(_BOTH)} SELECT row_n, head, brand, array_to_string(attrs, '|') AS attrs FROM dv")
def derive_title(spark: SparkSession, folder: str) -> DataFrame:
    return derived(both_catalogs(spark, folder)).select("row_n", "d.head", "d.brand", F.array_join("d.attrs", "|").alias("attrs"))


_SHORT = "list_transform({a}, lambda x: array_to_string((string_split(x, ' '))[1:4], ' '))"


def query_sql(n: int) -> str:
    return f"trim(regexp_replace(replace(array_to_string(list_concat([head], CASE WHEN brand IS NULL THEN [] ELSE [brand] END, {_SHORT.format(a=f'attrs[1:{n}]')}), ' '), '،', ' '), '{_WS}', ' ', 'g'))"


@query(f"WITH {derived_sql(_BOTH)} SELECT row_n, {query_sql(1)} AS query_1, {query_sql(2)} AS query_2 FROM dv")
def build_query(spark: SparkSession, folder: str) -> DataFrame:
    return derived(both_catalogs(spark, folder)).select("row_n", wl.build_query(F.col("d"), 1).alias("query_1"), wl.build_query(F.col("d"), 2).alias("query_2"))


_TERMS = f"terms AS (SELECT row_number() OVER (ORDER BY catalog_term, seller_term) AS term_n, {tokens_sql('catalog_term')} AS term, {tokens_sql('seller_term')} AS seller, catalog_term, seller_term FROM head_synonyms)"


def terms(spark: SparkSession, folder: str) -> DataFrame:
    """The synonym pairs, numbered; they are few and their number is that of a hand-made list."""
    from pyspark.sql import Window as W

    s = table(spark, folder, "head_synonyms")
    return s.select(F.row_number().over(W.orderBy("catalog_term", "seller_term")).alias("term_n"), tx.tokenize(F.col("catalog_term")).alias("term"), tx.tokenize(F.col("seller_term")).alias("seller"), "catalog_term", "seller_term")


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """Active rows in force with their derived title and the tokens of its head."""
    rows = cat.active(classified(spark, folder, both=True)).where(cat.in_force(AS_OF))
    return derived(rows).withColumn("head_tokens", tx.tokenize(F.col("d.head")))


_HEADS = f"{classified_sql(_BOTH)}, inf AS (SELECT * FROM act WHERE {_IN_FORCE}), {derived_sql('inf')}, hd AS (SELECT *, {tokens_sql('head')} AS h FROM dv)"


def _assigned(rule: str) -> str:
    test = "h[1:len(term)] = term" if rule == "prefix" else "contains(concat(' ', array_to_string(h, ' '), ' '), concat(' ', array_to_string(term, ' '), ' '))"
    return f"asg AS (SELECT row_n, arg_min(term_n, (-len(term), term_n)) AS term_n FROM hd, terms WHERE len(term) > 0 AND {test} GROUP BY row_n)"


@query(f"WITH {_HEADS}, {_TERMS}, {_assigned('prefix')} SELECT row_n, CAST(term_n AS INTEGER) AS term_n FROM asg")
def head_assign_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return wl.assign_terms(heads(spark, folder), "row_n", "head_tokens", terms(spark, folder), "prefix").select("row_n", "term_n")


@query(f"WITH {_HEADS}, {_TERMS}, {_assigned('contains')} SELECT row_n, CAST(term_n AS INTEGER) AS term_n FROM asg")
def head_assign_contains(spark: SparkSession, folder: str) -> DataFrame:
    return wl.assign_terms(heads(spark, folder), "row_n", "head_tokens", terms(spark, folder), "contains").select("row_n", "term_n")


@query(f"WITH {_HEADS}, {_TERMS} SELECT catalog_term, seller_term, (SELECT count(*) FROM hd WHERE len(term) > 0 AND h[1:len(term)] = term) AS n_rows FROM terms")
def head_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """How many heads begin with each listed term; terms without any are kept."""
    return coverage(spark, folder).select("catalog_term", "seller_term", "n_rows")


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    t = terms(spark, folder)
    spans = t.select(F.size("term").alias("n")).distinct().agg(F.collect_set("n").alias("ls"))
    begun = heads(spark, folder).select("ID", "head_tokens").crossJoin(F.broadcast(spans))  # one row
    cut = F.explode(F.transform(F.filter("ls", lambda x: x <= F.size("head_tokens")), lambda x: F.array_join(F.slice("head_tokens", 1, x), " "))).alias("span")
    by_id = begun.select("ID", cut).groupBy("span", "ID").agg(F.count(F.lit(1)).alias("n"))
    by = by_id.groupBy("span").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"))
    named = t.withColumn("span", F.array_join("term", " "))
    return named.join(by, "span", "left").select("catalog_term", "seller_term", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"))


@query(f"WITH {_HEADS}, {_TERMS} SELECT catalog_term, seller_term, count(hd.row_n) AS n_rows, count(DISTINCT ID) AS n_ids, CASE WHEN count(hd.row_n) = 0 THEN 'zero' ELSE 'covered' END AS status FROM terms LEFT JOIN hd ON h[1:len(term)] = term GROUP BY ALL")
def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(spark, folder).withColumn("status", F.when(F.col("n_rows") == 0, "zero").otherwise("covered"))


@query(f"WITH {_TERMS}, k AS (SELECT catalog_term, seller_term, array_to_string(term, ' ') AS a, array_to_string(seller, ' ') AS b FROM terms) SELECT catalog_term, seller_term, CASE WHEN a = '' OR b = '' THEN 'empty' WHEN a = b THEN 'identical' WHEN count(*) OVER (PARTITION BY a, b) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM k")
def synonym_validate(spark: SparkSession, folder: str) -> DataFrame:
    k = terms(spark, folder).select("catalog_term", "seller_term", F.array_join("term", " ").alias("a"), F.array_join("seller", " ").alias("b"))
    n = k.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when((F.col("a") == "") | (F.col("b") == ""), "empty").when(F.col("a") == F.col("b"), "identical").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return k.join(n, ["a", "b"]).select("catalog_term", "seller_term", verdict.alias("verdict"))


@query(f"WITH {_HEADS}, {_TERMS}, {_assigned('prefix')} SELECT row_n, array_to_string(list_concat(seller, h[len(term) + 1:]), ' ') AS substituted FROM asg JOIN hd USING (row_n) JOIN terms USING (term_n)")
def substitute_head(spark: SparkSession, folder: str) -> DataFrame:
    """Heads with the catalog's term replaced by the sellers'."""
    return _substituted(spark, folder).select("row_n", F.array_join("sub", " ").alias("substituted"))


def _substituted(spark: SparkSession, folder: str) -> DataFrame:
    h, t = heads(spark, folder), terms(spark, folder)
    a = wl.assign_terms(h, "row_n", "head_tokens", t, "prefix").select("row_n", "term_n")
    rest = F.slice("head_tokens", F.size("term") + 1, F.size("head_tokens"))
    return h.join(a, "row_n").join(t, "term_n").withColumn("sub", F.concat("seller", rest))


_LADDER = f"""{_HEADS}, {_TERMS}, {_assigned('prefix')}, sb AS (SELECT row_n, ID, list_concat(seller, h[len(term) + 1:]) AS sub, CASE WHEN brand IS NULL THEN [] ELSE {tokens_sql('brand')} END AS b, CASE WHEN len(attrs) > 0 THEN {tokens_sql("array_to_string((string_split(attrs[1], ' '))[1:4], ' ')")} ELSE [] END AS a1,
  CASE WHEN len(attrs) > 1 THEN {tokens_sql("array_to_string((string_split(attrs[2], ' '))[1:4], ' ')")} ELSE [] END AS a2, len(attrs) AS n, term_n FROM asg JOIN hd USING (row_n) JOIN terms USING (term_n)),
ld AS (SELECT row_n, ID, term_n, 'L1' AS level, sub AS q FROM sb UNION ALL SELECT row_n, ID, term_n, 'L2', list_concat(sub, a1) FROM sb WHERE n > 0 UNION ALL SELECT row_n, ID, term_n, 'L3', list_concat(sub, a1, a2) FROM sb WHERE n > 1 UNION ALL SELECT row_n, ID, term_n, 'L4', list_concat(sub, b, a1, a2) FROM sb WHERE len(b) > 0)"""


def ladder(spark: SparkSession, folder: str) -> DataFrame:
    s = _substituted(spark, folder)
    return s.select("row_n", "ID", "term_n", F.explode(wl.detail_ladder(F.col("d"), F.col("sub"))).alias("l")).select("row_n", "ID", "term_n", "l.level", "l.query", "l.required")


@query(f"WITH {_LADDER} SELECT row_n, level, array_to_string(q, ' ') AS query FROM ld")
def detail_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return ladder(spark, folder).select("row_n", "level", F.array_join("query", " ").alias("query"))


@query(f"WITH {_LADDER}, t AS (SELECT term_n, level, array_to_string(q, ' ') AS query, row_n FROM ld) SELECT CAST(term_n AS INTEGER) AS term_n, level, query, min(row_n) AS row_n, count(*) - 1 AS n_duplicates FROM t GROUP BY ALL")
def ladder_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first row with each query of a pair and level, and how many more there were."""
    l = ladder(spark, folder).withColumn("query", F.array_join("query", " "))
    return l.groupBy("term_n", "level", "query").agg(F.min("row_n").alias("row_n"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))


PER_PAIR = 10


@query(f"WITH {_HEADS}, {_TERMS}, {_assigned('prefix')}, x AS (SELECT term_n, row_n, array_to_string(h, ' ') AS hh FROM asg JOIN hd USING (row_n)), a AS (SELECT *, row_number() OVER (PARTITION BY term_n, hh ORDER BY row_n) AS rd FROM x QUALIFY rd <= {PER_PAIR}) SELECT CAST(term_n AS INTEGER) AS term_n, row_n, CAST(row_number() OVER (PARTITION BY term_n ORDER BY rd, row_n) AS INTEGER) AS place FROM a QUALIFY place <= {PER_PAIR}")
def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Ten rows of each pair, its heads in turn."""
    s = _substituted(spark, folder).select("term_n", "row_n", F.array_join("head_tokens", " ").alias("hh"))
    return wl.round_robin(s, "term_n", "hh", [F.col("row_n")], PER_PAIR).select("term_n", "row_n", "place")


PER_CELL = 25
_POOL = f"pool AS (SELECT row_n, ID, coalesce(Type, '') AS cell, DescriptionOfID, CAST(row_number() OVER (PARTITION BY coalesce(Type, '') ORDER BY row_n) AS INTEGER) AS place FROM act WHERE {_IN_FORCE} AND regexp_full_match(ID, '[0-9]{{13}}') AND DescriptionOfID IS NOT NULL QUALIFY place <= {PER_CELL})"


def pool(spark: SparkSession, folder: str) -> DataFrame:
    rows = cat.active(classified(spark, folder, both=True)).where(cat.in_force(AS_OF) & is_id(F.col("ID")) & F.col("DescriptionOfID").isNotNull()).withColumn("cell", F.coalesce("Type", F.lit("")))
    return wl.stratified(rows, ["cell"], [F.col("row_n")], PER_CELL)


@query(f"WITH {classified_sql(_BOTH)}, {_POOL} SELECT row_n, cell, place FROM pool")
def stratified_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The first eligible rows of each type."""
    return pool(spark, folder).select("row_n", "cell", "place")


QUOTA = 10


def _walk_sql(rows: str) -> str:
    """Cells in order; of each its distinct queries by their first row, less those accepted before, up to the quota: ``walked(cell, row_n, q, place)`` of a
    table ``(cell, row_n, q)``."""
    return f"""fq AS (SELECT cell, min(row_n) AS row_n, q FROM {rows} WHERE q IS NOT NULL GROUP BY cell, q),
cl AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i, list({{'row_n': row_n, 'q': q}} ORDER BY row_n, q) AS own FROM fq GROUP BY cell),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS cell, CAST([] AS STRUCT(row_n BIGINT, q VARCHAR)[]) AS got
  UNION ALL SELECT i, list_concat(used, list_transform(got, lambda x: x.q)), cell, got FROM (SELECT cl.i, w.used, cl.cell, list_filter(cl.own, lambda x: NOT list_contains(w.used, x.q))[1:{QUOTA}] AS got FROM walk w JOIN cl ON cl.i = w.i + 1)),
walked AS (SELECT cell, g.row_n AS row_n, g.q AS q, CAST(place AS INTEGER) AS place FROM (SELECT cell, unnest(got) AS g, unnest(range(1, len(got) + 1)) AS place FROM walk))"""


@query(f"WITH RECURSIVE {classified_sql(_BOTH)}, {_POOL}, {derived_sql('(SELECT a.* FROM act a JOIN pool USING (row_n))')}, qq AS (SELECT cell, row_n, {query_sql(1)} AS q FROM dv JOIN pool USING (row_n)), {_walk_sql('qq')} SELECT cell, row_n, q AS query, place FROM walked")
def quota_emit(spark: SparkSession, folder: str) -> DataFrame:
    """The first accepted queries of each cell until its quota; a query of an earlier cell is a duplicate."""
    q = pool(spark, folder).withColumn("d", wl.derive(F.col("DescriptionOfID"), F.col("Type"))).select("cell", "row_n", F.lit(QUOTA).alias("quota"), wl.build_query(F.col("d"), 1).alias("query"))
    return wl.emit_until(q, "cell", "quota", "query", "row_n")


PLACES, FLOOR = 300, 5


#: Cells below their floor are fixed step by step, then the largest remainder rounds.
@query(
    f"""WITH RECURSIVE {classified_sql(_BOTH)}, sz AS (SELECT coalesce(Type, '') AS cell, CAST(least(len({tokens_sql('DescriptionOfID')}), 12) AS INTEGER) AS length, count(*) AS size FROM act WHERE {_IN_FORCE} AND DescriptionOfID IS NOT NULL GROUP BY ALL),
st AS (SELECT 0 AS step, list({{'cell': cell, 'length': length, 'size': size, 'fix': CAST(NULL AS BIGINT)}} ORDER BY cell, length) AS cs, least({PLACES}, CAST(sum(size) AS BIGINT)) AS total, TRUE AS more FROM sz
  UNION ALL SELECT step + 1, new, total, new <> cs FROM (SELECT step, cs, total, list_transform(cs, lambda x: {{'cell': x.cell, 'length': x.length, 'size': x.size, 'fix': CASE WHEN x.fix IS NULL AND budget * x.size < least({FLOOR}, x.size) * whole THEN least({FLOOR}, x.size) ELSE x.fix END}}) AS new
    FROM (SELECT *, total - coalesce(list_sum(list_transform(cs, lambda x: coalesce(x.fix, 0))), 0) AS budget, list_sum(list_transform(cs, lambda x: CASE WHEN x.fix IS NULL THEN x.size ELSE 0 END)) AS whole FROM st WHERE more))),
cq AS (SELECT x.cell AS cell, x.length AS length, x.size AS size, x.fix AS fix, total FROM (SELECT unnest(cs) AS x, total FROM st ORDER BY step DESC LIMIT (SELECT count(*) FROM sz))),
e AS (SELECT *, CAST(total - coalesce(sum(fix) OVER (), 0) AS BIGINT) AS budget, CAST(sum(CASE WHEN fix IS NULL THEN size END) OVER () AS BIGINT) AS whole FROM cq),
r AS (SELECT *, coalesce(fix, budget * size // whole) AS base, row_number() OVER (ORDER BY fix IS NOT NULL, -(budget * size % whole), cell, length) AS place FROM e)
SELECT cell, length, size, CAST(base + CASE WHEN fix IS NULL AND place <= total - (SELECT sum(base) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS places FROM r"""
)
def quota_allocate(spark: SparkSession, folder: str) -> DataFrame:
    """Places over the cells (type, length) by largest remainder with a floor; an iteration over a table of cells."""
    rows = cat.active(classified(spark, folder, both=True)).where(cat.in_force(AS_OF) & F.col("DescriptionOfID").isNotNull())
    sizes = rows.groupBy(F.coalesce("Type", F.lit("")).alias("cell"), F.least(F.size(tx.tokenize(F.col("DescriptionOfID"))), F.lit(12)).alias("length")).agg(F.count(F.lit(1)).alias("size"))
    held = {(r.cell, r.length): r.size for r in sizes.collect()}  # types x 12
    got = wl.allocate(held, PLACES, FLOOR)
    return spark.createDataFrame([(c, n, held[c, n], got[c, n]) for c, n in sorted(held)], "cell string, length int, size long, places long")


_TITLES = f"tt AS (SELECT DISTINCT ID, list_sort(list_distinct({tokens_sql('DescriptionOfID')})) AS t FROM act WHERE {_IN_FORCE} AND DescriptionOfID IS NOT NULL)"


def titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = cat.active(classified(spark, folder, both=True)).where(cat.in_force(AS_OF) & F.col("DescriptionOfID").isNotNull())
    return rows.select("row_n", "ID", tx.tokenize(F.col("DescriptionOfID")).alias("tokens"), "DescriptionOfID", "Type")


@query(f"WITH {classified_sql(_BOTH)}, {_TITLES}, {derived_sql(f'(SELECT * FROM act WHERE {_IN_FORCE} AND row_n % 50 = 0)')}, qq AS (SELECT row_n, list_distinct({tokens_sql(query_sql(1))}) AS q FROM dv) SELECT row_n, (SELECT count(DISTINCT ID) FROM tt WHERE len(q) > 0 AND list_has_all(t, q)) AS n_ids FROM qq")
def token_subset_match(spark: SparkSession, folder: str) -> DataFrame:
    """How many IDs a query made from a title (row numbers divisible by 50) can mean, against all titles."""
    t = titles(spark, folder)
    q = t.where("row_n % 50 = 0").select("row_n", tx.tokenize(wl.build_query(wl.derive(F.col("DescriptionOfID"), F.col("Type")), 1)).alias("wanted"))
    return wl.subset_matches(t, "ID", "tokens", q, "row_n", "wanted")


_CATEGORIES = {
    "unique_with_all_attrs": "a", "needs_mfr_or_partno": "NOT a AND (m OR p)", "unique_under_none": "NOT a AND NOT m AND NOT p", "mfr_only": "NOT a AND m AND NOT p", "partno_only": "NOT a AND p AND NOT m",
    "either": "NOT a AND m AND p", "has_mfr": "has_m", "has_partno": "has_p",
}


@query(
    f"""WITH {_HEADS}, t1 AS MATERIALIZED (SELECT row_n, ID, head, brand, attrs, trim(regexp_replace(DescriptionOfID, '{_WS}', ' ', 'g')) AS flat, coalesce(Type LIKE '%{wl.SERVICE}', false) AS service, {tokens_sql('DescriptionOfID')} AS t FROM hd WHERE regexp_full_match(ID, '[0-9]{{13}}')),
t2 AS (SELECT *, list_transform(CASE WHEN service THEN string_split(flat, '/') ELSE string_split(flat, '،') END, lambda s: trim(s)) AS parts, array_to_string(list_filter(list_concat([head, brand], attrs), lambda x: x IS NOT NULL), ' ') AS base FROM t1),
t3 AS (SELECT *, array_to_string(list_filter(parts, lambda s: {_startswith_sql('s', wl.MAKER_STARTS)}), ' ') AS named, array_to_string(list_filter(parts, lambda s: {_startswith_sql('s', wl.PART_NUMBER_STARTS)}), ' ') AS part FROM t2),
t4 AS (SELECT *, CASE WHEN named <> '' THEN named ELSE regexp_extract(flat, '/\\s*(شرکت[^/]*)\\z', 1) END AS maker FROM t3),
asked AS (SELECT row_n, base AS a, CASE WHEN maker <> '' THEN base || ' ' || maker END AS m, CASE WHEN part <> '' THEN base || ' ' || part END AS p FROM t4),
qs AS MATERIALIZED (SELECT query, list_distinct({tokens_sql('query')}) AS w FROM (SELECT a AS query FROM asked UNION SELECT m FROM asked UNION SELECT p FROM asked) WHERE query IS NOT NULL),
n AS MATERIALIZED (SELECT query, count(DISTINCT ID) = 1 AS one FROM qs JOIN t1 ON len(w) > 0 AND list_has_all(t, w) GROUP BY query),
r AS (SELECT coalesce(x.one, false) AS a, coalesce(y.one, false) AS m, coalesce(z.one, false) AS p, m IS NOT NULL AS has_m, p IS NOT NULL AS has_p FROM asked LEFT JOIN n x ON x.query = a LEFT JOIN n y ON y.query = m LEFT JOIN n z ON z.query = p)
SELECT category, n, round(n / nullif(total, 0), 4) AS share FROM (SELECT unnest([{", ".join(f"'{k}'" for k in _CATEGORIES)}]) AS category, unnest([{", ".join(f"count(*) FILTER ({c})" for c in _CATEGORIES.values())}]) AS n, count(*) AS total FROM r)"""
)
def ambiguity_categories(spark: SparkSession, folder: str) -> DataFrame:
    """What a title in force needs to name one ID among all: head, brand and all attributes, the maker or part number too, or more.

    ``(category, n, share)``: ``unique_with_all_attrs``, ``needs_mfr_or_partno`` and ``unique_under_none`` of all titles; the second split into
    ``mfr_only``, ``partno_only`` and ``either``; and the titles that have a maker (``has_mfr``) or part number (``has_partno``).  Shares are of
    all titles, null without any.
    """
    h = stage_table(heads(spark, folder).where(is_id(F.col("ID"))).select("row_n", "ID", "d", "DescriptionOfID", "Type", tx.tokenize(F.col("DescriptionOfID")).alias("tokens")), "ambiguity_titles")
    asked = stage_table(h.select("row_n", wl.detail_queries(F.col("DescriptionOfID"), F.col("Type"), F.col("d")).alias("q")).select("row_n", "q.*"), "ambiguity_queries")
    names = ["all_attrs", "mfr", "partno"]
    each = asked.select("row_n", F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("query")) for v in names))).alias("v")).select("row_n", "v.*").where("query IS NOT NULL")
    n = wl.subset_matches(h, "ID", "tokens", each.select("query").distinct().withColumn("w", tx.tokenize(F.col("query"))), "query", "w")
    one = lambda v: F.coalesce(F.max(F.when(F.col("variant") == v, F.col("n_ids") == 1)), F.lit(False)).alias(v)
    has = lambda v: F.coalesce(F.max(F.col("variant") == v), F.lit(False)).alias(f"has_{v}")
    rows = each.join(n, "query").groupBy("row_n").agg(*(one(v) for v in names), *(has(v) for v in names[1:]))
    a, m, p = (F.col(v) for v in names)
    said = {"unique_with_all_attrs": a, "needs_mfr_or_partno": ~a & (m | p), "unique_under_none": ~a & ~m & ~p, "mfr_only": ~a & m & ~p, "partno_only": ~a & p & ~m, "either": ~a & m & p, "has_mfr": F.col("has_mfr"), "has_partno": F.col("has_partno")}
    counts = rows.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(c).alias(k) for k, c in said.items()))  # one row
    listed = counts.select("all", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in said))).alias("x"))
    return listed.select("x.category", "x.n", F.when(F.col("all") > 0, F.round(F.col("x.n") / F.col("all"), 4)).alias("share"))


@query(f"WITH {classified_sql(_BOTH)}, g AS (SELECT DISTINCT ID AS gid, {tokens_sql('DescriptionOfID')} AS t FROM act WHERE contains(Type, 'عمومی')), f AS (SELECT ID, arg_min(DescriptionOfID, (RunDate, row_n)) AS d FROM act WHERE NOT contains(Type, 'عمومی') GROUP BY ID), s AS (SELECT ID, {tokens_sql('d')} AS t FROM f) SELECT DISTINCT gid AS general_id, ID AS specific_id FROM g JOIN s ON len(g.t) > 0 AND len(s.t) > len(g.t) AND s.t[1] = g.t[1] AND s.t[1:len(g.t)] = g.t")
def prefix_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """General IDs whose title is a proper prefix of a specific ID's first title: an equi-join on the spans of lengths that exist."""
    rows = cat.active(classified(spark, folder, both=True))
    general = rows.where(cat.is_general(F.col("Type"))).select(F.col("ID").alias("general_id"), tx.tokenize(F.col("DescriptionOfID")).alias("t")).where(F.size("t") > 0).distinct()
    lengths = general.agg(F.collect_set(F.size("t")).alias("ls"))  # one row of small numbers
    first = rows.where(~cat.is_general(F.col("Type"))).groupBy(F.col("ID").alias("specific_id")).agg(F.min(F.struct("RunDate", "row_n", "DescriptionOfID")).alias("f"))
    s = first.select("specific_id", tx.tokenize(F.col("f.DescriptionOfID")).alias("s")).crossJoin(F.broadcast(lengths))
    spans = s.select("specific_id", F.explode(F.transform(F.filter("ls", lambda x: x < F.size("s")), lambda x: F.array_join(F.slice("s", 1, x), " "))).alias("span"))
    return general.select("general_id", F.array_join("t", " ").alias("span")).join(spans, "span").select("general_id", "specific_id").distinct()


@query(f"WITH {_HEADS}, v AS (SELECT row_n, h[1] AS w, TRY_CAST(trim(Vat) AS DECIMAL(18,6)) AS rate FROM hd JOIN (SELECT row_n, Vat FROM inf) USING (row_n) WHERE len(h) > 0) SELECT row_n, (SELECT count(*) FROM v b WHERE b.w = a.w AND b.rate <> a.rate) AS n_other_rate FROM v a")
def same_head_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows with the same first word have another rate: counted by word and rate, no pairs are made."""
    h = heads(spark, folder).where(F.size("head_tokens") > 0).select("row_n", F.try_element_at("head_tokens", F.lit(1)).alias("w"), F.expr("try_cast(trim(Vat) AS decimal(18,6))").alias("rate"))
    by = h.groupBy("w", "rate").agg(F.count(F.lit(1)).alias("n"))
    whole = by.where("rate IS NOT NULL").groupBy("w").agg(F.sum("n").alias("all"))
    counts = by.join(whole, "w", "left").select("w", F.col("rate").alias("r"), F.when(F.col("rate").isNull(), 0).otherwise(F.coalesce("all", F.lit(0)) - F.col("n")).alias("n_other_rate"))
    from tarazu.operators.skew import salted_join

    keyed = h.select("row_n", "w", F.coalesce(F.col("rate").cast("string"), F.lit("none")).alias("r"))
    return salted_join(keyed, counts.withColumn("r", F.coalesce(F.col("r").cast("string"), F.lit("none"))), ["w", "r"], [F.col("row_n")]).select("row_n", "n_other_rate")


@query(f"WITH {_LADDER}, o AS (SELECT DISTINCT term_n, ID FROM ld), begun AS (SELECT DISTINCT term_n, ID FROM hd, terms WHERE len(seller) > 0 AND h[1:len(seller)] = seller) SELECT CAST(term_n AS INTEGER) AS term_n, count(*) AS n_ids FROM (SELECT * FROM o UNION SELECT * FROM begun) GROUP BY term_n")
def set_union_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptable IDs of each pair: those under the catalog's term and those that begin with the sellers' already."""
    own = _substituted(spark, folder).select("term_n", "ID")
    t = terms(spark, folder).where(F.size("seller") > 0).select("term_n", F.col("seller").alias("term"))
    begun = heads(spark, folder).select("ID", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("head_tokens"), F.lit(1))), lambda n: F.array_join(F.slice("head_tokens", 1, n), " "))).alias("p", "span"))
    seller = begun.join(t.withColumn("span", F.array_join("term", " ")), "span").select("term_n", "ID")
    return own.unionByName(seller).distinct().groupBy("term_n").agg(F.count(F.lit(1)).alias("n_ids"))


@query("SELECT ID FROM fake_catalog WHERE ID IS NOT NULL INTERSECT SELECT sstid FROM demo_invoices")
def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fake_catalog").where("ID IS NOT NULL").select("ID").intersect(table(spark, folder, "demo_invoices").select("sstid"))


@query("SELECT sstid FROM demo_invoices WHERE sstid IS NOT NULL EXCEPT SELECT ID FROM " + _BOTH)
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """IDs that lines declare and no catalog has."""
    return table(spark, folder, "demo_invoices").where("sstid IS NOT NULL").select("sstid").subtract(both_catalogs(spark, folder).select("ID"))


@query("SELECT tier, count(*) AS n FROM (SELECT tier FROM eval_golden WHERE tier = 'S' UNION ALL SELECT tier FROM eval_golden WHERE tier = 'C' UNION ALL SELECT 'combined' FROM eval_golden) GROUP BY tier")
def set_union_all(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "eval_golden").select("tier")
    return g.where("tier = 'S'").unionByName(g.where("tier = 'C'")).unionByName(g.select(F.lit("combined").alias("tier"))).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def _units_sql(c: str, scale: int) -> str:
    """A plain number in units of its last place, as a whole number."""
    return f"CAST(string_split({c} || '.', '.')[1] || rpad(string_split({c} || '.', '.')[2], {scale}, '0') AS HUGEINT)"


#: The product is made of two parts, as it can have more digits than a whole number holds: with the fee's last ten digits and with those before.
@query(
    f"""WITH v AS (SELECT DISTINCT line_id, {_units_sql('am', 6)} * {_units_sql('vra', 4)} AS av, {_units_sql('fee', 6)} AS f FROM demo_invoices
  WHERE regexp_full_match(am, '[0-9]{{1,14}}(\\.[0-9]{{1,6}})?') AND regexp_full_match(fee, '[0-9]{{1,14}}(\\.[0-9]{{1,6}})?') AND regexp_full_match(vra, '[0-9]{{1,5}}(\\.[0-9]{{1,4}})?')),
p AS (SELECT line_id, av * (f // 10000000000) AS hi, av * (f % 10000000000) AS lo FROM v), h AS (SELECT line_id, hi + lo // 10000000000 AS h, lo % 10000000000 AS r FROM p),
x AS (SELECT line_id, h // 100000000 AS q, (h % 100000000) * 10000000000 + r AS rest FROM h)
SELECT line_id, CAST(q + CASE WHEN rest >= 500000000000000000 THEN 1 ELSE 0 END AS DOUBLE) AS half_up, CAST(q AS DOUBLE) AS down, CAST(q + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS DOUBLE) AS up FROM x"""
)
def rounding_modes(spark: SparkSession, folder: str) -> DataFrame:
    """A product of exact decimals divided by 100, rounded half up, down and up to a whole number, of all lines with a usable ``am``, ``fee``
    and ``vra``; those that have none are in ``line_parse``."""
    n = line_numbers()
    lines = table(spark, folder, "demo_invoices").select("line_id", *(n[c].alias(c) for c in ("am", "fee", "vra"))).where("am IS NOT NULL AND fee IS NOT NULL AND vra IS NOT NULL")
    r = lines.select("line_id", percent_of(F.col("am"), F.col("fee"), F.col("vra")).alias("r"))
    return r.select("line_id", *(F.col(f"r.{c}").cast("double").alias(c) for c in ("half_up", "down", "up"))).distinct()


MOST = 20  # IDs that a query may mean
_JOINED = lambda c: f"array_to_string({c}, ' ')"
_PADDED = lambda c: f"concat(' ', array_to_string({c}, ' '), ' ')"


def _tried_sql(n: int, when: str) -> str:
    head = f"trim(concat(substr(whole, 1, strpos(whole, found)), {_JOINED('seller')}, substr(whole, strpos(whole, found) + length(found) - 1)))"
    return f"SELECT term_n, row_n, least({n}, len(attrs)) AS n, (SELECT {query_sql(n)} FROM (SELECT {_JOINED('h')} AS head)) AS catalog, (SELECT {query_sql(n)} FROM (SELECT {head} AS head)) AS query FROM picked WHERE {when}"


@query(
    f"""WITH {_HEADS}, {_TERMS}, hm AS MATERIALIZED (SELECT row_n, ID, h, brand, attrs, list_distinct({tokens_sql('DescriptionOfID')}) AS t FROM hd),
listed AS MATERIALIZED (SELECT *, len(term) > 0 AND len(seller) > 0 AND term <> seller AS fine FROM terms), pairs AS (SELECT * FROM listed WHERE fine),
own AS (SELECT row_n, arg_min(term, (-len(term), term_n)) AS term FROM hm, pairs WHERE contains({_PADDED('h')}, {_PADDED('term')}) GROUP BY row_n),
members AS MATERIALIZED (SELECT hm.*, pairs.term_n, pairs.term, pairs.seller, {_PADDED('h')} AS whole, {_PADDED('pairs.term')} AS found FROM hm JOIN own USING (row_n) JOIN pairs ON pairs.term = own.term),
picked AS MATERIALIZED (SELECT * FROM members WHERE ID IN (SELECT ID FROM hm GROUP BY ID HAVING count(*) = 1) QUALIFY row_number() OVER (PARTITION BY term_n ORDER BY md5(concat(row_n, '|', term_n)), row_n) <= {PER_PAIR}),
cand AS MATERIALIZED ({_tried_sql(1, 'true')} UNION ALL {_tried_sql(2, 'len(attrs) > 1')}),
texts AS MATERIALIZED (SELECT text, list_distinct({tokens_sql('text')}) AS w FROM (SELECT catalog AS text FROM cand UNION SELECT query FROM cand)),
ids AS MATERIALIZED (SELECT DISTINCT text, ID FROM texts JOIN hm ON len(w) > 0 AND list_has_all(t, w)),
sides AS (SELECT DISTINCT catalog, query FROM cand), met AS (SELECT catalog, query, ID, 1 AS c, 0 AS s FROM sides JOIN ids ON text = catalog UNION ALL SELECT catalog, query, ID, 0, 1 FROM sides JOIN ids ON text = query),
counted AS (SELECT catalog, query, count(DISTINCT ID) AS n_label, count(DISTINCT ID) FILTER (s = 1) AS n_seller, count(DISTINCT ID) FILTER (c = 1) AS n_catalog FROM met GROUP BY ALL),
best AS (SELECT term_n, row_n, n, query, coalesce(n_seller, 0) AS n_seller, coalesce(n_catalog, 0) AS n_catalog, coalesce(n_label, 0) AS n_label FROM cand LEFT JOIN counted USING (catalog, query)
  QUALIFY row_number() OVER (PARTITION BY term_n, row_n ORDER BY CASE WHEN coalesce(n_label, 0) = 1 THEN n ELSE 10 - n END) = 1),
main AS (SELECT term_n, 'A' || n AS level, query, row_n, n_seller, n_catalog, n_label, CASE WHEN n_label > {MOST} THEN 'over_max' WHEN row_number() OVER (PARTITION BY query, n_label > {MOST} ORDER BY term_n, row_n) > 1 THEN 'duplicate' ELSE 'emitted' END AS verdict FROM best),
cls AS (SELECT term_n, ID, 1 AS c, 0 AS s FROM members UNION ALL SELECT term_n, ID, 0, 1 FROM hm JOIN pairs ON h[1:len(seller)] = seller),
cn AS (SELECT term_n, count(DISTINCT ID) AS n_label, count(DISTINCT ID) FILTER (s = 1) AS n_seller, count(DISTINCT ID) FILTER (c = 1) AS n_catalog FROM cls GROUP BY term_n),
bare AS (SELECT term_n, 'head' AS level, {_JOINED('seller')} AS query, NULL AS row_n, coalesce(n_seller, 0) AS n_seller, coalesce(n_catalog, 0) AS n_catalog, coalesce(n_label, 0) AS n_label, CASE WHEN NOT fine THEN 'invalid' WHEN coalesce(n_catalog, 0) = 0 THEN 'zero_coverage' ELSE 'emitted' END AS verdict FROM listed LEFT JOIN cn USING (term_n))
SELECT CAST(term_n AS INTEGER) AS term_n, level, query, row_n, n_seller, n_catalog, n_label, verdict, CASE WHEN verdict = 'emitted' THEN CASE WHEN n_label = 1 THEN 'S' ELSE 'C' END END AS tier FROM (SELECT * FROM main UNION ALL SELECT * FROM bare)"""
)
def silver_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Queries in the sellers' words, up to ten rows of each pair and its bare term.

    Level ``A0``-``A2``: head, brand and so many attributes of a row drawn by hash among those whose ID has one row in force and whose head holds
    the pair's term, the term replaced; one attribute is tried before two, and kept if it means one ID.  It may mean the IDs with
    all of its words as the seller or as the catalog writes it (``n_label``).  Level ``head``: the sellers' term alone, for every pair; the IDs
    whose head is the pair's or begins with the sellers' term.  ``verdict``: ``emitted``, ``over_max``, ``duplicate``, ``zero_coverage`` (no
    head holds the term) or ``invalid`` (a term is empty or both are alike); ``tier`` is null for all but the first.
    """
    # Read several times below.
    h, t = stage_table(heads(spark, folder).select("row_n", "ID", "d", "head_tokens", tx.tokenize(F.col("DescriptionOfID")).alias("tokens")), "silver_v2_heads"), terms(spark, folder)
    fine = (F.size("term") > 0) & (F.size("seller") > 0) & (F.col("term") != F.col("seller"))
    pairs = t.where(fine).select("term_n", "term", "seller")
    # Pairs of one term have the same rows.
    of = wl.assign_terms(h, "row_n", "head_tokens", pairs, "contains").select("row_n", "term")
    members = h.join(of, "row_n").join(F.broadcast(pairs), "term")
    single = h.groupBy("ID").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    picked = wl.stratified(members.join(single, "ID", "left_semi"), ["term_n"], [F.md5(F.concat_ws("|", "row_n", "term_n")), F.col("row_n")], PER_PAIR)
    written = lambda head, n: wl.build_query(F.struct(head.alias("head"), F.col("d.brand").alias("brand"), F.col("d.attrs").alias("attrs")), n)
    sub = wl.replace_run(F.col("head_tokens"), F.col("term"), F.col("seller"))
    step = lambda n: F.struct(F.least(F.lit(n), F.size("d.attrs")).alias("n"), written(F.array_join("head_tokens", " "), n).alias("catalog"), written(sub, n).alias("query"))
    tries = F.when(F.size("d.attrs") > 1, F.array(step(1), step(2))).otherwise(F.array(step(1)))
    cand = stage_table(picked.select("term_n", "row_n", F.explode(tries).alias("q")).select("term_n", "row_n", "q.*"), "silver_v2")
    texts = cand.select(F.explode(F.array("catalog", "query")).alias("text")).distinct().withColumn("w", tx.tokenize(F.col("text")))
    ids = wl.subset_ids(h, "ID", "tokens", texts, "text", "w")
    sides = cand.select("catalog", "query").distinct().select("catalog", "query", F.explode(F.array(F.struct(F.col("catalog").alias("text"), F.lit(0).alias("seller")), F.struct(F.col("query").alias("text"), F.lit(1).alias("seller")))).alias("s"))
    met = sides.select("catalog", "query", "s.*").join(ids, "text").groupBy("catalog", "query", "__id").agg(F.min("seller").alias("a"), F.max("seller").alias("b"))
    counted = met.groupBy("catalog", "query").agg(F.count(F.lit(1)).alias("n_label"), F.sum("b").alias("n_seller"), F.sum(1 - F.col("a")).alias("n_catalog"))
    order = F.when(F.col("n_label") == 1, F.col("n")).otherwise(10 - F.col("n"))
    found = cand.join(counted, ["catalog", "query"], "left").fillna(0, ["n_label", "n_seller", "n_catalog"])
    best = found.groupBy("term_n", "row_n").agg(F.min_by(F.struct("n", "query", "n_seller", "n_catalog", "n_label"), order).alias("b")).select("term_n", "row_n", "b.*")
    over = F.col("n_label") > MOST
    place = F.row_number().over(Window.partitionBy("query", over).orderBy("term_n", "row_n"))
    main = best.select("term_n", F.concat(F.lit("A"), "n").alias("level"), "query", "row_n", "n_seller", "n_catalog", "n_label", F.when(over, "over_max").when(place > 1, "duplicate").otherwise("emitted").alias("verdict"))

    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("head_tokens"), F.lit(1))), lambda n: F.array_join(F.slice("head_tokens", 1, n), " "))
    begun = h.select("ID", F.explode(prefixes).alias("span")).join(F.broadcast(pairs.select("term_n", F.array_join("seller", " ").alias("span"))), "span")
    own = members.select("term_n", "ID", F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(begun.select("term_n", "ID", F.lit(0).alias("c"), F.lit(1).alias("s")))
    classes = own.groupBy("term_n", "ID").agg(F.max("c").alias("c"), F.max("s").alias("s")).groupBy("term_n").agg(F.sum("s").alias("n_seller"), F.sum("c").alias("n_catalog"), F.count(F.lit(1)).alias("n_label"))
    listed = t.select("term_n", fine.alias("fine"), F.array_join("seller", " ").alias("query")).join(classes, "term_n", "left").fillna(0, ["n_seller", "n_catalog", "n_label"])
    said = F.when(~F.col("fine"), "invalid").when(F.col("n_catalog") == 0, "zero_coverage").otherwise("emitted")
    bare = listed.select("term_n", F.lit("head").alias("level"), "query", F.lit(None).cast(dict(h.dtypes)["row_n"]).alias("row_n"), "n_seller", "n_catalog", "n_label", said.alias("verdict"))
    return main.unionByName(bare).withColumn("tier", F.when(F.col("verdict") == "emitted", F.when(F.col("n_label") == 1, "S").otherwise("C")))



@query(
    f"""WITH RECURSIVE {classified_sql(_BOTH)}, {_TITLES}, {_POOL}, {derived_sql('(SELECT a.* FROM act a JOIN pool USING (row_n))')}, qq AS (SELECT cell, row_n, {query_sql(1)} AS q FROM dv JOIN pool USING (row_n)),
m AS (SELECT q, (SELECT count(DISTINCT ID) FROM tt WHERE len(w) > 0 AND list_has_all(t, w)) AS n_ids FROM (SELECT DISTINCT q, list_distinct({tokens_sql('q')}) AS w FROM qq)),
ok AS (SELECT cell, row_n, q FROM qq JOIN m USING (q) WHERE n_ids BETWEEN 1 AND {MOST}), {_walk_sql('ok')}
SELECT cell, row_n, place, n_ids, CASE WHEN n_ids = 1 THEN 'S' ELSE 'C' END AS tier, CASE WHEN place % 5 = 0 THEN replace(replace(q, 'ی', 'ي'), 'ک', 'ك') ELSE q END AS query FROM walked JOIN m USING (q)"""
)
def silver_v1(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of every cell until its quota: accepted if they mean at most ``MOST`` IDs and no earlier cell has them; every fifth with
    noise."""
    q = pool(spark, folder).withColumn("d", wl.derive(F.col("DescriptionOfID"), F.col("Type"))).select("cell", "row_n", wl.build_query(F.col("d"), 1).alias("query"))
    wanted = q.select("query").distinct().withColumn("w", tx.tokenize(F.col("query")))
    n = wl.subset_matches(titles(spark, folder), "ID", "tokens", wanted, "query", "w").where(F.col("n_ids").between(1, MOST))
    accepted = wl.emit_until(q.join(n, "query").withColumn("quota", F.lit(QUOTA)), "cell", "quota", "query", "row_n")
    noisy = F.when(F.col("place") % 5 == 0, wl.noise(F.col("query"), "arabic_letters")).otherwise(F.col("query"))
    return accepted.join(n, "query").select("cell", "row_n", "place", "n_ids", F.when(F.col("n_ids") == 1, "S").otherwise("C").alias("tier"), noisy.alias("query"))


_CLASS = f"cls AS (SELECT term_n, hd.ID, list_distinct({tokens_sql('DescriptionOfID')}) AS t FROM asg JOIN hd USING (row_n) UNION ALL SELECT term_n, hd.ID, list_distinct({tokens_sql('DescriptionOfID')}) FROM hd JOIN terms ON len(seller) > 0 AND h[1:len(seller)] = seller)"


@query(
    f"""WITH {_LADDER}, {_CLASS}, x AS (SELECT term_n, row_n, array_to_string(h, ' ') AS hh FROM asg JOIN hd USING (row_n)), a AS (SELECT *, row_number() OVER (PARTITION BY term_n, hh ORDER BY row_n) AS rd FROM x QUALIFY rd <= {PER_PAIR}),
picked AS (SELECT term_n, row_n, row_number() OVER (PARTITION BY term_n ORDER BY rd, row_n) AS place FROM a QUALIFY place <= {PER_PAIR}),
lq AS (SELECT ld.*, len(sub) AS n_sub FROM ld JOIN picked USING (term_n, row_n) JOIN sb USING (row_n)),
g AS (SELECT term_n, level, array_to_string(q, ' ') AS query, min(row_n) AS row_n FROM lq GROUP BY ALL),
w AS (SELECT g.*, lq.q[lq.n_sub + 1:] AS required FROM g JOIN lq ON g.term_n = lq.term_n AND g.level = lq.level AND g.row_n = lq.row_n)
SELECT CAST(term_n AS INTEGER) AS term_n, level, query, row_n, n_label, CASE WHEN n_label = 1 THEN 'S' ELSE 'C' END AS tier FROM (SELECT term_n, level, query, row_n, (SELECT count(DISTINCT ID) FROM cls WHERE cls.term_n = w.term_n AND list_has_all(t, required)) AS n_label FROM w)"""
)
def silver_v2b(spark: SparkSession, folder: str) -> DataFrame:
    """The ladder of ten rows of each pair in the sellers' words, without repeats, each query with the number of IDs it may mean: those whose head is of
    the pair (in either's words) and whose title has the words besides the head."""
    h, t = heads(spark, folder), terms(spark, folder)
    s = _substituted(spark, folder)
    picked = wl.round_robin(s.select("term_n", "row_n", F.array_join("head_tokens", " ").alias("hh")), "term_n", "hh", [F.col("row_n")], PER_PAIR).select("term_n", "row_n")
    lad = s.join(picked, ["term_n", "row_n"]).select("term_n", "row_n", F.explode(wl.detail_ladder(F.col("d"), F.col("sub"))).alias("l"))
    g = lad.groupBy("term_n", F.col("l.level").alias("level"), F.array_join("l.query", " ").alias("query")).agg(F.min(F.struct("row_n", F.col("l.required").alias("required"))).alias("f"))
    # Membership of a pair's class is one more token, so that the class is part of the subset test.
    mark = lambda c: F.concat(F.lit("\x1f"), c.cast("string"))
    spans = h.select("row_n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("head_tokens"), F.lit(1))), lambda n: F.array_join(F.slice("head_tokens", 1, n), " "))).alias("span"))
    by_seller = spans.join(t.where(F.size("seller") > 0).select("term_n", F.array_join("seller", " ").alias("span")), "span").select("row_n", "term_n")
    member = s.select("row_n", "term_n").unionByName(by_seller).groupBy("row_n").agg(F.collect_set(mark(F.col("term_n"))).alias("marks"))  # pairs of one head
    rows = h.join(member, "row_n").select("ID", F.concat(tx.tokenize(F.col("DescriptionOfID")), "marks").alias("tokens"))
    keyed = g.select("term_n", "level", "query", F.col("f.row_n").alias("row_n"), F.concat(F.array(mark(F.col("term_n"))), "f.required").alias("w"), F.concat_ws("|", "term_n", "level", "query").alias("key"))
    n = wl.subset_matches(rows, "ID", "tokens", keyed, "key", "w")
    return keyed.join(n, "key").select("term_n", "level", "query", "row_n", F.col("n_ids").alias("n_label"), F.when(F.col("n_ids") == 1, "S").otherwise("C").alias("tier"))
