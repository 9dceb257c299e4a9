"""BM25 over the titles in force, and what is read off its rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.functions import jalali
from tarazu.functions import text as tx
from tarazu.operators import catalog as cat
from tarazu.operators import retrieval as bm
from tarazu.operators.evaluation import split_ids
from tarazu.plans.problems import calendar_sql
from tarazu.plans.quality import AS_OF, _IN_FORCE, classified, classified_sql
from tarazu.plans.registry import query
from tarazu.plans.texts import tokens_sql
from tarazu.session import stage_table
from tarazu.sources.tables import is_id, table

K = 20
_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"


def snapshot_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each active row in force: ``doc, sstid, tokens``."""
    rows = cat.active(classified(spark, folder, both=True)).where(cat.in_force(AS_OF))
    return rows.select(F.col("row_n").alias("doc"), F.col("ID").alias("sstid"), F.coalesce(tx.tokenize(F.col("DescriptionOfID")), F.array().cast("array<string>")).alias("tokens"))


def version_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One document for each active version, of any date."""
    v = cat.versions(cat.active(classified(spark, folder, both=True)))
    return v.select(F.col("row_n").alias("doc"), "sstid", "valid_from", "valid_to", F.coalesce(tx.tokenize(F.col("title")), F.array().cast("array<string>")).alias("tokens"))


def golden_queries(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "eval_golden")
    return g.select(F.col("item_id").cast("string").alias("query"), F.array_distinct(tx.tokenize(F.col("query_text"))).alias("tokens"), split_ids(F.col("expected_sstid")).alias("expected"), "tier", "notes")


def stated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines whose numbers are divisible by 50."""
    return table(spark, folder, "demo_invoices").where(F.substring("line_id", 2, 20).try_cast("bigint") % 50 == 0)


def line_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The stated set of lines with a usable day, one row a line."""
    lines = stated_lines(spark, folder).where(F.col("sstt").isNotNull() & jalali.is_day(F.col("issue_date")))
    return lines.select(F.col("line_id").alias("query"), F.array_distinct(tx.tokenize(F.col("sstt"))).alias("tokens"), F.col("issue_date").alias("day"), F.col("sstid").alias("declared")).distinct()


_WEIGHT = "round(ln(1 + (n - df + 0.5) / (df + 0.5)), 12) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"


def docs_sql(dated: bool) -> str:
    rows = f"act WHERE {_IN_FORCE}" if not dated else "act"
    return f"""{classified_sql(_BOTH)}, docs AS (SELECT row_n AS doc, ID AS sstid, coalesce({tokens_sql("DescriptionOfID")}, []) AS t, RunDate AS f, CASE WHEN coalesce(ExpirationDate, '') = '' THEN '9999' ELSE ExpirationDate END AS e FROM {rows}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
p AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY doc, term),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT p.doc, p.term, {_WEIGHT.replace("round(ln(1 + (n - df + 0.5) / (df + 0.5)), 12)", "ln(1 + (n - df + 0.5) / (df + 0.5))")} AS w FROM p JOIN dfs USING (term), st)"""


_GOLDEN = f"q AS (SELECT item_id::VARCHAR AS query, unnest(list_distinct({tokens_sql('query_text')})) AS term FROM eval_golden)"
_LINES = f"""ql AS (SELECT DISTINCT line_id AS query, {tokens_sql("sstt")} AS t, issue_date AS day, sstid AS declared FROM demo_invoices WHERE TRY_CAST(substr(line_id, 2) AS BIGINT) % 50 = 0 AND sstt IS NOT NULL AND regexp_full_match(issue_date, '{jalali.DAY}')),
q AS (SELECT query, unnest(list_distinct(t)) AS term FROM ql)"""
_SCORES = "s AS (SELECT query, doc, round(sum(w), 6) AS score FROM q JOIN w USING (term) GROUP BY query, doc)"


@query(f"WITH {docs_sql(False)} SELECT term, df, CAST(n_occ AS BIGINT) AS n_occurrences, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(mw, 6) AS max_weight FROM (SELECT term, sum(tf) AS n_occ, max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS mw FROM p, st GROUP BY term) JOIN dfs USING (term), st")
def bm25_index(spark: SparkSession, folder: str) -> DataFrame:
    t = bm.index_terms(snapshot_docs(spark, folder), "doc")
    return t.select("term", "df", "n_occurrences", F.round("idf", 6).alias("idf"), F.round("max_weight", 6).alias("max_weight"))


@query(f"WITH {docs_sql(False)} SELECT n AS docs, (SELECT count(*) FROM dfs) AS vocab, (SELECT count(*) FROM p) AS postings, round(avgdl, 2) AS avg_doc_tokens FROM st")
def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = snapshot_docs(spark, folder)
    terms = bm.document_frequency(docs).agg(F.count(F.lit(1)).alias("vocab"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return bm.corpus_stats(docs).crossJoin(F.broadcast(terms)).select(F.col("n_docs").alias("docs"), "vocab", "postings", F.round("avgdl", 2).alias("avg_doc_tokens"))


@query(f"WITH {docs_sql(False)}, {_GOLDEN}, {_SCORES} SELECT query, count(*) AS n_docs, max(score) AS best FROM s GROUP BY query")
def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each query scores, and the best score."""
    r = bm.rank(snapshot_docs(spark, folder), golden_queries(spark, folder), 1, counted=True)
    return r.groupBy("query").agg(F.max(F.when(F.col("kind") == "count", F.col("doc"))).alias("n_docs"), F.max("score").alias("best"))


def golden_ranking(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return bm.rank(snapshot_docs(spark, folder), golden_queries(spark, folder), k)


_BEST = "b AS (SELECT query, sstid, max(score) AS score, arg_min(doc, (-score, doc)) AS doc FROM s JOIN docs USING (doc) WHERE score > 0 GROUP BY query, sstid)"
GOLDEN_RANKED = f"{docs_sql(False)}, {_GOLDEN}, {_SCORES}, {_BEST}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM b QUALIFY rank <= {K})"


@query(f"WITH {GOLDEN_RANKED} SELECT query, rank, sstid, score FROM r")
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 20 IDs of every evaluation query; equal scores in catalog order."""
    return golden_ranking(spark, folder).select("query", "rank", "sstid", "score")


def line_ranking(spark: SparkSession, folder: str, k: int = K, declared: bool = True) -> tuple[DataFrame, DataFrame]:
    q = stage_table(line_queries(spark, folder), "line-queries")  # of all lines those that are asked, read several times
    return bm.rank(version_docs(spark, folder), q, k, tie="id", dated=True, declared=declared), q


_LINE_BEST = f"{docs_sql(True)}, {_LINES}, {_SCORES}, b AS (SELECT query, sstid, max(score) AS score FROM s JOIN docs USING (doc) JOIN ql USING (query) WHERE score > 0 AND f <= day AND day <= e GROUP BY query, sstid), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, sstid) AS INTEGER) AS rank FROM b QUALIFY rank <= {K})"


@query(f"WITH {_LINE_BEST} SELECT query AS line_id, rank, sstid, score FROM r")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The best 20 IDs in force on each line's day; equal scores by ID."""
    ranked, _ = line_ranking(spark, folder, declared=False)
    return ranked.where("kind = 'top'").select(F.col("query").alias("line_id"), "rank", "sstid", "score")


@query(
    f"""WITH {_LINE_BEST}, o AS (SELECT query, max(score) AS own FROM s JOIN docs USING (doc) JOIN ql USING (query) WHERE sstid = declared GROUP BY query),
t AS (SELECT query, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, count(*) AS n FROM r GROUP BY query)
SELECT query AS line_id, coalesce((SELECT max(rank) FROM r WHERE r.query = ql.query AND r.sstid = ql.declared), {K + 1})::INTEGER AS rank_declared, round(CASE WHEN coalesce(s1, 0) > 0 THEN least(coalesce(own, 0) / s1, 1) ELSE 0 END, 4) AS sim_declared,
  round(CASE WHEN s2 IS NOT NULL THEN (s1 - s2) / s1 ELSE 0 END, 4) AS margin_top1, round(coalesce(own, 0), 4) AS declared_score, coalesce(n, 0) AS n_ranked FROM ql LEFT JOIN t USING (query) LEFT JOIN o USING (query)"""
)
def bm25_features(spark: SparkSession, folder: str) -> DataFrame:
    """Where a line's declared ID stands among the IDs that its text finds."""
    ranked, q = line_ranking(spark, folder)
    f = bm.features(ranked, q, K)
    return f.select(F.col("query").alias("line_id"), "rank_declared", *(F.round(c, 4).alias(c) for c in ("sim_declared", "margin_top1", "declared_score")), "n_ranked")


@query(f"WITH {_LINE_BEST} SELECT query AS line_id, string_agg(sstid, ' ' ORDER BY rank) AS ids FROM r WHERE rank <= 5 GROUP BY query")
def alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """The first five IDs of each line."""
    ranked, _ = line_ranking(spark, folder, 5, declared=False)
    first = ranked.where("kind = 'top'").groupBy(F.col("query").alias("line_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "sstid"))).alias("r"))
    return first.select("line_id", F.array_join(F.transform("r", lambda x: x["sstid"]), " ").alias("ids"))


@query(f"WITH {GOLDEN_RANKED} SELECT query, score, min(rank) AS first_rank, count(*) AS n_tied FROM r GROUP BY query, r.score HAVING count(*) > 1")
def tie_groups(spark: SparkSession, folder: str) -> DataFrame:
    return bm.tie_groups(golden_ranking(spark, folder))
