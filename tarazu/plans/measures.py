"""Evaluation sets, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.operators import catalog as cat
from tarazu.operators import evaluation as ev
from tarazu.operators import retrieval as bm
from tarazu.plans.quality import AS_OF, _IN_FORCE, _rate_sql, _rates, classified, classified_sql
from tarazu.plans.ranking import GOLDEN_RANKED, K, bm25_features, golden_queries, golden_ranking, snapshot_docs, stated_lines
from tarazu.plans.registry import SQL, query
from tarazu.plans.texts import tokens_sql
from tarazu.sources.tables import table

_BOTH = "(SELECT * FROM fake_catalog UNION ALL BY NAME SELECT * FROM fake_catalog_general)"
_IDS = "list_transform(string_split(coalesce(expected_sstid, ''), ';'), lambda x: trim(x))"


_REASON = f"""CASE WHEN coalesce(trim(query_text), '') = '' THEN 'empty_query' WHEN coalesce(tier, '') NOT IN ('S', 'C') THEN 'bad_tier' WHEN len(list_filter({_IDS}, lambda x: NOT regexp_full_match(x, '[0-9]{{13}}'))) > 0 THEN 'bad_id'
  WHEN len(list_distinct({_IDS})) < len({_IDS}) THEN 'duplicate_id' WHEN tier = 'S' AND len({_IDS}) > 1 THEN 'multi_id_tier_s' END"""


@query(f"SELECT item_id, {_REASON} AS reason, CAST(len({_IDS}) AS INTEGER) AS n_ids FROM eval_golden")
def golden_parse(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "eval_golden")
    return g.select("item_id", ev.golden_reason(F.col("query_text"), F.col("expected_sstid"), F.col("tier")).alias("reason"), F.size(ev.split_ids(F.coalesce("expected_sstid", F.lit("")))).alias("n_ids"))


@query("SELECT item_id, coalesce(regexp_matches(notes, '^silver(-[a-z0-9]+)*\\|'), false) AS silver FROM eval_golden")
def silver_tag(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_golden").select("item_id", ev.silver_tag(F.col("notes")).alias("silver"))


_BUCKET = f"""bucket AS (SELECT sstid, CASE WHEN coalesce(x.idx, false) THEN 'usable' WHEN coalesce(x.a, false) THEN 'out_of_index' WHEN coalesce(x.q, false) THEN 'quarantined' ELSE 'gone' END AS bucket FROM (SELECT DISTINCT trim(unnest(string_split(expected_sstid, ';'))) AS sstid FROM eval_golden) g
  LEFT JOIN (SELECT ID, bool_or(NOT (r2 OR r3 OR r4) AND {_IN_FORCE}) AS idx, bool_or(NOT (r2 OR r3 OR r4)) AS a, bool_or(r2 OR r3 OR r4) AS q FROM c WHERE NOT is_extra_copy GROUP BY ID) x ON g.sstid = x.ID)"""


def expected_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """``(sstid, bucket)`` of every expected ID: usable, out_of_index, quarantined or gone."""
    asked = golden_queries(spark, folder).select(F.explode("expected").alias("sstid")).distinct()
    c = classified(spark, folder, both=True)
    status = cat.id_status(c)
    index = cat.active(c).where(cat.in_force(AS_OF)).select(F.col("ID").alias("sstid")).distinct()
    left = asked.join(status, "sstid", "left")
    usable = left.join(index, "sstid", "left_semi").select("sstid", F.lit("usable").alias("bucket"))
    rest = left.join(index, "sstid", "left_anti")
    return usable.unionByName(rest.select("sstid", F.when(F.col("is_active"), "out_of_index").when(F.col("is_quarantined"), "quarantined").otherwise("gone").alias("bucket")))


@query(f"WITH {classified_sql(_BOTH)}, {_BUCKET} SELECT sstid, bucket FROM bucket")
def semi_anti_membership(spark: SparkSession, folder: str) -> DataFrame:
    return expected_buckets(spark, folder)


_BUCKETS = ("usable", "gone", "quarantined", "out_of_index")
_GOLDEN_ROWS = f"""{_BUCKET}, gr AS (SELECT item_id, item_id::VARCHAR AS query, tier, notes, reason, {", ".join(f"coalesce(list(sstid ORDER BY pos) FILTER (bucket = '{b}'), []) AS {b}" for b in _BUCKETS)}
  FROM (SELECT item_id, tier, notes, {_REASON} AS reason, unnest({_IDS}) AS sstid, unnest(range(len({_IDS}))) AS pos FROM eval_golden) LEFT JOIN bucket USING (sstid) GROUP BY item_id, tier, notes, reason)"""
_STATE = "CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN len(usable) > 0 THEN 'evaluated' WHEN len(gone) > 0 THEN 'missing_from_catalog' WHEN len(out_of_index) > 0 THEN 'not_in_index' ELSE 'quarantined_only' END"


def golden_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(query, tier, notes, reason, state, usable, gone, quarantined, out_of_index)`` of every item: its expected IDs by what the catalog has of them, and
    whether it can be evaluated or why not."""
    g = table(spark, folder, "eval_golden")
    ids = ev.split_ids(F.coalesce("expected_sstid", F.lit("")))
    rows = g.select(F.col("item_id").cast("string").alias("query"), "tier", "notes", ev.golden_reason(F.col("query_text"), F.col("expected_sstid"), F.col("tier")).alias("reason"), ids.alias("ids"))
    each = rows.select("query", F.posexplode("ids").alias("pos", "sstid")).join(expected_buckets(spark, folder), "sstid", "left")
    held = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", "sstid", "bucket"))).alias("x"))  # the IDs of one item
    of = lambda b: F.transform(F.filter("x", lambda i: i["bucket"] == b), lambda i: i["sstid"]).alias(b)
    out = rows.drop("ids").join(held, "query").select("query", "tier", "notes", "reason", *map(of, _BUCKETS))
    state = F.when(F.col("reason").isNotNull(), "invalid").when(F.size("usable") > 0, "evaluated").when(F.size("gone") > 0, "missing_from_catalog").when(F.size("out_of_index") > 0, "not_in_index")
    return out.withColumn("state", state.otherwise("quarantined_only"))


@query(f"WITH {classified_sql(_BOTH)}, {_GOLDEN_ROWS} SELECT query, {_STATE} AS state, reason, " + ", ".join(f"array_to_string({b}, ';') AS {b}" for b in _BUCKETS) + " FROM gr")
def golden_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every evaluation item, and which of its IDs are missing, quarantined or not in the index."""
    return golden_rows(spark, folder).select("query", "state", "reason", *(F.array_join(b, ";").alias(b) for b in _BUCKETS))


@query(f"WITH {classified_sql(_BOTH)}, {_GOLDEN_ROWS}, s AS (SELECT {_STATE} AS state FROM gr) SELECT k.state, count(s.state) AS n FROM (SELECT unnest(['invalid', 'evaluated', 'missing_from_catalog', 'not_in_index', 'quarantined_only']) AS state) k LEFT JOIN s USING (state) GROUP BY k.state")
def golden_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many items are evaluated, and how many are not for each reason."""
    states = spark.createDataFrame([(s,) for s in ("invalid", "evaluated", "missing_from_catalog", "not_in_index", "quarantined_only")], "state string")
    return states.join(golden_rows(spark, folder).select("state", F.lit(1).alias("one")), "state", "left").groupBy("state").agg(F.count("one").alias("n"))


def golden_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """``(query, tier, notes, rank)`` of the items that can be evaluated: the first place at which one of their usable IDs was found."""
    q = golden_rows(spark, folder).where("state = 'evaluated'")
    found = golden_ranking(spark, folder).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "sstid"))).alias("r"))  # at most K an item
    joined = q.join(found, "query", "left")
    return joined.select("query", "tier", "notes", ev.rank_of_any(F.transform("r", lambda x: x["sstid"]), F.col("usable")).alias("rank"))


_RANKS = f"{GOLDEN_RANKED}, {_GOLDEN_ROWS}, ranks AS (SELECT query, tier, notes, (SELECT min(rank) FROM r WHERE r.query = gr.query AND list_contains(gr.usable, r.sstid)) AS rank FROM gr WHERE {_STATE} = 'evaluated')"
_METRICS = "count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr"


@query(f"WITH {_RANKS} SELECT query, CAST(rank AS BIGINT) AS rank FROM ranks")
def rank_of_any(spark: SparkSession, folder: str) -> DataFrame:
    return golden_ranks(spark, folder).select("query", "rank")


_K_VALUES = (1, 3, 5, 10, 20)


@query(f"WITH {_RANKS}, k AS (SELECT unnest({list(_K_VALUES)}) AS k) SELECT CAST(k AS INTEGER) AS k, round(avg((coalesce(rank, 99) <= k)::INT), 6) AS recall FROM ranks, k GROUP BY k")
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    one = golden_ranks(spark, folder).agg(*(ev.recall_at(F.col("rank"), k).alias(f"r{k}") for k in _K_VALUES))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(f"r{k}", 6).alias("recall")) for k in _K_VALUES))).alias("x")).select("x.*")


@query(f"WITH {_RANKS} SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM ranks")
def mrr(spark: SparkSession, folder: str) -> DataFrame:
    return golden_ranks(spark, folder).agg(F.round(ev.mrr(F.col("rank")), 6).alias("mrr"))


@query(f"WITH {_RANKS} SELECT coalesce(tier, 'combined') AS tier, {_METRICS} FROM ranks GROUP BY GROUPING SETS ((tier), ())")
def golden_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    m = ev.tier_metrics(golden_ranks(spark, folder))
    return m.select("tier", "n", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "mrr")))


@query(f"WITH {_RANKS}, m AS (SELECT regexp_matches(coalesce(notes, ''), '^silver(-[a-z0-9]+)*\\|') AS silver, count(*) AS n, avg((coalesce(rank, 99) <= 5)::INT) AS r FROM ranks WHERE tier = 'S' GROUP BY 1) SELECT silver, n, CASE WHEN silver THEN 'not_applicable' WHEN n < 60 THEN 'not_yet_measurable' WHEN r >= 0.85 THEN 'met' ELSE 'not_met' END AS status FROM m")
def exit_criterion(spark: SparkSession, folder: str) -> DataFrame:
    """Whether tier S meets its bar, for hand-made and machine-made rows apart."""
    by = golden_ranks(spark, folder).where("tier = 'S'").groupBy(ev.silver_tag(F.col("notes")).alias("silver")).agg(F.count(F.lit(1)).alias("n"), ev.recall_at(F.col("rank"), 5).alias("r"))
    return by.select("silver", "n", ev.exit_status(F.col("silver"), F.col("n"), F.col("r")).alias("status"))


@query(f"WITH {_RANKS} SELECT concat('tier ', coalesce(tier, 'combined'), ': n=', count(*), ', hits=', count(*) FILTER (rank <= 5), ', misses=', count(*) FILTER (rank IS NULL)) AS line FROM ranks GROUP BY GROUPING SETS ((tier), ())")
def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    by = golden_ranks(spark, folder).groupingSets([[F.col("tier")], []], F.col("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("hits"), F.count_if(F.col("rank").isNull()).alias("misses"))
    return by.select(F.concat(F.lit("tier "), F.coalesce("tier", F.lit("combined")), F.lit(": n="), F.col("n"), F.lit(", hits="), F.col("hits"), F.lit(", misses="), F.col("misses")).alias("line"))


@query(
    f"""WITH st AS ({_rate_sql("act", "")}), p AS (SELECT d.line_id, list_filter(string_split(coalesce(labels, ''), ';'), lambda x: x <> '') AS t, CASE WHEN status IN ('NOT_IN_CATALOG', 'NOT_IN_FORCE') THEN [status] ELSE [] END AS p FROM (SELECT DISTINCT line_id, labels FROM demo_invoices) d JOIN st USING (line_id)),
k AS (SELECT unnest(list_distinct(list_concat(t, p))) AS code, t, p FROM p), n AS (SELECT code, count(*) FILTER (list_contains(t, code) AND list_contains(p, code)) AS tp, count(*) FILTER (NOT list_contains(t, code)) AS fp, count(*) FILTER (NOT list_contains(p, code)) AS fn FROM k GROUP BY code)
SELECT code, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 4) END AS recall FROM n"""
)
def label_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The lookup's statuses held against the reviewers' (incomplete) tags."""
    status = _rates(spark, folder, True).select("line_id", "status")
    tags = table(spark, folder, "demo_invoices").select("line_id", "labels").distinct()
    both = tags.join(status, "line_id").select(
        F.filter(F.split(F.coalesce("labels", F.lit("")), ";"), lambda x: x != "").alias("truth"),
        F.when(F.col("status").isin("NOT_IN_CATALOG", "NOT_IN_FORCE"), F.array("status")).otherwise(F.array().cast("array<string>")).alias("predicted"),
    )
    return ev.confusion(both, "truth", "predicted")


@query("SELECT coalesce(nullif(labels, ''), 'clean') AS label, count(DISTINCT line_id) AS n FROM demo_invoices GROUP BY 1")
def label_hist(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "demo_invoices").select("line_id", F.coalesce(F.expr("nullif(labels, '')"), F.lit("clean")).alias("label")).distinct()
    return one.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RANKS}, sl AS (SELECT query, unnest(['all', tier, CASE WHEN notes IS NULL THEN 'plain' ELSE 'noted' END]) AS slice, split_part(coalesce(notes, 'none'), '|', 1) AS pair, (coalesce(rank, 99) <= 5)::INT AS hit FROM ranks), pp AS (SELECT slice, pair, avg(hit) AS m, sum(hit) AS s, count(*) AS n FROM sl GROUP BY ALL) SELECT slice, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n, round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM pp GROUP BY slice")
def macro_micro(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at 5 by overlapping slices: the mean over groups of notes, and over queries."""
    r = golden_ranks(spark, folder)
    slices = F.explode(F.array(F.lit("all"), F.col("tier"), F.when(F.col("notes").isNull(), "plain").otherwise("noted"))).alias("slice")
    rows = r.select(slices, F.substring_index(F.coalesce("notes", F.lit("none")), "|", 1).alias("pair"), F.coalesce(F.col("rank") <= 5, F.lit(False)).cast("int").alias("hit"))
    m = ev.macro_micro(rows, ["slice"], "pair", F.col("hit"))
    return m.select("slice", "n_pairs", "n", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


_TAGS = ["silver", "silver-v2", "silver-v2b", "hand checked", "second look"]


def _share_sql(k: int) -> str:
    return f"round(avg(CASE WHEN query IS NOT NULL THEN (coalesce(rank, 99) <= {k})::INT END), 6)"


@query(
    f"""WITH {_RANKS} SELECT t.tag, count(query) AS n, {_share_sql(1)} AS recall_1, {_share_sql(5)} AS recall_5, CASE WHEN count(query) = 0 THEN 'not_covered' ELSE 'covered' END AS status
FROM (SELECT unnest({_TAGS}) AS tag) t LEFT JOIN ranks ON split_part(notes, '|', 1) = tag GROUP BY t.tag"""
)
def per_pair_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed tag, also those without a query."""
    tags = spark.createDataFrame([(t,) for t in _TAGS], "tag string")
    r = golden_ranks(spark, folder).select(F.substring_index("notes", "|", 1).alias("tag"), "query", "rank")
    by = r.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), ev.recall_at(F.col("rank"), 1).alias("recall_1"), ev.recall_at(F.col("rank"), 5).alias("recall_5"))
    return tags.join(by, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"), F.round("recall_1", 6).alias("recall_1"), F.round("recall_5", 6).alias("recall_5"), F.when(F.col("n").isNull(), "not_covered").otherwise("covered").alias("status"))


@query(f"WITH {classified_sql(_BOTH)}, d AS (SELECT count(DISTINCT ID) AS n FROM act WHERE {_IN_FORCE}) SELECT item_id, round(1 - list_product(list_transform(range(5), lambda i: (n - len({_IDS}) - i) / (n - i))), 8) AS chance FROM eval_golden, d")
def random_hit(spark: SparkSession, folder: str) -> DataFrame:
    """The chance that five IDs drawn at random hold an expected one."""
    n = snapshot_docs(spark, folder).select("sstid").distinct().agg(F.count(F.lit(1)).alias("n_index"))
    q = golden_queries(spark, folder).crossJoin(F.broadcast(n))  # one row
    return q.select(F.col("query").cast("long").alias("item_id"), F.round(ev.random_hit(F.size("expected"), F.col("n_index"), 5), 8).alias("chance"))


_QUANTILES = (0.0, 0.5, 0.95, 1.0)


@query("WITH v AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL) SELECT q, n_chars FROM v, (SELECT unnest([0.0, 0.5, 0.95, 1.0]::DOUBLE[]) AS q) WHERE i = CAST(round_even(q * (n - 1), 0) AS BIGINT)")
def percentile_nearest(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for q in _QUANTILES:
        one = ev.nearest_rank(table(spark, folder, "documents"), "n_chars", q).select(F.lit(q).alias("q"), "n_chars")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {classified_sql()}, t AS (SELECT Type, CAST(len({tokens_sql('DescriptionOfID')}) AS INTEGER) AS n FROM act WHERE {_IN_FORCE} AND DescriptionOfID IS NOT NULL), m AS (SELECT Type, median(n) AS median FROM t GROUP BY Type) SELECT Type, median, count(*) FILTER (n < median) AS n_short, count(*) FILTER (n >= median) AS n_long FROM t JOIN m USING (Type) GROUP BY ALL")
def median_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The exact median title length of each type and the sizes of its two cells.  The median is taken over counts of lengths."""
    from tarazu.functions import text as tx

    rows = cat.active(classified(spark, folder)).where(cat.in_force(AS_OF) & F.col("DescriptionOfID").isNotNull())
    by = rows.groupBy("Type", F.size(tx.tokenize(F.col("DescriptionOfID"))).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    m = by.groupBy("Type").agg(F.expr("percentile(n, 0.5, rows)").alias("median"))
    return by.join(m, "Type").groupBy("Type", "median").agg(F.coalesce(F.sum(F.when(F.col("n") < F.col("median"), F.col("rows"))), F.lit(0)).alias("n_short"), F.coalesce(F.sum(F.when(F.col("n") >= F.col("median"), F.col("rows"))), F.lit(0)).alias("n_long"))


@query(f"SELECT coalesce(nullif(labels, ''), 'clean') AS label, count(*) AS n, round(avg(sim_declared), 3) AS mean, min(sim_declared) AS least, max(sim_declared) AS greatest FROM (SELECT DISTINCT line_id, labels FROM demo_invoices) JOIN ({SQL['bm25_features']}) USING (line_id) GROUP BY 1")
def features_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """How like the declared ID's title the text is, by the reviewers' tags."""
    tags = stated_lines(spark, folder).select("line_id", F.coalesce(F.expr("nullif(labels, '')"), F.lit("clean")).alias("label")).distinct()
    s = ev.summary_by(tags.join(bm25_features(spark, folder), "line_id"), "label", "sim_declared")
    return s.withColumn("mean", F.round("mean", 3))


@query()
def random_search(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty IDs drawn at random for every evaluation query."""
    return bm.random_ids(snapshot_docs(spark, folder), golden_queries(spark, folder), K)
