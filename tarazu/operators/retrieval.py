"""Okapi BM25 over a stored inverted index that is partitioned by document.

The postings of a document stay where the document is read: the index is written once, in shards; a task joins shards to a segment with the terms that its
part of a block of queries asks for, finds the best ``k`` of each query and sends only those, so what is shuffled is k rows a query and task instead of a row for each matching pair.
Common terms are looked up only for documents that rarer terms have brought near the k best (MaxScore); what is skipped cannot be among them.  The corpus statistics
(documents, lengths, document frequencies) are computed over all documents by partial aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.session import stage_table

K1, B = 1.5, 0.75
#: Queries shipped to the tasks at once, those that are a task's work at least, documents of a shard of the index, and of a task.
QUERY_BLOCK, QUERY_PART, DOC_BLOCK, SEGMENT = 50_000, 1_000, 4_096, 750_000
#: Scores are compared at this precision: sums in another order must not break ties.
DIGITS = 6


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: ``n_docs``, ``avgdl`` (documents without tokens count)."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens)).alias("avgdl"))


def postings(docs: DataFrame, doc: str, tokens: str = "tokens") -> DataFrame:
    """``(term, doc, tf, dl)``."""
    exploded = docs.select(F.col(doc).alias("doc"), F.size(tokens).alias("dl"), F.explode(tokens).alias("term"))
    return exploded.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_frequency(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(term, df)``: a term counts once a document; aggregated before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def index_terms(docs: DataFrame, doc: str, tokens: str = "tokens") -> DataFrame:
    """``(term, df, n_occurrences, idf, max_weight)``: the index by term."""
    stats = corpus_stats(docs, tokens)
    p = postings(docs, doc, tokens).crossJoin(F.broadcast(stats))  # one row
    w = term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    by = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n_occurrences"), F.max(w).alias("w"), F.first("n_docs").alias("n"))
    return by.select("term", "df", "n_occurrences", idf(F.col("n"), F.col("df")).alias("idf"), F.col("w").alias("max_weight"))


_INDEX = "doc array<long>, sstid array<string>, valid_from array<string>, valid_to array<string>, dl array<int>, terms array<string>, counts array<int>, at array<int>, tf array<int>"


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of documents ``(doc, sstid, tokens, valid_from, valid_to)``, in shards of up to ``DOC_BLOCK`` of them: a row holds its documents, and
    of every term in them the places of the documents that have it and how often.  Nothing is shuffled; write it once and search it as often as
    there are queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), DOC_BLOCK):
                part = batch.slice(lo, DOC_BLOCK)
                tokens = part.column("tokens")
                lengths = pc.list_value_length(tokens).fill_null(0).to_numpy()
                coded = tokens.flatten().dictionary_encode()
                pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(part) + np.repeat(np.arange(len(part)), lengths), return_counts=True)
                counts = np.bincount(pair // len(part), minlength=len(coded.dictionary))
                row = [*(part.column(c) for c in ("doc", "sstid", "valid_from", "valid_to")), pa.array(lengths, pa.int32()), coded.dictionary, *(pa.array(x, pa.int32()) for x in (counts, pair % len(part), tf))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row], [c.split(" ")[0] for c in _INDEX.split(", ")])

    return docs.select("doc", "sstid", "tokens", "valid_from", "valid_to").mapInArrow(run, _INDEX)


def _sorted_codes(*columns: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct texts of all columns in order, and each column as places in them (-1: null)."""
    names = pc.unique(pa.concat_arrays([c.cast(pa.large_string()) for c in columns])).drop_null()
    names = names.take(pc.sort_indices(names))
    return names, [pc.index_in(c.cast(pa.large_string()), value_set=names).fill_null(-1).to_numpy() for c in columns]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first to below its last, one range after the other."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Segment:
    """The documents of a task, and of each term that is asked for its documents in order with their weights."""

    def __init__(self, batches: Iterator[pa.RecordBatch], terms: pa.Array, idf_of: np.ndarray, avgdl: float, dated: bool):
        held: dict[str, list] = {c: [] for c in ("doc", "sstid", "valid_from", "valid_to") if dated or not c.startswith("valid")}
        parts, self.count, self.size = [], np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for n in range(len(batch)):
                row = {c: batch.column(c)[n].values for c in batch.schema.names}
                for c, x in held.items():
                    x.append(row[c])
                dl, counts, at, tf = (row[c].to_numpy() for c in ("dl", "counts", "at", "tf"))
                code = pc.index_in(row["terms"].cast(pa.large_string()), value_set=terms).fill_null(-1).to_numpy()
                asked = np.repeat(code >= 0, counts)
                code, counts, at, tf = code[code >= 0], counts[code >= 0], at[asked], tf[asked]
                w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / avgdl)) * np.repeat(idf_of[code], counts)
                parts.append((code, counts, (at + self.size).astype(np.int32), w))
                self.count[code] += counts
                self.size += len(dl)
        self.starts = np.concatenate([[0], np.cumsum(self.count)])
        self.at, self.w = np.empty(self.starts[-1], np.int64), np.empty(self.starts[-1])
        free = self.starts[:-1].copy()
        while parts:  # every part's postings of a term go behind those of the parts before
            code, counts, at, w = parts.pop(0)
            to = np.repeat(free[code] - (np.cumsum(counts) - counts), counts) + np.arange(len(at))
            self.at[to], self.w[to] = at, w
            free[code] += counts
        self.most = np.zeros(len(terms))
        if len(self.w):
            some = np.flatnonzero(self.count)
            self.most[some] = np.maximum.reduceat(self.w, self.starts[some])
        self.columns = {c: pa.concat_arrays(x) for c, x in held.items()} if self.size else {}

    def date(self, days: pa.Array) -> np.ndarray:
        """Each posting's first day and the day after its last, beside it, as numbers; and those of ``days``."""
        names, (start, end, asked) = _sorted_codes(self.columns["valid_from"], self.columns["valid_to"], days)
        small = np.int16 if len(names) < 32_000 else np.int32
        start = np.where(start < 0, np.iinfo(small).max, start)  # no start is no version; a query without a day (-1) finds none
        self.start, self.end = start.astype(small)[self.at], end.astype(small)[self.at]
        return asked.astype(small)

    def scores(self, pair: np.ndarray, doc: np.ndarray, term: np.ndarray, pairs: int) -> np.ndarray:
        """The sum of each pair over its rows (pair, document, term), added in their order."""
        if not len(self.at):
            return np.zeros(pairs)
        keys = np.repeat(np.arange(len(self.count)), self.count) * self.size + self.at
        asked = term * self.size + doc
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.bincount(pair, np.where(keys[place] == asked, self.w[place], 0.0), pairs)


def _first_ids(ids: np.ndarray, k: int) -> list[int]:
    """The places at which the first ``k`` distinct IDs appear."""
    seen, first = set(), []
    for n, i in enumerate(ids.tolist()):
        if i not in seen:
            seen.add(i)
            first.append(n)
            if len(first) == k:
                break
    return first


def _kth_score(score: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The score that the best documents of ``k`` distinct IDs reach; 0 if there are fewer."""
    m = 2 * k
    while True:
        top = np.argpartition(score, len(score) - m)[len(score) - m :] if m < len(score) else np.arange(len(score))
        top = top[np.argsort(-score[top])]
        first = _first_ids(ids[top], k)
        if len(first) == k:
            return float(score[top[first[-1]]])
        if m >= len(score):
            return 0.0
        m *= 4


def _search(seg: _Segment, asked: Iterator[tuple[int, np.ndarray]], k: int, by_id: bool, ids: np.ndarray, docs: np.ndarray, days: np.ndarray | None, counted: bool) -> Iterator[tuple]:
    """For each query (number, terms from the rarest to the commonest): its number, the places of its best documents, their scores, and the number of
    documents with a score (only right if ``counted``).

    Terms are added from the rarest on until those left could not lift a document that has none so far to the k-th best; only documents that
    still can reach it are looked up in the postings left.  What is left out is below the k-th best score by more than ``_SLACK``, so
    the result is that of a full scan.  Each document adds the terms in the same order, so equal titles get equal sums.
    """
    acc = np.zeros(seg.size)
    for n, terms in asked:
        terms = terms[seg.count[terms] > 0]
        left = np.zeros(len(terms) + 1)  # the most that the terms from i on can add
        left[:-1] = np.cumsum(seg.most[terms][::-1])[::-1]
        pool, floor, i = np.empty(0, np.int64), 0.0, 0
        while i < len(terms) and (counted or left[i] >= floor - _SLACK):
            own = slice(seg.starts[terms[i]], seg.starts[terms[i] + 1])
            at, w = seg.at[own], seg.w[own]
            if days is not None:
                f = np.flatnonzero((seg.start[own] <= days[n]) & (days[n] < seg.end[own]))
                at, w = at.take(f), w.take(f)
            old = acc.take(at)
            acc[at] = old + w
            pool = np.concatenate([pool, at.compress(old == 0)])
            i += 1
            if not counted and i < len(terms) and len(pool) >= k and seg.count[terms[i]] > _FEW:
                score = acc.take(pool)
                if score.max() >= left[i]:  # else there is no such bound yet
                    floor = max(floor, _kth_score(score, ids.take(pool), k))
        score = acc.take(pool)
        acc[pool] = 0
        for j in range(i, len(terms)):
            keep = np.flatnonzero(score + left[j] >= floor - _SLACK)
            pool, score = pool.take(keep), score.take(keep)
            own = slice(seg.starts[terms[j]], seg.starts[terms[j] + 1])
            place = np.minimum(np.searchsorted(seg.at[own], pool), own.stop - own.start - 1)
            score += np.where(seg.at[own].take(place) == pool, seg.w[own].take(place), 0.0)
            if len(pool) > 4 * k:
                floor = max(floor, _kth_score(score, ids.take(pool), k))
        score = np.round(score, DIGITS)
        keep = np.flatnonzero(score > 0)
        matched = len(keep)
        if matched > 2 * k:
            keep = np.flatnonzero((score > 0) & (score >= _kth_score(score, ids.take(pool), k)))
        pool, score = pool.take(keep), score.take(keep)
        order = np.lexsort((docs[pool], ids[pool], -score) if by_id else (docs[pool], -score))
        order = order[_first_ids(ids[pool[order]], k)]  # of each ID its best document
        yield n, pool[order], score[order], matched


#: Sums within this of a bound are kept: rounding and the order of terms must not drop a document.
_SLACK = 1e-5
#: Postings that are added without asking whether they are needed.
_FEW = 64


def _score_block(index: DataFrame, queries: pa.Table, n_docs: int, avgdl: float, df: pa.Table, k: int, by_id: bool, dated: bool, declared: bool, counted: bool) -> tuple[DataFrame, Broadcast]:
    """Rows ``(query, kind, doc, sstid, score)``: the best k of each query in each task (kind ``top``), the best document of the query's
    declared ID (``own``), and the number of documents with a score (``count``, in ``doc``); and what was shipped for them.

    A task holds a segment of the documents and searches it for a part of the block's queries."""
    text = lambda c: queries.column(c).combine_chunks().cast(pa.large_string())
    terms = df.column("term").combine_chunks().cast(pa.large_string())
    df_of = df.column("df").to_numpy().astype(np.float64)
    idf_of = np.log(1 + (n_docs - df_of + 0.5) / (df_of + 0.5))
    tokens = queries.column("tokens").combine_chunks()
    code = pc.index_in(tokens.flatten().cast(pa.large_string()), value_set=terms).fill_null(-1).to_numpy()
    query = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).fill_null(0).to_numpy())[code >= 0]
    code = code[code >= 0]
    order = np.lexsort((code, -idf_of[code], query))  # the same in every task
    code, ends = code[order], np.searchsorted(query, np.arange(len(tokens)), "right")
    sc = index.sparkSession.sparkContext
    shipped = sc.broadcast((text("query"), text("day") if dated else None, text("declared") if declared else None, terms, idf_of, code, np.r_[0, ends]))
    segments, parts = max(1, -(-n_docs // SEGMENT)), max(1, -(-len(tokens) // QUERY_PART))
    parts = min(parts, max(1, -(-2 * sc.defaultParallelism // segments)))
    segments = max(segments, -(-sc.defaultParallelism // parts))

    def search(lo: int, hi: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, days, own_ids, terms, idf_of, code, starts = shipped.value
            used = np.unique(code[starts[lo] : starts[hi]])
            place = np.zeros(len(terms), np.int64)
            place[used] = np.arange(len(used))
            seg = _Segment(batches, terms.take(pa.array(used)), idf_of[used], avgdl, dated)
            if not seg.size:
                return
            id_names, ids = _sorted_codes(seg.columns["sstid"], *([own_ids.slice(lo, hi - lo)] if declared else []))
            docs = seg.columns["doc"].to_numpy()
            days = seg.date(days.slice(lo, hi - lo)) if dated else None
            rows: dict[str, list] = {c: [] for c in ("query", "kind", "doc", "sstid", "score")}

            def add(n: np.ndarray, kind: int, at: np.ndarray, score: np.ndarray) -> None:
                for c, x in (("query", n), ("kind", np.full(len(n), kind)), ("doc", docs[at]), ("sstid", ids[0][at]), ("score", score)):
                    rows[c].append(x)

            asked = ((n - lo, place[code[starts[n] : starts[n + 1]]]) for n in range(lo, hi))
            for n, at, score, matched in _search(seg, asked, k, by_id, ids[0], docs, days, counted):
                add(np.full(len(at), n), 0, at, score)
                if counted and matched:
                    for c, x in (("query", n), ("kind", 2), ("doc", matched), ("sstid", -1), ("score", 0.0)):
                        rows[c].append(np.array([x]))
            if declared:  # of each query all documents of its declared ID, with each of its terms
                by = np.argsort(ids[0], kind="stable")
                own = np.where(ids[1] < 0, np.iinfo(np.int32).max, ids[1])  # no ID is no document's
                first, last = np.searchsorted(ids[0][by], own, "left"), np.searchsorted(ids[0][by], own, "right")
                query, at = np.repeat(np.arange(hi - lo), last - first), by[_ranges(first, last)]
                n_terms = np.diff(starts[lo : hi + 1])[query]
                term = place[code[_ranges(starts[lo:hi][query], starts[lo + 1 : hi + 1][query])]]
                score = np.round(seg.scores(np.repeat(np.arange(len(at)), n_terms), np.repeat(at, n_terms), term, len(at)), DIGITS)
                order = np.lexsort((docs[at], -score, query))
                order = order[score[order] > 0]
                order = order[np.unique(query[order], return_index=True)[1]]
                add(query[order], 1, at[order], score[order])
            if rows["query"]:
                one = {c: np.concatenate(x) for c, x in rows.items()}
                sstid = id_names.take(pa.array(one["sstid"], mask=one["sstid"] < 0)).cast(pa.string())
                kind = pa.array(["top", "own", "count"]).take(pa.array(one["kind"]))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(one["query"] + lo)).cast(pa.string()), kind, pa.array(one["doc"], pa.int64()), sstid, pa.array(one["score"], pa.float64())], list(one))

        # Spark would put the parts of a union into one task if all were of one partition.
        return index.coalesce(2 if segments == 1 and lo == 0 else segments).mapInArrow(run, "query string, kind string, doc long, sstid string, score double")

    found = None
    for n in range(parts):
        got = search(len(tokens) * n // parts, len(tokens) * (n + 1) // parts)
        found = got if found is None else found.unionByName(got)
    return found, shipped


def rank(docs: DataFrame, queries: DataFrame, k: int = 20, tie: str = "row", dated: bool = False, declared: bool = False, counted: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query, kind, rank, doc, sstid, score)``: the best ``k`` distinct IDs of each query, each at its best document.

    ``docs``: ``doc`` (unique number), ``sstid``, ``tokens`` and, if ``dated``, text days ``valid_from`` and ``valid_to`` (exclusive, null if
    open); ``queries``: ``query``, ``tokens``, with ``day`` if ``dated`` and ``declared`` if ``declared``.  ``tie``: equal scores go by ``row``
    (document number) or by ``id``.  Only scores above 0 count.  Kind ``own``: the best score of the query's declared ID over all its
    documents, in force or not; kind ``count``: in ``doc`` the number of documents with a score.
    Queries are worked off in blocks, so their number has no bound; queries without a known term have no rows.
    """
    none = F.lit(None).cast("string")
    shown = docs.select("doc", "sstid", "tokens", F.col("valid_from") if dated else none.alias("valid_from"), F.coalesce("valid_to", F.lit("9999-99-99")).alias("valid_to") if dated else none.alias("valid_to"))
    index = stage_table(build_index(shown), "inverted-index", compression="zstd")
    stats = index.agg(F.sum(F.size("doc")).alias("n_docs"), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length")).first()
    n_docs = stats.n_docs or 0
    need = ["query", F.array_distinct("tokens").alias("tokens"), *(["day"] if dated else []), *(["declared"] if declared else [])]
    asked = stage_table(queries.select(*need), "queries")  # each block reads them again
    total = asked.count()
    blocks = max(1, -(-total // query_block))
    df_table = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    df_table = stage_table(df_table.join(asked.select(F.explode("tokens").alias("term")).distinct(), "term", "left_semi"), "document-frequency")
    found = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n) if blocks > 1 else asked
        df = df_table.join(part.select(F.explode("tokens").alias("term")).distinct(), "term", "left_semi") if blocks > 1 else df_table
        got, shipped = _score_block(index, part.sort("query").toArrow(), n_docs, (stats.length or 0) / n_docs if n_docs and stats.length else 1.0, df.sort("term").toArrow(), k, tie == "id", dated, declared, counted)
        if blocks > 1:  # a block's queries leave the driver and the executors before the next block's come
            got = stage_table(got, "ranked-block")
            shipped.destroy()
        found = got if found is None else found.unionByName(got)
    # Read several times below and by those who use the ranking, and made by a scan of all documents: written once.  It has k rows for each
    # query and task at most.
    found = stage_table(found, "ranking")
    # Of each ID the best document over all tasks, then the best k IDs.
    top = found.where("kind = 'top'").repartition("query").groupBy("query", "sstid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("doc"))).alias("b")).select("query", "sstid", (-F.col("b.s")).alias("score"), F.col("b.doc").alias("doc"))
    order = [F.col("score").desc(), F.col("sstid" if tie == "id" else "doc")]
    ranked = top.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).withColumn("kind", F.lit("top"))
    columns = ["query", "kind", "rank", "doc", "sstid", "score"]
    out = ranked.select(*columns)
    if declared:
        own = found.where("kind = 'own'").groupBy("query", "sstid").agg(F.max("score").alias("score"))
        out = out.unionByName(own.select("query", F.lit("own").alias("kind"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("doc"), "sstid", "score"))
    if counted:
        n = found.where("kind = 'count'").groupBy("query").agg(F.sum("doc").alias("doc"))
        out = out.unionByName(n.select("query", F.lit("count").alias("kind"), F.lit(None).cast("int").alias("rank"), "doc", F.lit(None).cast("string").alias("sstid"), F.lit(None).cast("double").alias("score")))
    return out


def features(ranked: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query, rank_declared, sim_declared, margin_top1, declared_score, n_ranked)`` of a ranking with declared IDs: the declared ID's place
    (k + 1 if it has none), its best score in relation to the first, and the lead of the first over the second."""
    top = F.col("kind") == "top"
    by = ranked.groupBy("query").agg(
        F.max(F.when(top & (F.col("rank") == 1), F.col("score"))).alias("s1"),
        F.max(F.when(top & (F.col("rank") == 2), F.col("score"))).alias("s2"),
        F.max(F.when(F.col("kind") == "own", F.col("score"))).alias("own"),
        F.count_if(top).alias("n_ranked"),
    )
    declared = queries.select("query", F.col("declared").alias("sstid"))
    place = ranked.where(top).join(declared, ["query", "sstid"]).select("query", "rank")
    joined = queries.select("query").join(by, "query", "left").join(place, "query", "left")
    s1 = F.coalesce("s1", F.lit(0.0))
    own = F.coalesce("own", F.lit(0.0))
    return joined.select(
        "query",
        F.coalesce("rank", F.lit(k + 1)).alias("rank_declared"),
        F.when(s1 > 0, F.least(own / s1, F.lit(1.0))).otherwise(0.0).alias("sim_declared"),
        F.when(F.col("s2").isNotNull(), (s1 - F.col("s2")) / s1).otherwise(0.0).alias("margin_top1"),
        own.alias("declared_score"),
        F.coalesce("n_ranked", F.lit(0)).alias("n_ranked"),
    )


def tie_groups(ranked: DataFrame) -> DataFrame:
    """``(query, score, first_rank, n_tied)`` of places that share a score."""
    at = F.round("score", DIGITS)
    return ranked.where("kind = 'top'").groupBy("query", at.alias("score")).agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n_tied")).where("n_tied > 1")


def random_ids(docs: DataFrame, queries: DataFrame, k: int, seed: int = 1, query_block: int = 5_000) -> DataFrame:
    """``(query, rank, sstid)``: ``k`` distinct IDs of the index for each query, drawn at random by a hash of seed, query and ID: the chance
    level that a search is held against.  The same for any partitioning."""
    ids = docs.select("sstid").where("sstid IS NOT NULL").distinct().select("sstid", F.xxhash64(F.lit(seed), "sstid").alias("h"))
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // query_block))
    found = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n) if blocks > 1 else asked
        held = sorted((r.query, r.h) for r in part.select("query", F.xxhash64("query").alias("h")).collect())
        got = _draw(ids, held, k)
        found = got if found is None else found.unionByName(got)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("draw", "sstid")))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "sstid")


def _draw(ids: DataFrame, held: list[tuple[str, int]], k: int) -> DataFrame:
    shipped = ids.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = shipped.value
        best: dict = {name: (np.empty(0, np.uint64), np.empty(0, object)) for name, _ in queries}  # of the task so far
        for batch in batches:
            own = batch["h"].to_numpy().astype(np.uint64)
            for name, h in queries:
                x = own ^ np.uint64(h & (1 << 64) - 1)
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # the finalizer of splitmix64
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                draws, names = np.r_[best[name][0], x], np.r_[best[name][1], batch["sstid"].to_numpy(object)]
                keep = np.argsort(draws, kind="stable")[:k]
                best[name] = draws[keep], names[keep]
        for name, (draws, names) in best.items():
            yield pd.DataFrame({"query": name, "sstid": names, "draw": (draws >> np.uint64(1)).astype(np.int64)})

    return ids.mapInPandas(run, "query string, sstid string, draw long")
