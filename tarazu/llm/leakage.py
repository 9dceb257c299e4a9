"""Evaluation texts that occur, in whole or in part, in training documents.

Method: a distributed positional inverted index.  The postings of all words of all documents are stored once, in shards of whole documents: a
document is never cut, so all of an intersection happens inside one shard and no posting is shuffled.  Any number of test sets can be searched in a
stored index; the documents are not read again.  Every window of consecutive words of a test item belongs to its rarest word in the corpus: a shard
works only on the windows of words it has, and intersects their position lists, adjusted by the words' offsets, from the rarest on until nothing
is left.  What is left are exact phrase matches; a second walk over the same lists finds the words in order with a few others between them (proximity
matches).

Test items are worked off in blocks of a fixed number of words, so what is shipped to the tasks is bounded however large the test material is; of
several blocks each one's matches are written before the next is shipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.llm.lookalike import look
from tarazu.session import stage_table

#: Consecutive words that make a passage; an item that is shorter must occur in whole.
PASSAGE = 10
#: Tokens in a shard of the index, about (a longer document is a shard of its own), and words of test items in a block.
SHARD_TOKENS, BLOCK_WORDS = 1 << 18, 500_000
#: Other words that may stand between those of a proximity match.
SLOP = 4

_WORD = re.compile(r"[^\W_]+")
#: Texts of these characters alone show what they encode: no look-alikes, marks or invisible characters; ZWNJ, a blank here, separates.
_PLAIN = re.compile("[\\s -~¡-§«°±¶»¿-ÿ‌…—‘-”ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیآأؤئء،؛؟٪]*")


def words(text: str | None) -> list[str]:
    """The words a text shows: runs of letters and digits, letter case and look-alikes made equal."""
    if not text:
        return []
    return _WORD.findall((text if _PLAIN.fullmatch(text) else look(text)).casefold())


_INDEX = T.StructType(
    [
        T.StructField("doc_ids", T.ArrayType(T.LongType(), False), False),
        T.StructField("starts", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("terms", T.ArrayType(T.StringType(), False), False),
        T.StructField("counts", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("postings", T.BinaryType(), False),
    ]
)
_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])


def _shard(doc_ids: list[int], lengths: list[int], stream: list[str]) -> pa.RecordBatch:
    """A row of the index: the documents, where each starts in the shard's stream of words, and the positions of every word, as steps from the one
    before, word after word."""
    coded = pa.array(stream, pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    values = [doc_ids, np.cumsum([0, *lengths[:-1]]), coded.dictionary.to_pylist(), np.diff(np.r_[first, len(order)]), steps.astype("<i4").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW)], schema=_ARROW)


def build_index(docs: DataFrame, doc_id: str, text: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The positional index of all words of all documents, one row a shard of about ``shard_tokens`` words (a longer document is a shard of its own).

    Ids are whole numbers.  Rows with a null id or text and texts without a word are not in it; a row given twice is in it twice.  Nothing is shuffled.
    Write it once (``stage_table`` or a table of your own) and give it to :func:`search_index` as often as there are test sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int] = []
        lengths: list[int] = []
        stream: list[str] = []
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words(t.as_py())
                if not own:
                    continue
                doc_ids.append(d)
                lengths.append(len(own))
                stream += own
                if len(stream) >= shard_tokens:
                    yield _shard(doc_ids, lengths, stream)
                    doc_ids, lengths, stream = [], [], []
        if doc_ids:
            yield _shard(doc_ids, lengths, stream)

    known = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL AND t <> ''")
    return known.mapInArrow(run, _INDEX)


#: A window: its words' numbers, their places from the rarest on, and the items that have it.
Window = tuple[tuple[int, ...], np.ndarray, list[int]]


def _windows(items: list[tuple[int, list[int]]], size: int, frequency: np.ndarray) -> dict[int, list[Window]]:
    """The distinct windows of the items by the number of their rarest word."""
    seen: dict[tuple[int, ...], list[int]] = {}
    for item, terms in items:
        n = min(size, len(terms))
        for at in range(len(terms) - n + 1):
            own = seen.setdefault(tuple(terms[at : at + n]), [])
            if not own or own[-1] != item:
                own.append(item)
    out: dict[int, list[Window]] = {}
    for w, own in seen.items():
        order = np.argsort(frequency[list(w)], kind="stable")
        out.setdefault(w[order[0]], []).append((w, order, own))
    return out


def _exact(window: tuple[int, ...], order: np.ndarray, lists: dict[int, np.ndarray]) -> np.ndarray:
    """Positions at which the window starts: offset-adjusted lists intersected, the rarest first."""
    found = lists[window[order[0]]] - order[0]
    for o in order[1:]:
        p = lists[window[o]]
        at = np.searchsorted(p, found + o)
        at[at == len(p)] = 0
        found = found[p[at] == found + o]
        if not len(found):
            break
    return found


def _near(window: tuple[int, ...], order: np.ndarray, lists: dict[int, np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions at which the window's words stand in order within ``slop`` other words, around each of its rarest word's."""
    a = order[0]
    lo = hi = lists[window[a]]
    limit = len(window) - 1 + slop
    for o in [*range(a + 1, len(window)), *range(a - 1, -1, -1)]:
        p, after = lists[window[o]], o > a
        at = np.searchsorted(p, hi, "right") if after else np.searchsorted(p, lo, "left") - 1
        ok = (at < len(p)) & (at >= 0)
        lo, hi, found = lo[ok], hi[ok], p[at[ok]]
        lo, hi = (lo, found) if after else (found, hi)
        ok = hi - lo <= limit
        lo, hi = lo[ok], hi[ok]
        if not len(lo):
            break
    return lo, hi


def _search_block(index: DataFrame, items: list[tuple[int, list[str]]], size: int, slop: int | None) -> tuple[DataFrame, Broadcast]:
    """Matches of a block of items, and what was shipped for them."""
    spark = index.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, own in items for w in own}))}
    asked = spark.createDataFrame(pd.DataFrame({"term": list(vocabulary)}, dtype="object"), "term string")
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    frequency = np.zeros(max(1, len(vocabulary)), np.int64)
    for r in counts.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # one number for each word of the block
        frequency[vocabulary[r.term]] = r.n
    shipped = spark.sparkContext.broadcast((list(vocabulary), _windows([(i, [vocabulary[w] for w in own]) for i, own in items], size, frequency)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, windows = shipped.value
        asked = pa.array(terms, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, starts, own, n = (batch.column(k)[row].values for k in range(4))
                place = pc.index_in(asked, value_set=own)
                here = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                ends = np.cumsum(n.to_numpy())
                steps = np.frombuffer(batch.column(4)[row].as_buffer(), "<i4")
                lists = {}
                for t, k in zip(here.tolist(), place.take(pa.array(here)).to_pylist()):
                    lists[t] = np.cumsum(steps[ends[k - 1] if k else 0 : ends[k]], dtype=np.int64)
                starts = starts.to_numpy()
                hits: dict[tuple[int, int], str] = {}
                for t in lists.keys() & windows.keys():
                    for window, order, items_of in windows[t]:
                        if not all(x in lists for x in window):
                            continue
                        lo = _exact(window, order, lists)
                        found = [("phrase", lo, lo + len(window) - 1), *([("proximity", *_near(window, order, lists, slop))] if slop is not None else [])]
                        for kind, lo, hi in found:
                            d = np.searchsorted(starts, lo, "right") - 1
                            for k in set(d[d == np.searchsorted(starts, hi, "right") - 1].tolist()):  # begins and ends in one document
                                for i in items_of:
                                    if hits.get((k, i)) != "phrase":
                                        hits[k, i] = kind
                if hits:
                    docs = doc_ids.take(pa.array([k for k, _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([docs, pa.array([i for _, i in hits], pa.int64()), pa.array(list(hits.values()), pa.string())], names=["doc_id", "item_id", "kind"])

    return index.mapInArrow(run, "doc_id long, item_id long, kind string"), shipped


def search_index(index: DataFrame, items: DataFrame, item_id: str, item_text: str, size: int = PASSAGE, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, kind)``, each pair once: indexed documents that share ``size`` consecutive words with an item, or hold the whole item if it is
    shorter (``phrase``); with ``slop``, also those that have such a passage in order with up to ``slop`` other words in it (``proximity``).

    Ids are whole numbers.  Items with a null id or text or without a word match nothing; repeated rows change nothing; there may be no items."""
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL AND t <> ''").distinct()
    letters = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-letters // (6 * block_words)))
    found = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else known
        held = sorted((r.i, own) for r in part.toLocalIterator() if (own := words(r.t)))  # a block of bounded size
        got, shipped = _search_block(index, held, size, slop)
        if blocks > 1:
            got = stage_table(got, "matches")
            shipped.destroy()
        found = got if found is None else found.unionByName(got)
    # A document given twice is in two shards: one row a pair, the phrase before the proximity.
    return found.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"))


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = PASSAGE, slop: int | None = None, block_words: int = BLOCK_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The matches of one test set in documents that have no stored index: :func:`build_index`, written to the shared folder, and
    :func:`search_index`.  Either table may be empty; other columns are not read."""
    index = stage_table(build_index(docs, doc_id, text, shard_tokens), "positional-index", compression="zstd")
    return search_index(index, items, item_id, item_text, size, slop, block_words)
