"""Freely typed values mapped to the entries of a canonical list.

Method: values are deduplicated and normalised; spans of a value (its words, neighbouring words joined, words split) look up the
words of the list in an inverted index of character n-grams; a candidate is scored by the cosine of the n-gram vectors, weighted by how rare an
n-gram is among the list's words, and accepted above a threshold.  An exact check follows: a word counts as carried only if the span is it with no
more typing errors than its length allows.  The value means the entry of which it carries at least ``MIN_WORDS`` words in disjoint spans and whose
cosines, weighted by letters, lead every other entry's by a margin; otherwise it is unmatched.

Weights, exact words and candidates come from the words of the whole list, never of a part of it: entries are worked off in blocks, and, beyond a
number of distinct words, so are the words, and neither changes a result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.llm.lookalike import look
from tarazu.session import stage_table

#: Cosine from which a span can be a word (a word of three letters with one error has 0.17 at least); cosine from which a token is no words typed
#: together.
THRESHOLD, WHOLE = 0.15, 0.3
#: Words of an entry that a value must carry, and the lead (share of the score) over the next entry.
MIN_WORDS, MARGIN = 2, 0.02
#: Words of neighbouring tokens that are tried as one.
JOINED = 3
#: Entries of the list held by a task at once, and distinct words of the list that are shipped to every task; beyond either, blocks of that size are
#: worked off by tasks of their own.
BLOCK, WORDS = 50_000, 200_000
#: Places that n-grams are hashed to when their frequencies are counted: the bound of what is shipped of them.
GRAM_PLACES = 1 << 16

# Letters that sound the same, written as the first of each row; they are what typists confuse.
SOUNDS = {"س": "ثص", "ز": "ذضظ", "ت": "ط", "ه": "ح", "ق": "غ", "ا": "آأإ", "و": "ؤ"}
_SOUND = str.maketrans({c: to for to, group in SOUNDS.items() for c in group} | {c: None for c in map(chr, [0x640, *range(0x64B, 0x660), 0x670])})
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+(?:\.(?![^\W_]))?")


def edits(a: str, b: str, most: int) -> int:
    """Letters replaced, added, dropped or swapped with their neighbour to get from ``a`` to ``b``; ``most`` + 1 if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def slips(word: str) -> int:
    """Typing errors that a word of this length may hold."""
    return 0 if len(word) < 3 else 1 if len(word) < 8 else 2


def words_of(text: str | None) -> list[str]:
    """The words of a text in one spelling: look-alikes, letters of one sound and letter case made equal, marks and kashida removed."""
    return _WORD.findall(_plain(text)) if text else []


def tokens_of(text: str | None) -> list[str]:
    """As :func:`words_of`, but a word cut short with a full stop keeps it."""
    return _TOKEN.findall(_plain(text)) if text else []


def _plain(text: str) -> str:
    return look(text).translate(_SOUND).lower()


@functools.lru_cache(maxsize=1 << 18)
def grams(word: str) -> tuple[tuple[str, float], ...]:
    """Character n-grams: single characters, neighbours with the ends marked, and, at half weight, pairs around one character."""
    padded = f"^{word}$"
    out: dict[str, float] = defaultdict(float)
    for c in word:
        out[c] += 1.0
    for i in range(len(padded) - 1):
        out[padded[i : i + 2]] += 1.0
    for i in range(len(padded) - 2):
        out[padded[i] + "*" + padded[i + 2]] += 0.5
    return tuple(out.items())


def place(gram: str) -> int:
    """Where the frequency of an n-gram is counted."""
    return zlib.crc32(gram.encode()) % GRAM_PLACES


#: What a span can be: a word of the list, the cosine, whether it is spelt so, and how many tokens the name that it is like has.
Hit = tuple[str, float, bool, int]


class Words:
    """An inverted n-gram index over words of a list and their other names, or over a part of them."""

    def __init__(self, surfaces: list[tuple[str, str, int]], frequency: dict[int, int], total: int):
        """``surfaces``: (spelling, word of the list, tokens of the spelling); ``frequency``: spellings of the whole list by place of their n-grams."""
        self.surfaces, self.frequency, self.total = surfaces, frequency, max(1, total)
        self.longest = max((len(s) + slips(s) for s, _, _ in surfaces), default=0)
        self.exact: dict[str, list[Hit]] = defaultdict(list)
        self.cut_short: dict[str, dict[str, str]] = defaultdict(dict)
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (s, w, n) in enumerate(surfaces):
            self.exact[s].append((w, 1.0, True, n))
            for m in range(3, len(s)):
                self.cut_short[s[:m]][w] = s
            for g, v in self.vector(s).items():
                self.postings[g].append((k, v))
        self.measured = [(s, w, frozenset(s), slips(s), n) for s, w, n in surfaces]
        self._cache: dict[str, list[Hit]] = {}

    def vector(self, word: str) -> dict[str, float]:
        v = {g: tf * math.log(1 + self.total / max(1, self.frequency.get(place(g), 0))) for g, tf in grams(word)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    def lookup(self, span: str) -> list[Hit]:
        """What a span can be, in the index's part of the list.  One that ends with a full stop is a word cut short."""
        if span in self.exact:  # spelt right, it is no slip of another word
            return self.exact[span]
        found = self._cache.get(span)
        if found is None:
            found = self._short(span[:-1]) if span.endswith(".") else self._like(span)
            if len(self._cache) >= 1 << 18:  # the cache saves time only
                self._cache.clear()
            self._cache[span] = found
        return found

    def _like(self, span: str) -> list[Hit]:
        score: dict[int, float] = defaultdict(float)
        for g, v in self.vector(span).items():
            for k, w in self.postings.get(g, ()):
                score[k] += v * w
        best: dict[tuple[str, int], float] = {}
        letters = frozenset(span)
        for k, s in score.items():
            if s < THRESHOLD:
                continue
            surface, word, own, most, n = self.measured[k]
            # Each slip changes the length, the letters missing and the letters too many by one at most.
            if abs(len(surface) - len(span)) > most or len(own - letters) > most or len(letters - own) > most:
                continue
            if edits(span, surface, most) <= most:
                best[word, n] = max(best.get((word, n), 0.0), round(s, 9))
        return [(w, s, False, n) for (w, n), s in sorted(best.items())]

    def _short(self, start: str) -> list[Hit]:
        v = self.vector(start)
        return [(w, round(sum(x * v.get(g, 0.0) for g, x in self.vector(s).items()), 9), False, 1) for w, s in sorted(self.cut_short.get(start, {}).items())]


class Reader:
    """What a value can carry, given what each span of it can be."""

    def __init__(self, lookup: Callable[[str], list[Hit]], longest: int):
        self.lookup, self.longest = lookup, longest

    def is_word(self, span: str) -> bool:
        return any(exact for _, _, exact, _ in self.lookup(span))

    def candidates(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(from, to, word, cosine): characters of the value, counted without blanks, that can stand for a word of the list."""
        given = tokens_of(text)
        tokens = [t.rstrip(".") for t in given]
        starts = [0]
        for t in tokens:
            starts.append(starts[-1] + len(t))
        out = []
        best = [0.0] * len(tokens)
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + JOINED) + 1):
                span = "".join(tokens[i:j])
                if len(span) > self.longest:
                    break
                # Tokens are joined to find names of as many words; one word is not looked for in two, unless it is there letter by letter.
                for w, s, exact, n in self.lookup(span):
                    if j == i + 1 or exact or n == j - i:
                        out.append((starts[i], starts[j], w, s))
                        for k in range(i, j):
                            best[k] = max(best[k], s)
        for i, t in enumerate(tokens):
            if given[i].endswith("."):
                out += [(starts[i], starts[i + 1], w, s) for w, s, _, _ in self.lookup(given[i])]
            if len(t) >= 6 and best[i] < WHOLE:  # words typed together with others: parts at its ends may hold one slip, those inside none
                for a in range(len(t) - 2):
                    for b in range(a + 3, min(a + self.longest, len(t) - (a == 0)) + 1):
                        out += [(starts[i] + a, starts[i] + b, w, s) for w, s in self.part(t[a:b], a == 0 or b == len(t))]
            if not self.is_word(t):
                out += [(starts[i] + a, starts[i] + b, w, s) for a, b, w, s in self.split(t)]
        return out

    def part(self, span: str, at_end: bool) -> list[tuple[str, float]]:
        """Words that a part of a token stands for, whatever the rest is: spelt right, from 4 letters on, or, at an end of the token, with one slip from 6
        letters on."""
        hits = self.lookup(span)
        if any(exact for _, _, exact, _ in hits):
            return [(w, s) for w, s, _, _ in hits] if len(span) >= 4 else []
        return [(w, s) for w, s, _, _ in hits if edits(span, w, 1) <= 1 and len(w) >= 6] if at_end and len(span) >= 5 else []

    def split(self, token: str) -> list[tuple[int, int, str, float]]:
        """(from, to, word, cosine) of a token that is words typed together from end to end: each of two or more parts is a word of the list
        of any length, spelt right or with the slips it may hold."""
        end, steps, ends = len(token), [], {0}
        for a in range(end):
            if a in ends:
                for b in range(a + 1, min(end, a + self.longest) + 1):
                    if b - a < end and (words := self.lookup(token[a:b])):
                        steps.append((a, b, words))
                        ends.add(b)
        starts, out = {end}, []
        for a, b, words in reversed(steps):  # from the end, so that a part is kept only if the rest is words too
            if b in starts:
                starts.add(a)
                out += [(a, b, w, s) for w, s, _, _ in words]
        return out

    def spans(self, text: str | None) -> set[str]:
        """Every span that :meth:`candidates` may look up, whatever the list's words."""
        given = tokens_of(text)
        tokens = [t.rstrip(".") for t in given]
        joined = {"".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + JOINED) + 1)}
        parts = {t[a:b] for t in tokens for a in range(len(t)) for b in range(a + 1, min(len(t), a + self.longest) + 1)}
        return {s for s in joined | parts if len(s) <= self.longest} | {t for t in given if t.endswith(".")}


class Titles:
    """Entries of a list by their words."""

    def __init__(self, titles: list[tuple[str, tuple[str, ...]]]):
        self.ids = [i for i, _ in titles]
        self.words = [frozenset(w) for _, w in titles]
        self.with_word: dict[str, list[int]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            for w in sorted(ws):
                self.with_word[w].append(n)

    def match(self, found: list[tuple[int, int, str, float]]) -> list[tuple[float, int]]:
        """(score, number) of the entries of which the candidates carry enough words, best first."""
        spans: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        for a, b, w, s in found:
            if w in self.with_word:
                spans[w].append((a, b, s))
        if len(spans) < MIN_WORDS:
            return []
        # An entry with enough words has one besides the MIN_WORDS - 1 most common: a word that most entries have is not walked through.
        rare = sorted(spans, key=lambda w: (len(self.with_word[w]), w))[: len(spans) - MIN_WORDS + 1]
        scored = []
        for n in {n for w in rare for n in self.with_word[w]}:
            own = {w: spans[w] for w in self.words[n] if w in spans}
            if len(own) >= MIN_WORDS:
                words, score = assign(own)
                if words >= MIN_WORDS:
                    scored.append((score, n))
        return sorted(scored, key=lambda x: (-x[0], self.ids[x[1]]))


def assign(spans: dict[str, list[tuple[int, int, float]]]) -> tuple[int, float]:
    """As many words as disjoint spans can stand for, and the greatest sum of cosine x letters with them.

    Words whose spans meet no other word's are taken as they are; the others are assigned together, group by group."""
    names = sorted(spans)
    best: list[dict[tuple[int, int], float]] = []
    for w in names:
        own: dict[tuple[int, int], float] = {}
        for a, b, s in spans[w]:
            own[a, b] = max(own.get((a, b), 0.0), s * (b - a))
        best.append(own)
    group = list(range(len(names)))
    reach: list[tuple[int, int, int]] = sorted((a, b, k) for k, own in enumerate(best) for a, b in own)
    open_to, last = -1, -1
    for a, b, k in reach:  # spans that overlap join the groups of their words
        if a < open_to and group[k] != group[last]:
            old, new = group[k], group[last]
            group = [new if g == old else g for g in group]
        if b > open_to:
            open_to, last = b, k
    words, score = 0, 0.0
    for g in set(group):
        members = [k for k in range(len(names)) if group[k] == g]
        steps = sorted((b, a, i, s) for i, k in enumerate(members) for (a, b), s in best[k].items())
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}  # (words used, end of the last span) -> score
        for b, a, i, s in steps:
            for (used, end), had in list(states.items()):
                if end <= a and not used >> i & 1:
                    to = (used | 1 << i, b)
                    states[to] = max(states.get(to, -1.0), had + s)
        n, s = max((used.bit_count(), x) for (used, _), x in states.items())
        words, score = words + n, score + s
    return words, round(score, 9)


def canonical_titles(titles: DataFrame, key: str, title: str) -> DataFrame:
    """``(key, words)``: one spelling for each distinct entry; of several the one most rows have, then the first in order."""
    spelled = titles.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), _words_udf(F.col(title)).alias("words")).where(F.size("words") > 0)
    counted = spelled.groupBy("__k", "words").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("__k").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("words"))).alias("b"))
    return best.select(F.col("__k").alias(key), "b.words")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: words_of(t) if isinstance(t, str) else [])


def _longest(surfaces: DataFrame) -> int:
    return surfaces.agg(F.max(F.length("surface") + F.when(F.length("surface") < 3, 0).when(F.length("surface") < 8, 1).otherwise(2))).first()[0] or 0


def _known_by_span(values: DataFrame, surfaces: DataFrame, n_words: int, block: int, longest: int, frequency: dict[int, int], tasks: int) -> DataFrame:
    """``(value, hits)``: every span of every value that can be a word, looked up by blocks of the list's words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lambda span: [], longest)
        for batch in batches:
            rows = [(v, s) for v in batch["value"] for s in sorted(reader.spans(v))]
            yield pd.DataFrame(rows, columns=["value", "span"])

    def look_up(keys: tuple, spans: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        index = Words(list(words[["surface", "word", "n"]].itertuples(index=False, name=None)), frequency, n_words)
        rows = [(s, *hit) for s in spans["span"] for hit in index.lookup(s)]
        return pd.DataFrame(rows, columns=["span", "word", "score", "exact", "n"])

    blocks = max(1, -(-n_words // block))
    spans = stage_table(values.mapInPandas(cut, "value string, span string"), "spans")
    each = spans.select("span").distinct().select("span", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("span"), F.lit(tasks)).alias("part"))
    held = surfaces.select("surface", "word", "n", F.pmod(F.xxhash64("surface"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("part"))
    each, held = each.repartition(tasks, "block", "part"), held.repartition(tasks, "block", "part")
    hits = each.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(look_up, "span string, word string, score double, exact boolean, n int")
    by_span = hits.groupBy("span").agg(F.collect_set(F.struct("word", "score", "exact", "n")).alias("hits"))  # words within a slip or two of one span
    spelt = F.filter("hits", lambda h: h["exact"])
    by_span = by_span.select("span", F.when(F.size(spelt) > 0, spelt).otherwise(F.col("hits")).alias("hits"))
    return values.join(spans.join(by_span, "span").groupBy("value").agg(F.collect_list(F.struct("span", "hits")).alias("spans")), "value", "left")


def map_values(values: DataFrame, value: str, titles: DataFrame, key: str, title: str, aliases: DataFrame, alias_of: str, alias: str, unmatched: str | None = None, block: int = BLOCK, most_words: int = WORDS) -> DataFrame:
    """``(value, entry, score)``: each distinct value of the column with the entry of the list it means, or ``unmatched``.

    ``titles``: the list, any number of rows for one ``key``; ``aliases``: other names (``alias``) of single words (``alias_of``).  Values are deduplicated
    before anything else, so a value that a third of all rows have costs one comparison.  Up to ``most_words`` distinct words of the list go to every
    task; a list with more has its words looked up in blocks.  Entries are compared in blocks of ``block``, all in one plan, and the best of all
    blocks wins.  Results do not depend on either number.

    Null and empty values are left out; a value that carries words of two entries alike (their scores within ``MARGIN``) is unmatched.  Entries with
    fewer than ``MIN_WORDS`` words, null keys and null titles match nothing; with an empty list every value is unmatched.
    """
    spark = values.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(F.col(value).cast("string").alias("value")).where("value IS NOT NULL AND value <> ''").distinct()
    # Read several times below, and made by a Python function: written once.
    entries = stage_table(canonical_titles(titles.select(F.col(key).cast("string").alias("k"), F.col(title).alias("t")), "k", "t"), "entries")
    own = entries.select(F.explode("words").alias("word")).distinct()
    names = aliases.where(F.col(alias_of).isNotNull() & F.col(alias).isNotNull()).select(F.array_join(_words_udf(F.col(alias_of).cast("string")), "").alias("word"), _words_udf(F.col(alias).cast("string")).alias("name"))
    named = names.where("word <> '' AND size(name) > 0").join(own, "word", "left_semi").select(F.array_join("name", "").alias("surface"), "word", F.size("name").alias("n"))
    surfaces = stage_table(own.select(F.col("word").alias("surface"), "word", F.lit(1).alias("n")).unionByName(named).distinct(), "surfaces")
    spellings = surfaces.select("surface").distinct()
    n_words, longest = spellings.count(), _longest(surfaces)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(words: pd.Series) -> pd.Series:
        return words.map(lambda w: sorted({place(g) for g, _ in grams(w)}))

    counted = spellings.select(F.explode(places("surface")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r.p: r.n for r in counted.collect()}  # GRAM_PLACES numbers at most

    by_span = n_words > most_words
    if by_span:
        asked = _known_by_span(distinct, surfaces, n_words, most_words, longest, frequency, tasks)
        shipped = None
    else:
        asked = distinct.withColumn("spans", F.lit(None).cast("int"))
        shipped = spark.sparkContext.broadcast(sorted((r.surface, r.word, r.n) for r in surfaces.collect()))

    blocks = max(1, -(-entries.count() // block))
    at_once = sorted((r.k, tuple(r.words)) for r in entries.collect()) if blocks == 1 else None  # a block at most

    def answers(given: pd.DataFrame, index: Titles, words: Words | None) -> pd.DataFrame:
        rows = []
        for v, spans in zip(given["value"], given["spans"]):
            if words is None:
                hits = {s["span"]: [(h["word"], h["score"], bool(h["exact"]), int(h["n"])) for h in s["hits"]] for s in (spans if spans is not None else ())}
                lookup = lambda span: hits.get(span, [])  # noqa: B023, E731
            else:
                lookup = words.lookup
            m = index.match(Reader(lookup, longest).candidates(v))
            rows.append((v, index.ids[m[0][1]], m[0][0], m[1][0] if len(m) > 1 else 0.0) if m else (v, None, 0.0, 0.0))
        return pd.DataFrame(rows, columns=["value", "entry", "score", "next_score"])

    def known_words() -> Words | None:
        return None if by_span else Words(shipped.value, frequency, n_words)

    def match_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, words = Titles(at_once), known_words()
        for batch in batches:
            yield answers(batch, index, words)

    def match_block(keys: tuple, given: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return answers(given, Titles(sorted((k, tuple(w)) for k, w in zip(held["k"], held["words"]))), known_words())

    # Few bytes, much work: adaptive execution would put all values into one task by their size, unless their number is given.
    result = "value string, entry string, score double, next_score double"
    if blocks == 1:
        found = asked.select("value", "spans").repartition(tasks).mapInPandas(match_all, result)
    else:
        parts = [F.pmod(F.xxhash64("value"), F.lit(tasks)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")]
        each = asked.select("value", "spans", *parts).repartition(tasks, "block", "part")
        held = entries.select("k", "words", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("part"))
        found = each.groupBy("block", "part").cogroup(held.repartition(tasks, "block", "part").groupBy("block", "part")).applyInPandas(match_block, result)
    if blocks > 1:
        top = F.max(F.struct("score", "entry", "next_score")).alias("b")
        ranked = found.groupBy("value").agg(top, F.sort_array(F.collect_list("score"), asc=False).alias("all"))
        found = ranked.select("value", "b.entry", "b.score", F.greatest("b.next_score", F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0.0))).alias("next_score"))
    sure = (F.col("score") > 0) & (F.col("score") - F.col("next_score") >= MARGIN * F.col("score"))
    return found.select("value", F.coalesce(F.when(sure, F.col("entry")), F.lit(unmatched)).alias("entry"), F.when(sure, F.col("score")).otherwise(0.0).alias("score"))
