"""Texts over a size limit in pieces under it, cut at natural boundaries, with an overlap between neighbours.

Method: a hierarchy of separators.  A text over the limit is cut at its sections; a part that is still over it at its paragraphs, then at its
lines, its sentences, its words and last between characters.  Parts of one parent are packed greedily, leaving room for the overlap.  A part
that fits the limit but not beside a whole overlap stays whole and gets a shorter one: a boundary is never given up for the overlap.  A piece
after the first begins with the end of the piece before it: as many of its last tokens as the overlap allows, from a word's start if there is
one.  Pieces are exact substrings: without their overlaps they give the text again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.tokens import DEFAULT_FILE, tokenizer

#: Tokens in a piece at most, and tokens of the piece before that a piece repeats at most.
LIMIT, OVERLAP = 512, 64
#: Tokens by which a part's size as a text of its own may lie below its size inside the text: so much is tried before it is measured.
SLACK = 2

#: From the strongest: where a part of each kind begins, as patterns whose match ends (or, for sections, begins) at the cut.
SEPARATORS = (
    ("section", re.compile(r"(?=\n#{1,6} )|(?=\n={3,}\s)")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?؟؛…]+[\"'»”)\]]*(?=\s)")),
    ("word", re.compile(r"(?=(?<=\S)\s)")),
)


class _Ruler:
    """Where a text can be cut, and how many tokens lie between."""

    def __init__(self, text: str, tok):
        self.text, self.tok = text, tok
        self.places, self.before = tok.steps(text)
        self._cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cuts(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the boundaries of one level, ascending, and about how many tokens lie before each."""
        if level not in self._cuts:
            at = np.unique(np.fromiter((m.end() for m in SEPARATORS[level][1].finditer(self.text)), np.int64))
            at = at[(at > 0) & (at < len(self.text))]
            self._cuts[level] = at, np.interp(at, self.places, self.before)
        return self._cuts[level]

    def about(self, at: int) -> float:
        """Tokens before a position, in proportion where it lies inside of what the tokenizer takes as one."""
        k = int(np.searchsorted(self.places, at))
        if self.places[k] == at:
            return float(self.before[k])
        lo, hi = int(self.places[k - 1]), int(self.places[k])
        return float(self.before[k - 1]) + float(self.before[k] - self.before[k - 1]) * (at - lo) / (hi - lo)

    def alone(self, a: int, b: int) -> int:
        """Tokens of the text from ``a`` to ``b`` as a text of its own."""
        return self.tok.between(self.text, self.places, self.before, a, b)

    def word_starts(self, a: int, b: int) -> list[int]:
        """Places from ``a`` to before ``b`` that begin a word (with the blank before it)."""
        text = self.text
        lo, hi = np.searchsorted(self.places, [max(a, 1), b])
        return [at for at in self.places[lo:hi].tolist() if text[at].isspace() and not text[at - 1].isspace()]


class _Splitter:
    """The contents of the pieces of one text, without their overlaps, from left to right."""

    def __init__(self, ruler: _Ruler, limit: int, overlap: int):
        self.ruler, self.limit, self.overlap = ruler, limit, overlap
        self.contents: list[tuple[int, int]] = []

    def room(self, first: bool) -> int:
        """Tokens that several parts may fill together: the overlap goes before them, unless nothing is before them."""
        return self.limit if first else self.limit - self.overlap

    def cut(self, a: int, b: int, level: int) -> None:
        """A part of the text: whole if it fits, else by the boundaries of this level, and finer ones for what does not fit then."""
        ruler, contents = self.ruler, self.contents
        if ruler.about(b) - ruler.about(a) <= self.limit + SLACK and ruler.alone(a, b) <= self.limit:
            contents.append((a, b))
            return
        if level == len(SEPARATORS):
            self.characters(a, b)
            return
        at, before = ruler.cuts(level)
        lo, hi = np.searchsorted(at, a, "right"), np.searchsorted(at, b, "left")
        edges, sizes = [a, *at[lo:hi].tolist(), b], np.r_[ruler.about(a), before[lo:hi], ruler.about(b)]
        k, begun = 0, a
        while k + 1 < len(edges):
            room = self.room(not contents)
            j = int(np.searchsorted(sizes, ruler.about(begun) + room + SLACK, "right")) - 1
            j = max(j, k + 1)
            while j > k + (begun == edges[k]) and ruler.alone(begun, edges[j]) > room:
                j -= 1
            if j <= k:  # what the part before left over stays alone
                contents.append((begun, edges[k]))
                begun = edges[k]
                continue
            if j == k + 1 and begun == edges[k]:
                self.cut(begun, edges[j], level + 1)
                # The last bit of a part that did not fit may go with the parts after it, but no section begins inside a piece then.
                if level and j + 1 < len(edges) and contents[-1][0] > begun:
                    begun = contents.pop()[0]
                else:
                    begun = edges[j]
            else:
                contents.append((begun, edges[j]))
                begun = edges[j]
            k = j
        if begun < b:
            contents.append((begun, b))

    def characters(self, a: int, b: int) -> None:
        """A word over the limit, between its characters (not before a mark that belongs to the one before)."""
        text, ruler = self.ruler.text, self.ruler
        while a < b:
            room = self.room(not self.contents)
            end = min(b, a + 8 * room)
            while end > a + 1 and (n := ruler.alone(a, end)) > room:
                end = a + max(1, min((end - a) * room // n, end - a - 1))
            while end < b and end > a + 1 and unicodedata.combining(text[end]):
                end -= 1
            self.contents.append((a, end))
            a = end

    def start(self, a: int, b: int, least: int) -> int:
        """Where the piece with the content from ``a`` to ``b`` begins, after ``least``: at a word, as far before ``a`` as overlap and limit allow."""
        ruler = self.ruler
        spare = min(self.overlap, self.limit - ruler.alone(a, b))
        if spare <= 0:
            return a
        k = int(np.searchsorted(ruler.before, ruler.about(a) - spare))
        lo = max(int(ruler.places[k]), least + 1)
        places = ruler.word_starts(lo, a) or ruler.places[np.searchsorted(ruler.places, lo) : np.searchsorted(ruler.places, a)].tolist()
        return next((p for p in places if ruler.alone(p, a) <= self.overlap and ruler.alone(p, b) <= self.limit), a)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, path: str = DEFAULT_FILE) -> list[tuple[int, int, int, int, int]]:
    """``(from, to, tokens, overlap, overlap_tokens)`` of the pieces of a text: character positions, tokens of the piece, and the characters at its
    beginning that the piece before it has too, with their tokens.  A text within the limit is one piece, an empty one none."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and larger than the overlap")
    if not text:
        return []
    tok = tokenizer(path)
    if len(text) <= limit and (n := tok.count(text)) <= limit:
        return [(0, len(text), n, 0, 0)]
    ruler = _Ruler(text, tok)
    if ruler.before[-1] <= limit + SLACK and (n := ruler.alone(0, len(text))) <= limit:
        return [(0, len(text), n, 0, 0)]
    splitter = _Splitter(ruler, limit, overlap)
    splitter.cut(0, len(text), 0)
    out: list[tuple[int, int, int, int, int]] = []
    for a, b in splitter.contents:
        start = splitter.start(a, b, out[-1][0]) if out and overlap else a
        out.append((start, b, ruler.alone(start, b), a - start, ruler.alone(start, a) if start < a else 0))
    return out


def split_documents(docs: DataFrame, doc_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer_file: str = DEFAULT_FILE) -> DataFrame:
    """``(doc_id, piece_n, n_pieces, start, end, n_tokens, overlap_chars, overlap_tokens, text)``: every document in pieces of at most ``limit`` tokens.

    A document within the limit is one piece; a null or empty text has none.  Only a single character that is more tokens than the
    limit makes a piece over it.  Nothing is shuffled: a document is split where it is read.  Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType
    names = ["doc_id", "piece_n", "n_pieces", "start", "end", "n_tokens", "overlap_chars", "overlap_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            owners: list[int] = []
            for row, t in enumerate(batch.column(1)):
                whole = t.as_py()
                if not whole:
                    continue
                pieces = split_text(whole, limit, overlap, tokenizer_file)
                for i, (a, b, n, o, on) in enumerate(pieces):
                    owners.append(row)
                    for c, v in zip(columns, (i + 1, len(pieces), a, b, n, o, on, whole[a:b])):
                        c.append(v)
                if len(owners) >= 20_000:
                    yield _batch(batch, owners, columns)
                    columns, owners = [[] for _ in range(8)], []
            if owners:
                yield _batch(batch, owners, columns)

    def _batch(batch: pa.RecordBatch, owners: list[int], columns: list[list]) -> pa.RecordBatch:
        types = [pa.int32()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    schema = f"doc_id {kind.simpleString()}, piece_n int, n_pieces int, start int, end int, n_tokens int, overlap_chars int, overlap_tokens int, text string"
    return docs.select(F.col(doc_id), F.col(text)).where(F.col(text) != "").mapInArrow(run, schema)


def piece_checks(docs: DataFrame, doc_id: str, text: str, pieces: DataFrame, limit: int = LIMIT, tokenizer_file: str = DEFAULT_FILE) -> DataFrame:
    """``(doc_id, rebuilt, over_limit, wrong_sizes, cut_paragraphs)`` of pieces as :func:`split_documents` gives them: the digest of the text they give
    without their overlaps, pieces of more than one character over the limit, pieces whose stated size is not that of their text, and ends
    inside a paragraph (of one section) that fits the limit.  Ids must be unique.  Null and empty texts have no row."""
    ordered = F.sort_array(F.collect_list(F.struct("piece_n", "start", "end", "overlap_chars", "n_tokens", F.col("text").alias("piece"))))
    held = pieces.groupBy("doc_id").agg(ordered.alias("pieces"))  # as large as the document
    both = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("whole")).join(held, "doc_id").select("doc_id", "whole", "pieces")

    @F.pandas_udf("over_limit int, wrong_sizes int, cut_paragraphs int")
    def checked(wholes: pd.Series, given: pd.Series) -> pd.DataFrame:
        count, out = tokenizer(tokenizer_file).count, []
        for whole, own in zip(wholes, given):
            sizes = [count(p["piece"]) for p in own]
            ends, cut, at = {p["end"] for p in own}, 0, 0
            for to in sorted({m.end() for _, cuts in SEPARATORS[:2] for m in cuts.finditer(whole)} | {len(whole)}):
                inside = sum(at < e < to for e in ends)
                cut += inside if inside and count(whole[at:to]) <= limit else 0
                at = to
            over = sum(n > limit and len(p["piece"]) > 1 for n, p in zip(sizes, own))
            out.append((over, sum(n != p["n_tokens"] for n, p in zip(sizes, own)), cut))
        return pd.DataFrame(out, columns=["over_limit", "wrong_sizes", "cut_paragraphs"])

    rebuilt = F.md5(F.array_join(F.transform("pieces", lambda p: F.substring(p["piece"], p["overlap_chars"] + 1, F.length(p["piece"]))), ""))
    return both.select("doc_id", rebuilt.alias("rebuilt"), checked("whole", "pieces").alias("c")).select("doc_id", "rebuilt", "c.*")
