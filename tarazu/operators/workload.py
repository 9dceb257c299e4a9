"""Query sets made from catalog titles: derivation of queries, their labels, sampling under quotas, noise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.functions import text as tx

# How parts of a title are recognised.
ADMIN_NOTE = "سازمان امور مالیاتی"
MAKER_STARTS = ["سازنده", "تولید کننده", "تولیدکننده", "شرکت"]
COUNTRY_STARTS = ["کشور", "ساخت "]
COUNTRIES = ["ایران", "چین", "ژاپن", "کره جنوبی", "کره", "المان", "آلمان", "ایتالیا", "ترکیه", "هند", "امریکا", "آمریکا", "ایالات متحده", "ایالات متحده امریکا", "فرانسه", "انگلستان", "تایوان", "امارات", "امارات متحده عربی", "روسیه", "اسپانیا", "سوید", "سوئد", "سوییس", "سوئیس", "هلند", "بلژیک", "اتریش", "لهستان", "چک", "مالزی", "تایلند", "ویتنام", "اندونزی", "سنگاپور", "برزیل", "کانادا", "مکزیک", "دانمارک", "فنلاند", "اوکراین", "بلاروس", "پاکستان", "عراق", "عمان", "قطر", "مصر", "استرالیا", "هنگ کنگ", "اسلوونی", "مجارستان", "رومانی", "پرتغال", "ارمنستان"]
PACKING = ["بسته بندی", "بسته‌بندی"]
PAPER_WEIGHT = ["g\\m^2", "g/m^2", "گرم بر متر مربع"]
PART_NUMBER_STARTS = ["شماره فنی"]
BRAND_STARTS = ["برند ", "نام تجارتی "]
PLACEHOLDER = r"\A(?:(?:برند|مدل|نام تجارتی)\s+)?فاقد\s+(?:نام تجارتی|برند|مدل)\z"
LATIN_NAME = r"\A[A-Za-z][A-Za-z0-9 .&+\-]*\z"
SERVICE = "خدمت"

#: Words of an attribute that a query keeps.
ATTRIBUTE_WORDS = 4


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _starts(s: Column, words: list[str]) -> Column:
    return _any([s.startswith(w) for w in words])


def _holds(s: Column, words: list[str]) -> Column:
    return _any([s.contains(w) for w in words])


def derive(title: Column, type_: Column) -> Column:
    """A struct ``(head, brand, attrs)`` of a title.

    Titles of services are cut at slashes, all others, after the maker at the end is taken off, at commas.  The head is the first part;
    parts that name a placeholder, maker, country, packing, paper weight or part number are left out; the first part that
    names a brand (or, among the first two, is Latin) is the brand; what is left are attributes, in order.  A null title gives nulls.
    """
    flat = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    at = F.instr(flat, ADMIN_NOTE)
    flat = F.when(at > 0, F.regexp_replace(F.substring(flat, F.lit(1), at - 1), r"[ /]+\z", "")).otherwise(flat)
    service = F.coalesce(type_.endswith(SERVICE), F.lit(False))
    parts = F.when(service, F.split(flat, "/")).otherwise(F.split(F.regexp_replace(flat, r"/\s*شرکت[^/]*\z", ""), "،"))
    parts = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def kind(s: Column, i: Column) -> Column:
        left_out = F.replace(s, F.lit(tx.ZWNJ), F.lit(" ")).rlike(PLACEHOLDER) | _starts(s, MAKER_STARTS) | s.isin(COUNTRIES) | _starts(s, COUNTRY_STARTS) | _holds(s, PACKING) | _holds(s, PAPER_WEIGHT) | _starts(s, PART_NUMBER_STARTS)
        return F.when(left_out, "out").when(_starts(s, BRAND_STARTS), "named").when((i < 2) & s.rlike(LATIN_NAME), "latin").otherwise("attr")

    marked = F.transform(rest, lambda s, i: F.struct(s.alias("s"), kind(s, i).alias("k"), i.alias("i")))
    brands = F.filter(marked, lambda m: m["k"].isin("named", "latin"))
    first = F.try_element_at(brands, F.lit(1))
    name = F.when(first["k"] == "named", F.regexp_replace(first["s"], r"\A(?:نام تجارتی |[^ ]+ )", "")).otherwise(first["s"])
    attrs = F.transform(F.filter(marked, lambda m: (m["k"] != "out") & ~F.coalesce(m["i"] == first["i"], F.lit(False))), lambda m: m["s"])
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("head"), name.alias("brand"), attrs.alias("attrs"))


def _short(attr: Column) -> Column:
    return F.array_join(F.slice(F.split(attr, " "), 1, ATTRIBUTE_WORDS), " ")


def build_query(d: Column, n_attributes: int) -> Column:
    """Head, brand and the first attributes of a derived title as one text, long attributes cut short, commas gone."""
    words = F.concat(F.array(d["head"]), F.when(d["brand"].isNotNull(), F.array(d["brand"])).otherwise(F.array().cast("array<string>")), F.transform(F.slice(d["attrs"], 1, n_attributes), _short))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(words, " "), "،", " "), r"(?U)\s+", " "))


def detail_queries(title: Column, type_: Column, d: Column) -> Column:
    """A struct ``(all_attrs, mfr, partno)`` of queries: head, brand and all attributes of a derived title; the same with its maker; with its
    part number.  The last two are null where a title names none."""
    flat = F.trim(F.regexp_replace(title, r"(?U)\s+", " "))
    service = F.coalesce(type_.endswith(SERVICE), F.lit(False))
    parts = F.transform(F.when(service, F.split(flat, "/")).otherwise(F.split(flat, "،")), lambda s: F.trim(s))
    named = F.array_join(F.filter(parts, lambda s: _starts(s, MAKER_STARTS)), " ")
    mfr = F.when(named != "", named).otherwise(F.regexp_extract(flat, r"/\s*(شرکت[^/]*)\z", 1))
    part = F.array_join(F.filter(parts, lambda s: _starts(s, PART_NUMBER_STARTS)), " ")
    base = F.array_join(F.concat(F.array(d["head"], d["brand"]), d["attrs"]), " ")
    more = lambda s: F.when(s != "", F.concat(base, F.lit(" "), s))
    return F.struct(base.alias("all_attrs"), more(mfr).alias("mfr"), more(part).alias("partno"))


def detail_ladder(d: Column, head: Column) -> Column:
    """An array of ``(level, query, required)``: L1 the head (tokens ``head``), L2 with one attribute, L3 with two, L4 with brand and up to
    two; ``required`` are the tokens besides the head.  Levels a title has no parts for are left out."""
    none = F.array().cast("array<string>")
    a = [F.when(F.size(d["attrs"]) > i, tx.tokenize(_short(F.try_element_at(d["attrs"], F.lit(i + 1))))).otherwise(none) for i in range(2)]
    brand = F.when(d["brand"].isNotNull(), tx.tokenize(d["brand"])).otherwise(none)
    step = lambda level, extra, has: F.when(has, F.struct(F.lit(level).alias("level"), F.concat(head, extra).alias("query"), extra.alias("required")))
    n = F.size(d["attrs"])
    return F.array_compact(F.array(step("L1", none, F.lit(True)), step("L2", a[0], n > 0), step("L3", F.concat(*a), n > 1), step("L4", F.concat(brand, *a), F.size(brand) > 0)))


def starts_with(tokens: Column, term: Column) -> Column:
    return F.slice(tokens, 1, F.greatest(F.size(term), F.lit(1))) == term


def has_run(tokens: Column, term: Column) -> Column:
    """Whether the term's tokens occur next to each other."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(term, " "), F.lit(" ")))


def replace_run(tokens: Column, term: Column, by: Column) -> Column:
    """A text of the tokens with the first run equal to ``term`` replaced; ``term`` must be in them."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    whole, found = padded(tokens), padded(term)
    at = F.instr(whole, found)
    return F.trim(F.concat(F.substring(whole, F.lit(1), at), F.array_join(by, " "), F.substring(whole, at + F.length(found) - 1, F.length(whole))))


def assign_terms(heads: DataFrame, key: str, tokens: str, terms: DataFrame, rule: str) -> DataFrame:
    """``(key, term_n, term)``: the longest listed term each head has under ``rule`` (``prefix`` or ``contains``), of equal ones the first
    listed; heads without one are left out.

    ``terms``: ``term_n``, ``term`` (tokens).  An equi-join on a span of the head's tokens, of the lengths that terms have: no head meets a
    term that it does not hold.
    """
    named = terms.where(F.size("term") > 0).select("term_n", "term", F.array_join("term", " ").alias("__span"), F.size("term").alias("__n"))
    lengths = named.agg(F.collect_set("__n").alias("ls"))  # one row of small numbers
    spans = heads.select(key, F.col(tokens).alias("__t")).crossJoin(F.broadcast(lengths))
    n = F.size("__t")
    if rule == "prefix":
        cut = F.transform(F.filter("ls", lambda x: x <= n), lambda x: F.array_join(F.slice("__t", 1, x), " "))
    elif rule == "contains":
        cut = F.array_distinct(F.flatten(F.transform(F.filter("ls", lambda x: x <= n), lambda x: F.transform(F.sequence(F.lit(1), n - x + 1), lambda i: F.array_join(F.slice("__t", i, x), " ")))))
    else:
        raise ValueError(f"no rule {rule}")
    met = spans.select(key, F.explode(cut).alias("__span")).join(named, "__span")
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("term_n"), F.col("term"))).alias("b"))
    return best.select(key, "b.term_n", "b.term")


def subset_ids(rows: DataFrame, ids: str, tokens: str, queries: DataFrame, query: str, wanted: str) -> DataFrame:
    """``(query, __id)``: the distinct IDs that have a title with all of the query's tokens.

    Each query probes only the titles that hold its rarest token, by an equi-join, and the rest is a subset test.  Queries without
    tokens or with a token no title has match nothing.
    """
    seen = rows.select(F.explode(F.array_distinct(tokens)).alias("__term")).groupBy("__term").agg(F.count(F.lit(1)).alias("__df"))
    asked = queries.select(query, F.array_distinct(wanted).alias("__w"))
    rare = asked.select(query, "__w", F.explode("__w").alias("__term")).join(seen, "__term").groupBy(query).agg(F.min(F.struct("__df", "__term")).alias("r"), F.first("__w").alias("__w"), F.count(F.lit(1)).alias("known"))
    probe = rare.where(F.col("known") == F.size("__w")).select(query, "__w", F.col("r.__term").alias("__term"))
    held = rows.select(F.col(ids).alias("__id"), F.array_distinct(tokens).alias("__t")).distinct()
    # A title is sent only for tokens that some query probes.
    probed = probe.select("__term").distinct()
    sent = held.select("__id", "__t", F.explode("__t").alias("__term")).join(probed, "__term", "left_semi")
    hit = probe.join(sent, "__term").where(F.size(F.array_except("__w", "__t")) == 0)
    return hit.select(query, "__id").distinct()


def subset_matches(rows: DataFrame, ids: str, tokens: str, queries: DataFrame, query: str, wanted: str) -> DataFrame:
    """``(query, n_ids)``: how many IDs :func:`subset_ids` finds; queries that match nothing are reported with 0."""
    n = subset_ids(rows, ids, tokens, queries, query, wanted).groupBy(query).agg(F.count(F.lit(1)).alias("n_ids"))
    return queries.select(query).join(n, query, "left").select(query, F.coalesce("n_ids", F.lit(0)).alias("n_ids"))


def match_ids(rows: DataFrame, ids: str, tokens: str, queries: DataFrame, query: str, wanted: str, cap: int, exclude: DataFrame | None = None) -> DataFrame:
    """``(query, ids, n_ids)``: the IDs :func:`subset_ids` finds, in order, at most ``cap`` of them for a query, and their number: ``cap`` means as many or
    more.  IDs of ``exclude`` (a column ``ids``) are no answers.  Queries that match nothing have an empty list."""
    held = rows if exclude is None else rows.join(exclude.select(ids).where(F.col(ids).isNotNull()).distinct(), ids, "left_anti")
    found = subset_ids(held, ids, tokens, queries, query, wanted)
    kept = stratified(found, [query], [F.col("__id")], cap)  # a top-n window: a query that every ID answers sends cap rows a task
    listed = kept.groupBy(query).agg(F.sort_array(F.collect_list("__id")).alias("ids"))
    none = F.array().cast("array<string>")
    return queries.select(query).join(listed, query, "left").select(query, F.coalesce("ids", none).alias("ids"), F.size(F.coalesce("ids", none)).alias("n_ids"))


def seller_text(title: Column, key: Column) -> Column:
    """A title as sellers type it: half of those with a slash lose what follows it, slashes become blanks, and three changes come in three of ten each:
    Arabic letters, Persian digits, one blank as ZWNJ.  Which, by a digest of ``key``, so that a rebuild gives the same."""
    digest = F.md5(key.cast("string"))
    draw = lambda i: F.conv(F.substring(digest, 1 + 6 * i, 6), 16, 10).cast("long")
    hit = lambda i, share: draw(i) < int(share * (1 << 24))
    short = F.when(title.contains("/") & hit(0, 0.5), F.substring_index(title, "/", 1)).otherwise(title)
    t = F.trim(F.regexp_replace(F.replace(short, F.lit("/"), F.lit(" ")), r"(?U)\s+", " "))
    t = F.when(hit(1, 0.3), F.translate(t, "یک", "يك")).otherwise(t)
    t = F.when(hit(2, 0.3), F.translate(t, tx.LATIN_DIGITS, tx.PERSIAN_DIGITS)).otherwise(t)
    parts = F.split(t, " ")
    k = (draw(4) % (F.size(parts) - 1)).cast("int") + 1
    joined = F.concat(F.array_join(F.slice(parts, F.lit(1), k), " "), F.lit(tx.ZWNJ), F.array_join(F.slice(parts, k + 1, F.size(parts)), " "))
    return F.when(hit(3, 0.3) & (F.size(parts) > 1), joined).otherwise(t)


def vague_only(text: Column, words: list[str]) -> Column:
    """Whether every token that is no number is one of the listed words; true for no tokens at all."""
    listed = F.array(*(F.lit(w) for w in words))
    return F.forall(F.filter(tx.tokenize(text), lambda t: ~t.rlike(r"\A\p{N}+\z")), lambda t: F.array_contains(listed, t))


def _typo_words(text: Column) -> Column:
    """Places and lengths of the words a typing error can go into: those with four letters or more."""
    words = F.transform(F.split(text, " "), lambda w, i: F.struct(i.alias("i"), F.length(w).alias("n"), F.length(F.regexp_replace(w, r"[^\p{L}]", "")).alias("letters")))
    return F.filter(words, lambda x: x["letters"] >= 4)


def eligible_noise(text: Column) -> Column:
    """The noise rules that change something in a text, in order; none for null."""
    rules = {"arabic_letters": text.rlike("[یک]"), "no_zwnj": text.contains(tx.ZWNJ), "persian_digits": text.rlike("[0-9]"), "typo": F.size(_typo_words(text)) > 0}
    return F.array_compact(F.array(*(F.when(can, F.lit(r)) for r, can in rules.items())))


def noise(text: Column, rule: str, seed: int = 7) -> Column:
    """One noise rule applied to a text: ``arabic_letters``, ``no_zwnj``, ``persian_digits`` or ``typo`` (in a word of four letters or more two
    neighbours that differ swapped, or one character dropped; which, by a hash of text and seed).  A text without such a word stays."""
    if rule == "arabic_letters":
        return F.translate(text, "یک", "يك")
    if rule == "no_zwnj":
        return F.replace(text, F.lit(tx.ZWNJ), F.lit(""))
    if rule == "persian_digits":
        return F.translate(text, tx.LATIN_DIGITS, tx.PERSIAN_DIGITS)
    if rule != "typo":
        raise ValueError(f"no rule {rule}")
    words = F.split(text, " ")
    long = _typo_words(text)
    h = F.xxhash64(text, F.lit(seed))
    chosen = F.try_element_at(long, F.pmod(h, F.greatest(F.size(long), F.lit(1))).cast("int") + 1)
    at = F.pmod(F.shiftrightunsigned(h, 16), chosen["n"] - 1).cast("int")

    def change(w: Column) -> Column:
        head, a, b, tail = w.substr(F.lit(1), at), w.substr(at + 1, F.lit(1)), w.substr(at + 2, F.lit(1)), w.substr(at + 3, F.length(w))
        return F.when((F.pmod(h, 2) == 0) & (a != b), F.concat(head, b, a, tail)).otherwise(F.concat(head, b, tail))

    typed = F.array_join(F.transform(words, lambda w, i: F.when(i == chosen["i"], change(w)).otherwise(w)), " ")
    return F.when(F.size(long) > 0, typed).otherwise(text)


def stratified(rows: DataFrame, cells: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every cell, with ``place``.  A partial top-n runs before the shuffle, so a hot cell sends n rows a task."""
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(*cells).orderBy(*order)))
    return ranked.where(F.col("place") <= n)


def round_robin(rows: DataFrame, pair: str, head: str, order: list[Column], n: int) -> DataFrame:
    """Up to ``n`` rows of each pair, one of each head in turn: rounds first, then heads in the order of their first row.

    Only the first n rows of a head and the first n rows of a pair can take part; both are top-n windows."""
    first = stratified(rows, [pair, head], order, n).withColumnRenamed("place", "__round")
    return stratified(first, [pair], [F.col("__round"), *order], n).drop("__round")


def emit_until(rows: DataFrame, cell: str, quota: str, text: str, order: str) -> DataFrame:
    """The first ``quota`` rows of each cell, cells in order, whose text no row accepted before has; ``place`` counts the accepted ones.

    Only accepted rows block a text: one that lies beyond its own cell's quota can still be accepted in a later cell.  A cell can lose at most as many
    texts as the cells before it may accept, so of each cell only its first rows up to the sum of those quotas and its own can take part: a top-n window
    over distinct texts, after which as many rows are left as the quotas say, and one task walks them.  A null text blocks nothing and is not accepted.
    """
    first = rows.where(F.col(text).isNotNull()).groupBy(cell, text).agg(F.min(order).alias(order), F.max(quota).alias(quota))
    quotas = rows.groupBy(cell).agg(F.max(quota).alias("q"))
    so_far = quotas.alias("a").join(quotas.alias("b"), F.col(f"b.{cell}") <= F.col(f"a.{cell}")).groupBy(F.col(f"a.{cell}").alias(cell)).agg(F.sum("b.q").alias("most"))  # cells, not rows
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy(cell).orderBy(order, text))).join(so_far, cell).where("n <= most").select(cell, quota, text, order)
    schema = T.StructType([ranked.schema[cell], ranked.schema[order], ranked.schema[text], T.StructField("place", T.IntegerType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = sorted((r for b in batches for r in b.itertuples(index=False, name=None)), key=lambda r: (r[0], r[3], r[2]))
        accepted, taken, out = set(), {}, []
        for c, most, t, o in given:
            if taken.get(c, 0) < most and t not in accepted:
                accepted.add(t)
                taken[c] = taken.get(c, 0) + 1
                out.append((c, o, t, taken[c]))
        yield pd.DataFrame(out, columns=[cell, order, text, "place"])

    return ranked.coalesce(1).mapInPandas(walk, schema)


def allocate(sizes: dict, n: int, floor: int) -> dict:
    """``n`` places (at most as many as there are rows) over cells, in proportion to size.

    A cell whose proportional share is below its floor (``floor``, or all it has) gets the floor, and the others share what is left, until no share is
    below; then the largest remainder rounds, ties by cell.  Empty cells get no row; floors that need more than ``n`` together are an error.  Runs on
    the driver over a table of cells, never over rows."""
    least = {c: min(floor, s) for c, s in sizes.items() if s > 0}
    total = min(n, sum(sizes[c] for c in least))
    if sum(least.values()) > total:
        raise ValueError(f"{n} places are too few for the floors of {len(least)} cells")
    at_floor: set = set()
    while True:
        rest = [c for c in least if c not in at_floor]
        left, whole = total - sum(least[c] for c in at_floor), sum(sizes[c] for c in rest)
        below = {c for c in rest if left * sizes[c] < least[c] * whole}
        if not below:
            break
        at_floor |= below
    got = {c: least[c] if c in at_floor else left * sizes[c] // whole for c in least}
    remainders = sorted(rest, key=lambda c: (-(left * sizes[c] % whole), c))
    for c in remainders[: total - sum(got.values())]:
        got[c] += 1
    return got
