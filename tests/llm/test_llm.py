"""The operators for training text against brute force, round trips and their edge cases."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarazu.llm import canonical, leakage, lookalike, mixing, splitting, tokens
from tarazu.llm.lookalike import look

ZWNJ, ZWSP, SHY, NBSP = "‌", "​", "­", " "

SAME = [
    ("Реlçеdаmі", "Pelçedami"),
    ("CΕ-7197", "CE-7197"),
    ("ﭘﺎرﭼە ﻫتلی", "پارچه هتلی"),
    ("ＭＰＭ３９７７", "MPM3977"),
    ("BP۹۶۷۹", "BP٩٦٧٩"),
    ("آب", "آب"),
    ("پا" + ZWNJ + "ک", "پا  ك"),
    ("مسئول", "مسیٔول"),
    ("مسئول", "مسئول"),
    ("ﻻ", "لا"),
    ("Жapa", "Жара"),
    ("е́", "é"),
    (" x" + SHY + ZWSP + "y‏", "xy"),
    ("a‑b　c", "a-b" + NBSP + "c"),
    ("СОМ", "COM"),
    ("مشکى", "مشکي"),
    ("αιργ", "aipy"),
    ("ıɑɡ", "iag"),
    ("ꓮⲞ", "AO"),
    ("ס", "o"),
    ("Ь", "b"),
    ("ø", "o\u0338"),
    ("ԛԝ", "qw"),
]
DIFFERENT = [("hx", "HX"), ("آب", "اب"), ("O", "0"), ("l", "1"), ("کـتاب", "کتاب"), ("مَن", "من"), ("ab", "a b"), ("أ", "ا"), ("З", "3"), ("О", "0"), ("І", "l"), ("ا", "l"), ("ه", "o"), ("m", "rn"), ("æ", "ae"), ("т", "T"), ("в", "B")]


@pytest.mark.parametrize("a,b", SAME)
def test_texts_that_look_the_same_have_one_form(a, b):
    assert look(a) == look(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_texts_that_look_different_do_not(a, b):
    assert look(a) != look(b)


def test_letters_alike_follow_from_the_public_table():
    signs, composed = lookalike.letters_alike()
    assert len(signs) > 700 and not any(c.isascii() for c in [*signs, *composed])
    assert all(signs.get(s, s) == s for s in signs.values())  # a sign is written as itself
    assert all(unicodedata.category(c)[0] == "L" for c in signs) and not any(unicodedata.bidirectional(c) == "AL" for c in signs)


def test_the_form_is_stable_and_says_what_it_found():
    for pair in SAME + DIFFERENT:
        for t in pair:
            assert look(look(t)) == look(t)
    assert look("Реlçе") == unicodedata.normalize("NFC", "Pelçe")
    assert lookalike.resolve("Реl") == ("mixed", "Latin")
    assert lookalike.resolve("СОМ") == ("whole", "Latin")
    assert lookalike.resolve("Жа") == ("single", "Cyrillic")
    assert lookalike.resolve("12-") == ("common", "")
    assert look("") == "" and look(ZWSP + " ") == "" and look(None) is None


def test_forms_of_a_column(spark):
    long = "Р" * 300_000
    df = spark.createDataFrame([(None,), ("",), ("Реl",), (long,), (long,)], "t string")
    got = [r[0] for r in df.select(lookalike.look_same_form(F.col("t"))).collect()]
    assert got == [None, "", "Pel", "P" * 300_000, "P" * 300_000]
    kinds = [tuple(r.f) for r in df.select(lookalike.script_findings(F.col("t")).alias("f")).collect()]
    assert kinds[:3] == [(0, 0, 0), (0, 0, 0), (1, 1, 0)] and kinds[3] == (1, 0, 1)
    assert df.limit(0).select(lookalike.look_same_form(F.col("t"))).count() == 0


TITLES = [("1", "سینک معدنی متوسط"), ("1", "سينك" + ZWNJ + "معدنی متوسط"), ("2", "یخچال فروشگاهی بزرگ"), ("3", "گلدان دیجیتال معطر"), ("4", "پمپ پزشکی باریک"), (None, "کولر چوبی کوتاه"), ("5", None)]
NAMES = [("یخچال", "سردکن"), ("سینک", "لگن ظرفشویی"), ("نیست", "هیچ")]
SCORES: dict[str, float] = {}
VALUES = {
    "سینک معدنی": "1",
    "متوصت سینک": "1",
    "خرید معدنی سینگ کد 4": "1",
    "لگن ظرفشویی متوسط": "1",
    "سردکن بزرگ شرکت گروه تیر": "2",
    "یخچال فروشگ.": "2",
    "گلداندیجیتال": "3",
    "فروش سینک": "unmatched",
    "سینک بزرگ": "unmatched",
    "کولر چوبی کوتاه": "unmatched",
    "ملزومات": "unmatched",
    " ": "unmatched",
    "ﺳﯿﻨﮏ/ﻣﻌﺪﻧﯽ": "1",
}


@pytest.mark.parametrize("block,most_words", [(50_000, 200_000), (2, 200_000), (2, 5)])
def test_values_get_the_entry_they_mean(spark, block, most_words):
    values = spark.createDataFrame([(v, 1) for v in VALUES] * 2 + [(None, 1), ("", 1)], "v string, entry int")
    titles = spark.createDataFrame(TITLES, "id string, t string")
    names = spark.createDataFrame([*NAMES, (None, "x"), ("y", None)], "word string, name string")
    got = canonical.map_values(values, "v", titles, "id", "t", names, "word", "name", unmatched="unmatched", block=block, most_words=most_words).collect()
    assert {r.value: r.entry for r in got} == VALUES and len(got) == len(VALUES)
    # Scores are those of the whole list, however it is worked off.
    scores = {r.value: r.score for r in got}
    assert scores == SCORES or not SCORES
    SCORES.update(scores)
    none = canonical.map_values(values, "v", titles.limit(0), "id", "t", names, "word", "name").collect()
    assert len(none) == len(VALUES) and {r.entry for r in none} == {None}
    assert canonical.map_values(values.limit(0), "v", titles, "id", "t", names, "word", "name").count() == 0


@pytest.mark.parametrize(
    "value,entry",
    [("شاژررخاگنی بلند", "1"), ("دیگهوشمند", "2"), ("پمپشفاف", "3"), ("ترکاتورهوشمند", "4"), ("تعداد 12 شاپوزمستانه بسته 6 تایی", "5"), ("پمپخانگیشفاف", "3"), ("پمپشفافیت نو", None), ("قلمدیگ", None), ("پمپ" * 100, None)],
)
def test_words_typed_together_may_be_short_or_hold_a_slip(value, entry):
    titles = [("1", "شارژر خانگی بلند"), ("2", "قابلمه هوشمند تكفاز"), ("3", "پمپ خانگی شفاف"), ("4", "تراکتور هوشمند کوچک"), ("5", "شامپو زمستانه براق"), ("6", "خودکار چوبی کوتاه")]
    names = [("قابلمه", "دیگ"), ("خودکار", "قلم")]
    index = canonical.Titles([(i, tuple(canonical.words_of(t))) for i, t in titles])
    surfaces = sorted({(w, w, 1) for ws in index.words for w in ws} | {("".join(canonical.words_of(n)), "".join(canonical.words_of(w)), len(canonical.words_of(n))) for w, n in names})
    words = word_index(surfaces)
    found = index.match(canonical.Reader(words.lookup, words.longest).candidates(value))
    assert (index.ids[found[0][1]] if found else None) == entry


def word_index(surfaces):
    frequency = {}
    for s in {s for s, _, _ in surfaces}:
        for p in {canonical.place(g) for g, _ in canonical.grams(s)}:
            frequency[p] = frequency.get(p, 0) + 1
    return canonical.Words(surfaces, frequency, len({s for s, _, _ in surfaces}))


def test_words_are_assigned_to_disjoint_spans():
    rng = random.Random(9)

    def naive(spans):
        best = (0, 0.0)
        names = sorted(spans)

        def go(k, taken, score):
            nonlocal best
            if k == len(names):
                best = max(best, (len(taken), round(score, 9)))
                return
            go(k + 1, taken, score)
            for a, b, s in spans[names[k]]:
                if all(b <= x or a >= y for x, y in taken):
                    go(k + 1, [*taken, (a, b)], score + s * (b - a))

        go(0, [], 0.0)
        return best

    for _ in range(300):
        spans = {}
        for w in "abcd"[: rng.randrange(1, 5)]:
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(12)
                spans.setdefault(w, []).append((a, a + rng.randrange(1, 5), rng.randrange(1, 9) / 8))
        assert canonical.assign(spans) == naive(spans)


def test_lookup_equals_a_scan_of_the_list():
    rng = random.Random(3)
    letters = "ابپتجد"
    entries = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    index = word_index(sorted({(w, w, 1) for w in entries}))
    for _ in range(300):
        span = list(rng.choice(entries))
        span[rng.randrange(len(span))] = rng.choice(letters)
        span = "".join(span)
        v = index.vector(span)
        cos = {w: sum(x * index.vector(w).get(g, 0) for g, x in v.items()) for w in set(entries)}
        want = {span} if span in cos else {w for w, s in cos.items() if s >= canonical.THRESHOLD and canonical.edits(span, w, canonical.slips(w)) <= canonical.slips(w)}
        assert {w for w, *_ in index.lookup(span)} == want


def naive_leaks(docs, items, size):
    out = set()
    for i, t in items:
        own = leakage.words(t)
        n = min(size, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for d, text in docs:
            w = leakage.words(text)
            if grams & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
                out.add((d, i))
    return out


@pytest.mark.parametrize("block_words,shard_tokens", [(500_000, 1 << 20), (6, 40)])
def test_leaks_equal_brute_force(spark, block_words, shard_tokens):
    rng = random.Random(4)
    vocabulary = ["alpha", "Бета", "گاما", "delta", "e2", "zeta"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    items = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))) for i in range(12)]
    docs += [(99, "say: " + items[3][1].upper().replace(" ", "-‌")), (99, "twice"), (98, None), (97, ""), (96, "ALPHA. " * 3000)]
    items += [(200, None), (201, "..."), (202, items[3][1]), (203, "alphа аlpha")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    t = spark.createDataFrame(items, "item_id long, q string")
    got = leakage.find_leaks(d, "doc_id", "text", t, "item_id", "q", size=4, block_words=block_words, shard_tokens=shard_tokens)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(naive_leaks([x for x in docs if x[1]], [x for x in items if x[1]], 4))


def test_a_stored_index_serves_other_test_sets_without_the_documents(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "four five"), (3, "five one two")], "doc_id long, text string").repartition(2)
    index = leakage.stage_table(leakage.build_index(docs, "doc_id", "text", shard_tokens=5), "index")
    held = sum(sum(r.counts) for r in index.collect())
    assert held == 9  # every word of every document, whatever is searched
    for items, want in (([(1, "one two")], {(1, 1), (3, 1)}), ([(8, "four five"), (9, "three four five")], {(2, 8)}), ([(7, "nothing")], set())):
        got = leakage.search_index(index, spark.createDataFrame(items, "i long, t string"), "i", "t", size=3)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        assert "Scan parquet" in got._jdf.queryExecution().toString() and "Scan ExistingRDD" not in got._jdf.queryExecution().toString().split("Physical")[-1]


def test_proximity_equals_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))) for i in range(20)]

    def within(w, d, limit):
        for at in range(len(d)):
            k = 0
            for x in d[at : at + limit]:
                k += k < len(w) and x == w[k]
            if d[at] == w[0] and k == len(w):
                return True
        return False

    want = set()
    for i, t in items:
        own = t.split()
        n = min(4, len(own))
        for d, text in docs:
            if any(within(own[k : k + n], text.split(), n + 2) for k in range(len(own) - n + 1)):
                want.add((d, i))
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "i long, t string"), "i", "t", size=4, slop=2, shard_tokens=60)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_leaks_near_and_none(spark):
    d = spark.createDataFrame([(1, "one two big three four"), (2, "one two three four"), (3, "four three two one"), (4, "one two a b c three four")], "doc_id long, text string")
    t = spark.createDataFrame([(7, "one two three four")], "item_id long, q string")
    got = leakage.find_leaks(d, "doc_id", "text", t, "item_id", "q", slop=2).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(1, "proximity"), (2, "phrase")}
    assert leakage.find_leaks(d.limit(0), "doc_id", "text", t, "item_id", "q").count() == 0
    assert leakage.find_leaks(d, "doc_id", "text", t.limit(0), "item_id", "q").count() == 0


def test_replication_has_the_mean_and_the_cap():
    for rate in (0.02, 0.4, 1.0, 2.7, 3.99):
        for cap in (1, 2, 4, 60):
            mean = mixing.poisson_mean(rate, cap)
            assert mean == float("inf") if rate >= cap else abs(mixing.cut_mean(mean, cap) - rate) < 1e-6


def test_copies_invert_the_distribution(spark):
    import math

    n = 4000
    for mean, cap in ((0.3, 2), (1.7, 5), (900.0, 1200), (0.0, 3), (float("inf"), 3), (2.5, 2_000_000_000)):
        got = [r[0] for r in spark.range(n).select(mixing.copies((F.col("id") + 0.5) / n, F.lit(mean), F.lit(cap))).collect()]
        assert got == sorted(got) and max(got) <= cap
        if mean in (0.3, 1.7):
            for k in range(cap):
                below = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1))
                assert abs(sum(x <= k for x in got) / n - below) <= 1 / n
        assert abs(sum(got) / n - mixing.cut_mean(mean, cap)) < 1 if 0 < mean < 1e6 else set(got) == {0 if mean == 0 else cap}


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(11)
    rows = [(i, s, " ".join(rng.choice(["word", "قلم", "x1"]) for _ in range(rng.randrange(1, 30)))) for i, s in enumerate(["big"] * 1500 + ["mid"] * 400 + ["small"] * 60)]
    rows += [(9000, None, "lost"), (9001, "other", "lost"), (9002, "big", ""), (9003, "mid", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, "doc_id", "source", "text", targets, mixing.REACHABLE)
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["none"].actual_share == 0 and shares[None].mixture_docs == 0 and shares["other"].target_share is None
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(shares[s].actual_share - share / 0.95) < 0.01
    got = m.rows.collect()
    assert len(got) == sum(r.mixture_docs for r in shares.values())
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r.copy_n)
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= {"big": 1, "mid": 2, "small": 3}[s] for (s, _), c in uses.items())
    again = mixing.mix(docs.repartition(3), "doc_id", "source", "text", targets, mixing.REACHABLE)
    assert sorted((r.doc_id, r.copy_n) for r in again.rows.collect()) == sorted((r.doc_id, r.copy_n) for r in got)
    text = {r[0]: r[2] for r in rows}
    assert all(r.text == text[r.doc_id] for r in got)
    # As large as the corpus: small gives all its three copies, what it lacks the others have by their shares.
    m = mixing.mix(docs, "doc_id", "source", "text", targets)
    all_in = {r.source: r for r in m.shares.collect()}
    have = {s: all_in[s].source_tokens for s in ("big", "mid", "small")}
    assert m.total == sum(have.values()) and all_in["small"].mixture_tokens == 3 * have["small"] and all_in["small"].missing_tokens > 0
    assert abs(sum(r.mixture_tokens for r in all_in.values()) - m.total) < 60
    assert abs(all_in["big"].mixture_tokens / all_in["mid"].mixture_tokens - 5 / 3) < 0.02 or all_in["mid"].mixture_tokens == 2 * have["mid"]
    assert {(r.over_cap, r.changed, r.near_goal) for r in mixing.mixture_checks(m, docs, "doc_id", "text").collect()} == {(0, 0, True)}


def test_many_sources_with_large_caps_are_tuned(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("source"), F.lit("a few words here").alias("text"))
    targets = spark.range(300).select(F.col("id").cast("string").alias("source"), F.lit(1 / 300).alias("target_share"), F.lit(400).alias("max_repeats"))
    shares = mixing.mix(docs, "doc_id", "source", "text", targets, total=300 * 4000.0).shares.collect()
    assert all(abs(r.mixture_tokens - 4000) <= r.largest_doc for r in shares)


def test_mixture_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a", "x y z")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs.limit(0), "doc_id", "source", "text", targets).rows.count() == 0
    assert mixing.mix(docs, "doc_id", "source", "text", targets.limit(0)).rows.count() == 0
    assert [r.copy_n for r in mixing.mix(docs, "doc_id", "source", "text", targets, total=1e9).rows.collect()] == [1]
    with pytest.raises(ValueError):
        mixing.mix(docs, "doc_id", "source", "text", targets.union(targets))


FILES = [tokens.DEFAULT_FILE, "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"]
TEXTS = [
    "",
    "short",
    "# One\n\nFirst paragraph. It has two sentences!\n\nSecond one\nwith a line.\n## Two\n" + "long words here " * 60,
    "گزارش کارشناس؛ شناسه پیدا نشد. " * 50 + "\n\n" + "سطر\n" * 40,
    "x" * 4000,
    "آ" * 700 + " " * 300 + "😀" * 100,
    "\n" * 500,
    "a b" * 900 + "\r\n\r\n" + "c" * 50,
]


@pytest.mark.parametrize("path", FILES)
@pytest.mark.parametrize("limit,overlap", [(32, 8), (50, 0), (128, 40)])
def test_pieces_round_trip(path, limit, overlap):
    tok = tokens.tokenizer(path)
    for text in TEXTS:
        pieces = splitting.split_text(text, limit, overlap, path)
        rebuilt, last = "", None
        for a, b, n, o, on in pieces:
            assert n == tok.count(text[a:b]) and n <= limit and b > a
            assert a + o == (last if last is not None else 0)
            if last is not None:
                assert on == tok.count(text[a:last]) <= overlap
            rebuilt += text[a + o : b]
            last = b
        assert rebuilt == text
        if text and tok.count(text) <= limit:
            assert len(pieces) == 1


def test_pieces_are_cut_at_the_strongest_boundary():
    text = "# A\n" + "one two three. " * 6 + "\n\n" + "four five six. " * 6 + "\n# B\n" + "seven eight. " * 10
    pieces = [text[a:b] for a, b, *_ in splitting.split_text(text, 48, 0)]
    assert any(p.startswith("\n# B") for p in pieces)
    assert all(p.rstrip().endswith((".", "\n")) or p.rstrip().endswith(".") for p in pieces)
    with pytest.raises(ValueError):
        splitting.split_text(text, 8, 8)


def test_a_boundary_is_not_given_up_for_the_overlap():
    paragraph = ("alpha beta gamma delta. " * 95).strip()
    pieces = splitting.split_text(paragraph + "\n\n" + paragraph, 512, 64)
    assert len(pieces) == 2 and pieces[0][1] == len(paragraph) + 2 and 0 < pieces[1][4] <= 64
    # Whole small parts go together, a part over the limit does not take the next section with it.
    text = "# A\n" + "one two three. " * 8 + "\n# B\n" + "four five six. " * 30 + "\n# C\n" + "seven. " * 4
    starts = [text[a + o :][:4] for a, _, _, o, _ in splitting.split_text(text, 64, 8)]
    assert starts[0] == "# A\n" and "\n# B" in starts and "\n# C" in starts
    # Lines that begin with blanks are boundaries too.
    text = "\n".join("    " + "word " * 9 for _ in range(40))
    assert all(text[a + o] == " " and (a + o == 0 or text[a + o - 1] == "\n") for a, _, _, o, _ in splitting.split_text(text, 64, 0))


def test_pieces_are_checked_by_a_plain_count(spark):
    bad = spark.createDataFrame([(1, 1, 0, 8, 0, 9, "one two "), (1, 2, 8, 13, 0, 3, "three")], "doc_id long, piece_n int, start int, end int, overlap_chars int, n_tokens int, text string")
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    got = splitting.piece_checks(docs, "doc_id", "text", bad, limit=8).collect()
    assert [(r.over_limit, r.wrong_sizes, r.cut_paragraphs) for r in got] == [(0, 2, 1)]


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, "a b c " * 400, 0), (2, None, 0), (3, "", 0), (4, "x", 0), (4, "x", 0)], "doc_id long, text string, start int")
    got = splitting.split_documents(df, "doc_id", "text", 64, 8).collect()
    assert {r.doc_id for r in got} == {1, 4} and sum(r.doc_id == 4 for r in got) == 2
    assert all(r.n_tokens <= 64 for r in got)
    assert splitting.split_documents(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#؟۱é\u200c😀", max_size=300), st.integers(2, 20))
def test_any_text_round_trips(text, limit):
    pieces = splitting.split_text(text, limit, limit // 3)
    assert "".join(text[a + o : b] for a, b, _, o, _ in pieces) == text
    tok = tokens.tokenizer()
    assert all(n == tok.count(text[a:b]) and (n <= limit or b - a == 1) for a, b, n, *_ in pieces)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aАΑ٣3۳ يیى\u200c\u0301\u0654eеﯼﻱو-‑", max_size=12))
def test_any_form_is_stable(text):
    assert look(look(text)) == look(text)
    assert look(unicodedata.normalize("NFD", text)) == look(text) == look(" " + text + "\u200b")


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    want = len(tokens.tokenizer().encoding.encode_ordinary("hello world"))
    assert [r[0] for r in df.select(tokens.count_tokens(F.col("t"))).collect()] == [want, 0, 0]
    for path in FILES:
        tok = tokens.tokenizer(path)
        for t in TEXTS[1:]:
            places, before = tok.steps(t)
            assert places[0] == 0 and places[-1] == len(t) and abs(before[-1] - tok.count(t)) <= 2
