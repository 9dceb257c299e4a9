"""Catalog rules, lookups, retrieval, metrics, workloads and vectors on small hand-made tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarazu.functions import text as tx
from tarazu.operators import catalog as cat
from tarazu.operators import evaluation as ev
from tarazu.operators import retrieval as bm
from tarazu.operators import vectors as vec
from tarazu.operators import workload as wl
from tarazu.operators.rates import parse_line, rate_at
from tarazu.plans import ranking
from tarazu.sources.tables import CATALOG_COLUMNS

GOODS, GENERAL = "شناسه اختصاصی تولید داخل", "شناسه عمومی وارداتی"


def row(n, id_, run, end=None, title="عنوان", vat="9", tax="مشمول", type_=GOODS):
    return (n, id_, title, vat, tax, run, end, None, None, type_, None)


CATALOG = "row_n long, " + ", ".join(f"{c} string" for c in CATALOG_COLUMNS)
A, Q, LONG = "2900000000001", "2900000000009", "29000000000012"


def catalog(spark):
    rows = [
        row(1, A, "1403-01-01", "1403-12-29"),
        row(2, A, "1404-01-01", ""),
        row(3, A, "1404-01-01", ""),  # a copy
        row(4, Q, "1403-01-01"),
        row(5, Q, "1403-01-01", vat="10"),  # conflicts with 4
        row(6, "2900000000002", "1403-05-01", "1403-04-01"),  # ends before it starts
        row(7, LONG, "1403-01-01"),
        row(8, None, "1403-01-01"),
        row(9, "2900000000003", "1405-01-01"),
    ]
    return spark.createDataFrame(rows, CATALOG)


def test_quality_rules(spark):
    c = cat.classify(catalog(spark))
    got = {r.row_n: (r.is_extra_copy, r.reasons) for r in c.collect()}
    assert got[3] == (True, None) and got[1] == got[2] == got[9] == (False, [])
    assert got[4] == got[5] == (False, ["R2"]) and got[6] == (False, ["R3"]) and got[7] == got[8] == (False, ["R4"])
    assert [r.row_n for r in cat.extra_copies(catalog(spark)).collect()] == [3]
    n = cat.snapshot_counts(c, "1403-07-01").first().asDict()
    assert n == {"raw_rows": 9, "rows_after_r1": 8, "r1_extra_copies": 1, "r2_keys": 1, "r2_rows": 2, "r3_rows": 1, "r4_rows": 2, "rows_with_several_reasons": 0, "raw_ids": 6, "active_ids": 2, "quarantined_only_ids": 4, "index_rows": 1, "index_ids": 1}
    assert {r.sstid for r in cat.quarantined_only(c).collect()} == {Q, "2900000000002", LONG}
    assert cat.snapshot_counts(c.limit(0), "1403-07-01").first().raw_rows == 0


def test_lookup_of_ids_and_gaps(spark):
    ids = spark.createDataFrame([(A,), (A,), ("x",), (None,)], "sstid string")
    got = {r.sstid: (r.n_rows, r.any_in_force) for r in cat.lookup_ids(catalog(spark), ids, "1403-12-29").collect()}
    assert got == {A: (3, True), "x": (0, None)}
    assert {r.kind: r.n_pairs for r in cat.version_gaps(catalog(spark)).collect()} == {"gap": 1}  # 1403-12-30 is a day


def test_rate_at_gives_a_status(spark):
    c = cat.classify(catalog(spark))
    lines = [("1", A, "1403-06-01"), ("2", A, "1403-12-30"), ("3", A, "1404-05-01"), ("4", Q, "1403-06-01"), ("5", "x", "1403-06-01"), ("6", A, "1403-13-01"), ("7", None, "1403-06-01"), ("1", A, "1403-06-01")]
    df = spark.createDataFrame(lines, "line_id string, sstid string, issue_date string")
    got = {r.line_id: (r.status, r.valid_from) for r in rate_at(df, cat.versions(cat.active(c)), cat.id_status(c)).collect()}
    assert got == {"1": ("OK", "1403-01-01"), "2": ("NOT_IN_FORCE", None), "3": ("OK", "1404-01-01"), "4": ("QUARANTINED_ONLY", None), "5": ("NOT_IN_CATALOG", None), "6": ("INVALID_DATE", None), "7": ("NOT_IN_CATALOG", None)}
    all_rows = cat.versions(c.where(~F.col("is_extra_copy")))
    r = rate_at(df.where("line_id = '4'"), all_rows, None).first()
    assert (r.status, r.rate, r.n_candidates) == ("AMBIGUOUS", None, 2) and sorted(float(x.rate) for x in r.candidates) == [9.0, 10.0]
    assert rate_at(df.limit(0), all_rows, None).count() == 0


def test_line_numbers(spark):
    rows = [("1403-01-01", " 29 ", "1.5", "100", "9", "13.5"), ("1403-01-01", "29", "-1", "100", "9", "1"), ("1403-01-01", "29", "1.1234567", "1", "9", "1"), ("x", "29", "1", "1", "9", "1"), ("1403-01-01", None, "1", "1", "9", "1"), ("1403-01-01", "29", "NaN", "1", "9", None)]
    df = spark.createDataFrame(rows, "issue_date string, sstid string, am string, fee string, vra string, vam string")
    got = [r[0] for r in df.select(parse_line()).collect()]
    assert [g.error for g in got] == [None, "am", "am", "issue_date", "sstid", "am"]
    assert float(got[0].base) == 150.0 and got[0].sstid == "29"


def test_text_functions(spark):
    cases = {" كتاب‌هاي  آبي": "کتاب های ابی", "ABC۱۲٣": "abc123", "مُـد": "مد", "a b": "a b", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(tx.normalize(F.col("t"))).collect()] == list(cases.values())
    twice = df.select(tx.normalize(F.col("t")).alias("n")).select("n", tx.normalize(F.col("n")).alias("m")).collect()
    assert all(r.n == r.m for r in twice)
    one = spark.createDataFrame([("سیب، قرمز/سبز (x-y)", 1234567.5, "a*b [c]")], "t string, n double, m string")
    r = one.select(tx.title_tokens(F.col("t")), tx.format_number(F.col("n")), tx.md_escape(F.col("m")), tx.search_key(F.lit("كو ل‌ر"))).first()
    assert list(r[0]) == ["سیب", "قرمز", "سبز", "x-y"] and r[1] == "1,234,567.5" and r[2] == "a\\*b \\[c\\]" and r[3] == "کولر"


def naive_bm25(docs, query, k1=1.5, b=0.75):
    n, avgdl = len(docs), sum(len(t) for _, _, t in docs) / len(docs)
    out = {}
    for d, _, tokens in docs:
        s = 0.0
        for q in dict.fromkeys(query):
            df = sum(q in t for _, _, t in docs)
            tf = tokens.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(tokens) / avgdl))
        if s > 0:
            out[d] = round(s, bm.DIGITS)
    return out


@pytest.mark.parametrize("tie", ["row", "id"])
@pytest.mark.parametrize("query_block", [3, 5_000])
def test_ranking_equals_a_full_scan(spark, tie, query_block):
    rng = random.Random(12)
    words = list("abcdefg")
    docs = [(i, f"id{rng.randrange(40):02d}", [rng.choice(words) for _ in range(rng.randrange(0, 5))]) for i in range(150)]
    queries = [(str(q), [rng.choice([*words, "z"]) for _ in range(rng.randrange(0, 4))], f"id{rng.randrange(45):02d}") for q in range(10)]
    d = spark.createDataFrame(docs, "doc long, sstid string, tokens array<string>").repartition(3)
    q = spark.createDataFrame(queries, "query string, tokens array<string>, declared string")
    got = bm.rank(d, q, 5, tie=tie, declared=True, counted=True, query_block=query_block)
    rows = got.collect()
    id_of = {i: s for i, s, _ in docs}
    for name, tokens, declared in queries:
        scores = naive_bm25(docs, tokens)
        best = {}
        for doc, s in scores.items():
            i = id_of[doc]
            if i not in best or (s, -doc) > (best[i][0], -best[i][1]):
                best[i] = (s, doc)
        want = sorted(best.items(), key=lambda x: (-x[1][0], x[0] if tie == "id" else x[1][1]))[:5]
        mine = sorted((r.rank, r.sstid, r.score) for r in rows if r.query == name and r.kind == "top")
        assert [(i, s) for _, i, s in mine] == [(i, s) for i, (s, _) in want], name
        own = [r.score for r in rows if r.query == name and r.kind == "own"]
        assert own == ([best[declared][0]] if declared in best else [])
        assert [r.doc for r in rows if r.query == name and r.kind == "count"] == ([len(scores)] if scores else [])
    f = {r.query: r for r in bm.features(got, q, 5).collect()}
    assert len(f) == len(queries) and all(0 <= r.sim_declared <= 1 for r in f.values())


def test_ranking_of_nothing(spark):
    d = spark.createDataFrame([(1, "a", ["x"])], "doc long, sstid string, tokens array<string>")
    q = spark.createDataFrame([("1", ["x"])], "query string, tokens array<string>")
    assert bm.rank(d.limit(0), q, 5).count() == 0 and bm.rank(d, q.limit(0), 5).count() == 0
    assert bm.rank(d, q, 5).first().sstid == "a"


def test_dated_ranking(spark):
    docs = [(1, "a", ["x"], "1403-01-01", "1403-06-01"), (2, "a", ["x"], "1403-06-01", None), (3, "b", ["x"], "1404-01-01", None)]
    d = spark.createDataFrame(docs, "doc long, sstid string, tokens array<string>, valid_from string, valid_to string")
    q = spark.createDataFrame([("1", ["x"], "1403-05-31"), ("2", ["x"], "1404-01-01"), ("3", ["x"], "1402-01-01")], "query string, tokens array<string>, day string")
    got = sorted((r.query, r.rank, r.doc) for r in bm.rank(d, q, 5, dated=True).collect())
    assert got == [("1", 1, 1), ("2", 1, 2), ("2", 2, 3)]


def test_ranking_in_segments_and_parts(spark, monkeypatch):
    monkeypatch.setattr(bm, "SEGMENT", 400)
    monkeypatch.setattr(bm, "QUERY_PART", 3)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    spread = [1 / (i + 1) for i in range(60)]
    docs = [(i, f"id{rng.randrange(300):03d}", rng.choices(words, spread, k=rng.randrange(1, 9)), f"1403-0{rng.randrange(1, 5)}-01", rng.choice([None, "1403-06-01", "1403-03-01"])) for i in range(1500)]
    queries = [(str(q), rng.choices([*words, "z"], [*spread, 0.1], k=rng.randrange(0, 7)), f"1403-0{rng.randrange(1, 8)}-15", f"id{rng.randrange(320):03d}") for q in range(40)]
    d = spark.createDataFrame(docs, "doc long, sstid string, tokens array<string>, valid_from string, valid_to string").repartition(4)
    q = spark.createDataFrame(queries, "query string, tokens array<string>, day string, declared string")
    rows = bm.rank(d, q, 5, tie="id", dated=True, declared=True).collect()
    for name, tokens, day, declared in queries:
        scores = naive_bm25([r[:3] for r in docs], tokens)
        best = {}
        for doc, s in scores.items():
            if docs[doc][3] <= day < (docs[doc][4] or "9999"):
                best[docs[doc][1]] = max(s, best.get(docs[doc][1], 0))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(i, s) for _, i, s in sorted((r.rank, r.sstid, r.score) for r in rows if r.query == name and r.kind == "top")] == want
        own = max((s for doc, s in scores.items() if docs[doc][1] == declared), default=0)
        assert [r.score for r in rows if r.query == name and r.kind == "own"] == [own] * (own > 0)


def test_common_terms_are_not_added_to_all_their_documents(spark):
    rng = random.Random(3)
    docs = [(i, f"id{i:04d}", ["all", f"some{rng.randrange(8)}", f"few{rng.randrange(60)}"], "1403-01-01", "9999-99-99") for i in range(4000)]
    d = spark.createDataFrame(docs, "doc long, sstid string, tokens array<string>, valid_from string, valid_to string")
    names = ["all", *(f"some{i}" for i in range(8)), *(f"few{i}" for i in range(60))]
    df = np.array([sum(t in r[2] for r in docs) for t in names])
    seg = bm._Segment(bm.build_index(d).toArrow().to_batches(), pa.array(names, pa.large_string()), np.log(1 + (4000 - df + 0.5) / (df + 0.5)), 3.0, True)
    days = seg.date(pa.array(["1403-05-01"] * 60, pa.large_string()))

    class Read:
        def __init__(self, column):
            self.column, self.rows = column, 0

        def __getitem__(self, own):
            self.rows += own.stop - own.start
            return self.column[own]

    seg.start = read = Read(seg.start)
    ids = np.array([int(i[2:]) for i in seg.columns["sstid"].to_pylist()])
    at = seg.columns["doc"].to_numpy()
    asked = [(n, np.array([9 + n, 1 + n % 8, 0])) for n in range(60)]
    for n, found, score, _ in bm._search(seg, asked, 5, True, ids, at, days, False):
        want = sorted(((round(sum(math.log(1 + (4000 - df[t] + 0.5) / (df[t] + 0.5)) for t in asked[n][1] if names[t] in r[2]), bm.DIGITS), r[0]) for r in docs), key=lambda x: (-x[0], x[1]))[:5]
        assert [(int(at[f]), float(s)) for f, s in zip(found, score)] == [(doc, s) for s, doc in want]
    assert read.rows < 0.2 * sum(df[t].sum() for _, t in asked)


@pytest.fixture
def lines_folder(spark, tmp_path):
    titles = ["red paper", "red pipe", "blue paper", "red paper two", "green pipe", "red", "old red paper"]
    rows = [row(n, f"29000000000{n:02d}", "1402-01-01", title=t) for n, t in enumerate(titles)]
    spark.createDataFrame(rows, CATALOG).write.parquet(f"{tmp_path}/fake_catalog.parquet")
    spark.createDataFrame([row(99, "2700000000099", "1402-01-01", title="red tool", type_=GENERAL)], CATALOG).write.parquet(f"{tmp_path}/fake_catalog_general.parquet")
    lines = [("L0000000050", "1403-01-01", "2900000000000", "red paper", "vat"), ("L0000000051", "1403-01-01", "2900000000001", "red pipe", "vat"), ("L0000000100", "1403-01-01", "2900000000002", "paper", None), ("L0000000150", "1401-01-01", "2900000000002", "paper", "vat")]
    spark.createDataFrame(lines, "line_id string, issue_date string, sstid string, sstt string, labels string").write.parquet(f"{tmp_path}/demo_invoices.parquet")
    return str(tmp_path)


def test_features_read_the_lines_once(spark, lines_folder):
    f = ranking.bm25_features(spark, lines_folder)
    assert not any("demo_invoices" in x for x in f.inputFiles())  # read before, when the lines asked for were written
    assert [(r.line_id, r.rank_declared, r.n_ranked) for r in f.sort("line_id").collect()] == [("L0000000050", 1, 7), ("L0000000100", 2, 4), ("L0000000150", 21, 0)]


def test_alternatives_rank_no_more_than_they_show(spark, lines_folder, monkeypatch):
    top = ranking.bm25_topk(spark, lines_folder).where("rank <= 5").sort("line_id", "rank").collect()
    asked, rank = [], bm.rank
    monkeypatch.setattr(bm, "rank", lambda docs, queries, k, **more: asked.append(k) or rank(docs, queries, k, **more))
    got = {r.line_id: r.ids for r in ranking.alternatives(spark, lines_folder).collect()}
    assert got == {i: " ".join(r.sstid for r in top if r.line_id == i) for i in ("L0000000050", "L0000000100")} and asked == [5]


def test_labels_of_lines_that_have_features(spark, lines_folder):
    from tarazu.plans.measures import features_by_label

    f = features_by_label(spark, lines_folder)
    plan = f._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("% 50" in x and "line_id" in x for x in plan) == 1, plan  # other lines have no features: left out before they are made distinct
    assert {r.label: r.n for r in f.collect()} == {"vat": 2, "clean": 1}


def test_random_ids(spark):
    docs = spark.createDataFrame([(f"id{i:03d}",) for i in range(300)] * 2, "sstid string")
    q = spark.createDataFrame([(str(i),) for i in range(200)], "query string")
    got = [tuple(r) for r in bm.random_ids(docs.repartition(4), q, 5).collect()]
    assert sorted(got) == sorted(tuple(r) for r in bm.random_ids(docs.repartition(2), q, 5, query_block=60).collect())
    by = {}
    for name, _, i in got:
        by.setdefault(name, set()).add(i)
    assert len(got) == 1000 and all(len(v) == 5 for v in by.values())
    drawn = [sum(i in v for v in by.values()) for i in {r[0] for r in docs.collect()}]
    assert max(drawn) < 15 and sum(d > 0 for d in drawn) > 260  # 3.3 expected of each
    assert bm.random_ids(docs.limit(0), q, 5).count() == 0


def test_documents_to_cite(spark, tmp_path):
    import json

    from tarazu.operators import dated

    unit = {"id": "a", "kind": "k", "title": "t", "body": "b", "valid_from": "1403-01-01", "valid_to": None, "source_url": "x", "applies_to": ["T2"], "status": "reviewed"}
    bad = [{**unit, "id": "b", "valid_to": "1402-01-01"}, {**unit, "id": "c", "status": "new"}, {**unit, "id": "d", "source_url": ""}, {**unit, "id": "e", "applies_to": ["T9"]}, {**unit, "id": "f", "valid_from": "1403-13-01"}, {**unit, "id": "g"}, {**unit, "id": "g"}, {**unit, "id": ""}]
    (tmp_path / "u.json").write_text(json.dumps({"schema_version": 1, "units": [unit, *bad]}))
    u = dated.read_units(spark, str(tmp_path / "u.json"))
    got = sorted(set((r.id, r.fault) for r in dated.unit_faults(u, ["T2", "T6"]).collect()))
    assert got == [("", "no_id"), ("b", "ends_before_start"), ("c", "bad_status"), ("d", "no_source"), ("e", "unknown_code"), ("f", "bad_day"), ("g", "duplicate_id")]
    units = spark.createDataFrame([("p", "1403-01-01", None, ["T2"], "placeholder"), ("z", "1403-05-01", "1403-06-31", ["T2", "T6"], "reviewed"), ("y", "1403-06-01", None, ["T6"], "reviewed")], "id string, valid_from string, valid_to string, applies_to array<string>, status string")
    f = spark.createDataFrame([(1, "T2", "1403-04-31"), (2, "T2", "1403-06-31"), (3, "T6", "1403-06-31"), (4, "T6", "1403-04-01"), (5, None, "1403-04-01"), (6, "T2", None), (2, "T2", "1403-06-31")], "n int, code string, day string")
    assert sorted((r.n, r.unit_id, r.is_placeholder) for r in dated.cite(f, "code", "day", units).collect()) == [(1, "p", True), (2, "z", False), (2, "z", False), (3, "y", False), (4, None, None), (5, None, None), (6, None, None)]
    assert dated.cite(f.limit(0), "code", "day", units).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b"]), (["a"], ["c", "x"]), ([], ["a"]), (None, ["a"])], "r array<string>, w array<string>")
    ranks = df.select(ev.rank_of_any(F.col("r"), F.col("w")).alias("rank"))
    assert [r.rank for r in ranks.collect()] == [2, None, None, None]
    one = ranks.agg(ev.recall_at(F.col("rank"), 1).alias("a"), ev.recall_at(F.col("rank"), 5).alias("b"), ev.mrr(F.col("rank")).alias("c")).first()
    assert (one.a, one.b, one.c) == (0.0, 0.25, 0.125)
    empty = ranks.limit(0).agg(ev.recall_at(F.col("rank"), 1).alias("a"), ev.mrr(F.col("rank")).alias("c")).first()
    assert empty.a is None and empty.c is None
    chance = spark.range(1).select(ev.random_hit(F.lit(3), F.lit(10), 5).alias("x")).first().x
    assert abs(chance - (1 - (7 * 6 * 5 * 4 * 3) / (10 * 9 * 8 * 7 * 6))) < 1e-12


def test_golden_rows(spark):
    rows = [(" ", A, "S"), ("x", A, "T"), ("x", "1", "S"), ("x", f"{A}; {A}", "C"), ("x", f"{A};{Q}", "S"), ("x", f"{A};{Q}", "C"), ("x", "۲۹۰۰۰۰۰۰۰۰۰۰۱", "S"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, i string, tier string")
    got = [r[0] for r in df.select(ev.golden_reason(F.col("t"), F.col("i"), F.col("tier"))).collect()]
    assert got == ["empty_query", "bad_tier", "bad_id", "duplicate_id", "multi_id_tier_s", None, None, "empty_query"]


def test_confusion_and_percentile(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["b"], []), (None, ["a"])], "t array<string>, p array<string>")
    got = {r.code: tuple(r)[1:] for r in ev.confusion(df, "t", "p").collect()}
    assert got == {"a": (1, 1, 0, 0.5, 1.0), "b": (0, 1, 1, 0.0, 0.0)}
    rng = random.Random(13)
    values = [rng.randrange(30) for _ in range(101)]
    v = spark.createDataFrame([(x,) for x in values] + [(None,)], "x int")
    for q in (0.0, 0.33, 0.5, 0.95, 1.0):
        assert ev.nearest_rank(v, "x", q).first().x == sorted(values)[round(q * 100)]
    assert ev.nearest_rank(v.limit(0), "x", 0.5).count() == 0


def test_derivation(spark):
    rows = [("سیب، برند سرخ، Latin A، آبدار و شیرین و تازه و خوب، کشور ایران، چین، بسته بندی ۵ / شرکت باغ", GOODS), ("سیب، فاقد برند، Golden X، ریز", GOODS), ("خدمات / شرکت الف/ شستشو / سازمان امور مالیاتی", "شناسه اختصاصی خدمت"), ("سیب، ریز، درشت، Late Latin", GOODS), (None, GOODS), ("", GOODS)]
    df = spark.createDataFrame(rows, "t string, ty string").withColumn("d", wl.derive(F.col("t"), F.col("ty")))
    got = [tuple(r.d) for r in df.collect()]
    assert got[0] == ("سیب", "سرخ", ["Latin A", "آبدار و شیرین و تازه و خوب"])
    assert got[1] == ("سیب", "Golden X", ["ریز"])
    assert got[2] == ("خدمات", None, ["شستشو"])
    assert got[3] == ("سیب", None, ["ریز", "درشت", "Late Latin"])
    assert got[4][0] is None and got[5][0] is None
    assert df.select(wl.build_query(F.col("d"), 2).alias("q")).first().q == "سیب سرخ Latin A آبدار و شیرین و"


def test_subset_matches_equal_a_scan(spark):
    rng = random.Random(14)
    rows = [(i, f"id{rng.randrange(30)}", rng.sample("abcdefgh", rng.randrange(0, 5))) for i in range(80)]
    queries = [(i, rng.sample("abcdefghz", rng.randrange(0, 4))) for i in range(40)]
    r = spark.createDataFrame(rows, "n int, id string, tokens array<string>")
    q = spark.createDataFrame(queries, "q int, w array<string>")
    got = {x.q: x.n_ids for x in wl.subset_matches(r, "id", "tokens", q, "q", "w").collect()}
    assert got == {i: len({d for _, d, t in rows if w and set(w) <= set(t)}) for i, w in queries}


def test_assigned_terms(spark):
    heads = spark.createDataFrame([(1, list("abc")), (2, list("xab")), (3, ["c"]), (4, [])], "n int, h array<string>")
    terms = spark.createDataFrame([(1, ["a"]), (2, list("ab")), (3, ["b"]), (4, [])], "term_n int, term array<string>")
    for rule, want in (("prefix", {1: 2}), ("contains", {1: 2, 2: 2})):
        assert {r.n: r.term_n for r in wl.assign_terms(heads, "n", "h", terms, rule).collect()} == want
    with pytest.raises(ValueError):
        wl.assign_terms(heads, "n", "h", terms, "suffix")


def test_quotas_and_samples(spark):
    rng = random.Random(15)
    for _ in range(200):
        sizes = {c: rng.randrange(0, 40) for c in range(rng.randrange(1, 7))}
        n, floor = rng.randrange(0, 60), rng.randrange(0, 6)
        if sum(min(floor, s) for s in sizes.values()) > min(n, sum(sizes.values())):
            with pytest.raises(ValueError):
                wl.allocate(sizes, n, floor)
            continue
        got = wl.allocate(sizes, n, floor)
        assert all(min(floor, s) <= got.get(c, 0) <= s for c, s in sizes.items())
        assert sum(got.values()) == min(n, sum(sizes.values()))
    assert wl.allocate({"a": 90, "b": 10}, 20, 5) == {"a": 15, "b": 5}  # the floor binds only where the share is below it
    assert wl.allocate({"a": 50, "b": 30, "c": 20, "d": 0}, 10, 1) == {"a": 5, "b": 3, "c": 2}
    rows = spark.createDataFrame([("p", "h1", i) for i in range(5)] + [("p", "h2", i) for i in range(10, 12)], "p string, h string, n int")
    assert [r.n for r in wl.round_robin(rows, "p", "h", [F.col("n")], 5).orderBy("place").collect()] == [0, 10, 1, 11, 2]
    emit = spark.createDataFrame([("a", 2, "x", 1), ("a", 2, "y", 2), ("a", 2, "z", 3), ("b", 2, "x", 1), ("b", 2, "w", 2), ("b", 2, "w", 3)], "c string, q int, t string, n int")
    assert sorted((r.c, r.t) for r in wl.emit_until(emit, "c", "q", "t", "n").collect()) == [("a", "x"), ("a", "y"), ("b", "w")]
    # A text beyond its first cell's quota blocks no later cell.
    late = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "y", 3), ("c", 1, "y", 4), ("c", 1, None, 1)], "c string, q int, t string, n int")
    assert sorted((r.c, r.t, r.place) for r in wl.emit_until(late, "c", "q", "t", "n").collect()) == [("a", "x", 1), ("b", "y", 1)]
    assert wl.emit_until(late.limit(0), "c", "q", "t", "n").count() == 0


def test_match_lists_have_a_cap_and_leave_out(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["x", "z"]), ("c", ["x", "z"]), (None, ["x"]), ("d", None)], "id string, t array<string>")
    q = spark.createDataFrame([(1, ["x"]), (2, ["x", "z"]), (3, ["nothing"]), (4, [])], "q int, w array<string>")
    out = spark.createDataFrame([("a",), (None,)], "id string")
    got = {r.q: (r.ids, r.n_ids) for r in wl.match_ids(rows.where("id IS NOT NULL"), "id", "t", q, "q", "w", 2).collect()}
    assert got == {1: (["a", "b"], 2), 2: (["c"], 1), 3: ([], 0), 4: ([], 0)}
    got = {r.q: r.ids for r in wl.match_ids(rows.where("id IS NOT NULL"), "id", "t", q, "q", "w", 5, out).collect()}
    assert got[1] == ["b", "c"] and wl.match_ids(rows.limit(0), "id", "t", q, "q", "w", 2).count() == 4


def test_json_maps_and_reports(spark, tmp_path):
    from tarazu.sources.files import read_json_map, write_json

    (tmp_path / "m.json").write_text('{"1": {"n": 2, "tier": "S"},\n "2": {"n": null, "tier": "C"}}')
    got = read_json_map(spark, str(tmp_path / "m.json"), "struct<n:int,tier:string>").select("key", "value.*").collect()
    assert sorted(map(tuple, got)) == [("1", 2, "S"), ("2", None, "C")]
    write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert [p.read_text() for p in (tmp_path / "r").glob("*.json")] == ['{"a":1,"b":null}\n']
    (tmp_path / "bad.json").write_text("[1, 2]")
    with pytest.raises(Exception):
        read_json_map(spark, str(tmp_path / "bad.json")).collect()


def test_noise(spark):
    texts = ["کتاب خانه بزرگ", "یک", "", None, "alpha beta gamma", "1234 ab", "بببب x", "aaa1 x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", wl.noise(F.col("t"), "typo").alias("n"), wl.noise(F.col("t"), "typo").alias("again")).collect():
        assert r.n == r.again
        if r.t and any(sum(c.isalpha() for c in w) >= 4 for w in r.t.split(" ")):
            a, b = r.t.split(" "), r.n.split(" ")
            changed = [(x, y) for x, y in zip(a, b) if x != y]
            assert len(a) == len(b) and len(changed) == 1 and all(len(y) in (len(x), len(x) - 1) for x, y in changed)
        else:
            assert r.n == r.t
    got = {r.t: r.e for r in df.select("t", wl.eligible_noise(F.col("t")).alias("e")).collect()}
    assert got["1234 ab"] == ["persian_digits"] and got["یک"] == ["arabic_letters"] and got["alpha beta gamma"] == ["typo"] and got["کتاب خانه بزرگ"] == ["arabic_letters", "typo"] and not got[None]
    with pytest.raises(ValueError):
        wl.noise(F.col("t"), "none")


@pytest.mark.parametrize("block", [64, 8_000_000])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(16)
    m = rng.normal(size=(90, 8)).round(2)
    m[5], m[17] = m[40], 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None)], "id long, v array<double>").repartition(3)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    got = vec.nearest(df, "id", "v", df.where("id % 10 = 0"), 4, block_floats=block).collect()
    for q in range(0, 90, 10):
        s = np.round(unit @ unit[q], vec.DIGITS)
        want = sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:4]
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == want
    assert vec.nearest(df.limit(0), "id", "v", df, 4).count() == 0
    assert vec.nearest(df, "id", "v", df.limit(0), 4).count() == 0


def test_agreement_and_overlap(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    r = vec.agreement(df, "a", "b").first()
    assert (r.n, r.mean_cosine, r.min_cosine) == (2, 0.5, 0.0)
    a = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (2, 8)], "query long, id long")
    b = spark.createDataFrame([(1, 5), (1, 9), (3, 1)], "query long, id long")
    o = vec.overlap(a, b, "id", 2).first()
    assert (o.n_queries, o.overlap) == (2, 0.25)


def test_encoding_and_chunks(spark, tmp_path):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(7)], "i int, t string")
    out = {r.i: r.embedding for r in vec.encode(df, "t", make, batch=2).collect()}
    assert len(out) == 7 and abs(out[3][0] - 3 / math.sqrt(10)) < 1e-6 and out[0] == [0.0, 1.0]
    table = vec.ChunkedTable(spark, str(tmp_path / "v"), "key-1")
    chunk = F.pmod(F.col("i"), F.lit(3))

    def broken(part):
        if part.where("i = 1").count():
            raise RuntimeError("crash")
        return part

    with pytest.raises(RuntimeError):
        table.fill(df, chunk, 3, broken)
    assert table.done() == {0}
    again = vec.ChunkedTable(spark, str(tmp_path / "v"), "key-1")
    assert again.fill(df, chunk, 3, lambda p: p) == 2 and again.read().count() == 7
    with pytest.raises(ValueError):
        vec.ChunkedTable(spark, str(tmp_path / "v"), "key-2")


@pytest.mark.parametrize("loss", ["true", "false"])
def test_the_rounded_product_holds_all_usable_numbers(spark, tmp_path, loss):
    from tarazu.plans.workload import rounding_modes

    top, rng = "99999999999999.999999", random.Random(5)
    number = lambda w, d: str(rng.randrange(10 ** rng.randrange(1, w + 1))) + (f".{rng.randrange(10**n):0{n}d}" if (n := rng.randrange(d + 1)) else "")
    lines = [("2", "100", "9.000"), ("3", "150", "12.500"), ("1000000", "1", "10.000"), ("1.005", "1000", "10"), (top, top, "99999.9999"), ("0.000001", "0.000001", "0.0001"), ("1", "150.5", "1"), ("0", "0", "0"), ("1", "50", "1"), ("1", "49.999999", "1")]
    lines += [(number(14, 6), number(14, 6), number(5, 4)) for _ in range(300)]
    none = [("123456789012345", "1", "1"), ("1", None, "1"), ("1", "1", "x"), ("1.0000001", "1", "1"), ("", "1", "1"), ("-1", "1", "1")]
    rows = [(f"L{i}", "1404-01-01", "1", *l, "0") for i, l in enumerate(lines + none)]
    spark.createDataFrame([*rows, rows[0]], "line_id string, issue_date string, sstid string, am string, fee string, vra string, vam string").write.parquet(str(tmp_path / "demo_invoices.parquet"))
    want = {}
    for i, l in enumerate(lines):
        x = Fraction(l[0]) * Fraction(l[1]) * Fraction(l[2]) / 100
        want[f"L{i}"] = tuple(float(v) for v in (math.floor(x + Fraction(1, 2)), math.floor(x), math.ceil(x)))
    before = spark.conf.get("spark.sql.decimalOperations.allowPrecisionLoss")
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", loss)
    try:
        got = rounding_modes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", before)
    assert {r.line_id: (r.half_up, r.down, r.up) for r in got} == want and len(got) == len(want)


def test_synonym_queries_of_every_pair(spark, tmp_path):
    from tarazu.plans.workload import silver_v2

    id_ = lambda n: f"29{n:011d}"
    rows = [(1, 1, "گوشی آبی، بزرگ، نو"), (2, 2, "گوشی آبی، بزرگ، کهنه"), (3, 3, "موبایل آبی، بزرگ، نو"), (4, 4, "قاب گوشی"), *((n, n, "یخچال بزرگ") for n in range(10, 32))]
    rows = [row(n, id_(i), "1403-01-01", title=t) for n, i, t in rows] + [row(5, id_(5), "1402-01-01", title="یخچال کوچک"), row(6, id_(5), "1403-01-01", title="یخچال متوسط")]
    df = spark.createDataFrame([r[:11] for r in rows], CATALOG)
    df.write.parquet(str(tmp_path / "fake_catalog.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "fake_catalog_general.parquet"))
    pairs = [("گوشی", "موبایل"), ("یخچال", "سردکن"), ("نیست", "هیچ"), ("یکی", "یکی")]
    spark.createDataFrame([(*p, None) for p in pairs], "catalog_term string, seller_term string, note string").write.parquet(str(tmp_path / "head_synonyms.parquet"))
    number = {p: n for n, p in enumerate(sorted(pairs), 1)}
    got = silver_v2(spark, str(tmp_path)).collect()
    main = {r.row_n: (r.term_n, r.level, r.n_catalog, r.n_seller, r.n_label, r.tier, r.verdict) for r in got if r.level != "head"}
    phone, fridge = number[pairs[0]], number[pairs[1]]
    assert {n: r for n, r in main.items() if n < 10} == {1: (phone, "A2", 1, 1, 2, "C", "emitted"), 2: (phone, "A2", 1, 0, 1, "S", "emitted"), 4: (phone, "A0", 1, 0, 1, "S", "emitted")}
    over = [r for n, r in main.items() if n >= 10]
    assert over == [(fridge, "A0", 22, 0, 22, None, "over_max")] * 10
    bare = {r.term_n: (r.query, r.n_catalog, r.n_seller, r.n_label, r.tier, r.verdict) for r in got if r.level == "head"}
    want = [("موبایل", 3, 1, 4, "C", "emitted"), ("سردکن", 23, 0, 23, "C", "emitted"), ("هیچ", 0, 0, 0, None, "zero_coverage"), ("یکی", 0, 0, 0, None, "invalid")]
    assert bare == {number[p]: w for p, w in zip(pairs, want, strict=True)} and len(got) == 17


def test_ambiguity_of_all_titles(spark, tmp_path):
    from tarazu.plans.workload import ambiguity_categories

    titles = ["سیب، ریز، شماره فنی ۱ / شرکت باغ", "سیب، ریز، شماره فنی ۲ / شرکت باغ", "سیب، ریز / شرکت دشت", "موز، درشت / زرد", "توت", "توت"]
    df = spark.createDataFrame([row(n, f"29{n:011d}", "1403-01-01", title=t) for n, t in enumerate(titles, 1)], CATALOG)
    df.write.parquet(str(tmp_path / "fake_catalog.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "fake_catalog_general.parquet"))
    got = {r.category: r.n for r in ambiguity_categories(spark, str(tmp_path)).collect()}
    assert got == {"unique_with_all_attrs": 1, "needs_mfr_or_partno": 3, "unique_under_none": 2, "mfr_only": 1, "partno_only": 2, "either": 0, "has_mfr": 3, "has_partno": 2}
