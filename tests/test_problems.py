"""The general problems' operators against brute force, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarazu.operators.asof import as_known_at
from tarazu.operators.history import attribute_history, attribute_intervals
from tarazu.operators.intervals import periods_and_gaps
from tarazu.operators.parse import Field, RecordSchema, column_reasons, first_broken, row_reasons, split_records
from tarazu.operators.skew import salted_join


def covered(intervals, horizon=60):
    days = set()
    for s, e in intervals:
        days |= set(range(s, (horizon if e is None else e) + 1))
    return days


def stretches(days):
    out = []
    for d in sorted(days):
        if out and out[-1][1] == d - 1:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


def test_periods_and_gaps_equal_a_walk_over_days(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for e in range(60):
        own = [(s := rng.randrange(40), None if rng.random() < 0.1 else s + rng.choice([0, 1, 3, 9])) for _ in range(rng.randrange(1, 7))]
        rows += [(str(e), s, x) for s, x in own * rng.choice([1, 2])]
        if len(set(own)) < 2:
            continue
        parts = stretches(covered(own))
        want |= {(str(e), "period", s, None if x >= 60 else x) for s, x in parts}
        want |= {(str(e), "gap", a[1] + 1, b[0] - 1) for a, b in zip(parts, parts[1:])}
    df = spark.createDataFrame(rows, "e string, s int, x int")
    got = periods_and_gaps(df, "e", F.col("s"), F.col("x"), at_least=2)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_periods_edge_cases(spark):
    df = spark.createDataFrame([("a", 1, 5, "z"), (None, 1, 2, "z"), ("b", None, 4, None), ("c", 9, 3, "z")], "e string, s int, x int, kind string")
    assert [tuple(r) for r in periods_and_gaps(df, "e", F.col("s"), F.col("x")).collect()] == [("a", "period", 1, 5)]
    assert periods_and_gaps(df.limit(0), "e", F.col("s"), F.col("x")).count() == 0
    assert periods_and_gaps(df, "e", F.col("s"), F.col("x"), at_least=2).count() == 0


def test_history_equals_a_walk(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for e in range(50):
        best = {}
        for _ in range(rng.randrange(1, 8)):
            r = (str(e), rng.randrange(12), rng.choice([None, 9, 10]), rng.choice(["x", "y"]), rng.randrange(5), len(rows))
            rows.append(r)
            best[r[1]] = max(best.get(r[1], (-1, -1, r)), (r[4], r[5], r))
        versions = []
        for at in sorted(best):
            v = best[at][2][2:4]
            if not versions or versions[-1][1] != v:
                versions.append((at, v))
        ends = [v[0] for v in versions[1:]] + [None]
        want |= {(str(e), *v, at, to) for (at, v), to in zip(versions, ends)}
    df = spark.createDataFrame(rows, "e string, at int, vat int, tax string, edit int, n int")
    attributes = {"vat": F.col("vat"), "tax": F.col("tax")}
    got = attribute_history(df, "e", F.col("at"), attributes, [F.col("edit"), F.col("n")])
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    each = attribute_intervals(df, "e", F.col("at"), attributes, [F.col("edit"), F.col("n")]).collect()
    for r in each:  # every interval of an attribute covers only versions with its value
        k = {"vat": 1, "tax": 2}[r.attribute]
        inside = [v for v in want if v[0] == r.e and v[3] >= r.valid_from and (r.valid_to is None or v[3] < r.valid_to)]
        assert all((None if v[k] is None else str(v[k])) == r.value for v in inside)


def test_attributes_change_at_their_own_times(spark):
    # (entity, time, attribute given, value, edit): an update may carry one attribute only.
    rows = [("e", 1, "both", "9", "x", 0), ("e", 3, "vat", "10", None, 0), ("e", 5, "tax", None, "y", 0), ("e", 5, "vat", "10", None, 1), ("e", 7, "tax", None, None, 0), ("e", 3, "vat", "11", None, 1), ("f", 2, "tax", None, "z", 0)]
    df = spark.createDataFrame(rows, "e string, at int, given string, vat string, tax string, edit int")
    said = {"vat": F.col("given").isin("both", "vat"), "tax": F.col("given").isin("both", "tax")}
    attributes = {"vat": F.col("vat"), "tax": F.col("tax")}
    each = attribute_intervals(df, "e", F.col("at"), attributes, [F.col("edit")], said)
    assert {tuple(r) for r in each.collect()} == {("e", "vat", "9", 1, 3), ("e", "vat", "11", 3, 5), ("e", "vat", "10", 5, None), ("e", "tax", "x", 1, 5), ("e", "tax", "y", 5, 7), ("e", "tax", None, 7, None), ("f", "tax", "z", 2, None)}
    got = attribute_history(df, "e", F.col("at"), attributes, [F.col("edit")], carried=said)
    assert {tuple(r) for r in got.collect()} == {("e", "9", "x", 1, 3), ("e", "11", "x", 3, 5), ("e", "10", "y", 5, 7), ("e", "10", None, 7, None), ("f", None, "z", 2, None)}


def test_history_edge_cases(spark):
    df = spark.createDataFrame([("a", 1, None, 0), ("a", 2, None, 0), (None, 1, 5, 0), ("b", None, 5, 0), ("a", 3, 7, 0)], "e string, at int, v int, n int")
    got = attribute_history(df, "e", F.col("at"), {"v": F.col("v")}, [F.col("n")]).orderBy("valid_from").collect()
    assert [tuple(r) for r in got] == [("a", None, 1, 3), ("a", 7, 3, None)]
    assert attribute_history(df.limit(0), "e", F.col("at"), {"v": F.col("v")}, [F.col("n")]).count() == 0


@pytest.mark.parametrize("group_rows", [7, 40_000])
def test_as_known_at_equals_brute_force(spark, group_rows):
    rng = random.Random(7)
    versions = [(str(rng.randrange(8)), s := rng.randrange(30), None if rng.random() < 0.2 else s + rng.randrange(-1, 15), rng.choice([None, 1, 2]), i, rng.randrange(30)) for i in range(60)]
    events = [(i, rng.choice(["0", "0", "0", str(rng.randrange(10)), None]), rng.choice([None, *range(35)])) for i in range(200)]
    v = spark.createDataFrame(versions, "id string, f int, t int, edit int, n int, rec int")
    e = spark.createDataFrame(events, "i int, id string, d int")

    def best(ev, recorded):
        ok = [x for x in versions if ev[1] is not None and x[0] == ev[1] and ev[2] is not None and x[1] <= ev[2] and (x[2] is None or ev[2] <= x[2]) and (not recorded or x[5] <= ev[2])]
        return min(ok, key=lambda x: (-x[1], x[3] is None, -(x[3] or 0), x[4]))[4] if ok else None

    for recorded in (False, True):
        got = as_known_at(e, v, entity="id", at=F.col("d"), version_entity="id", valid_from=F.col("f"), valid_to=F.col("t"), prefer=[-F.col("edit"), F.col("n")], carry={"i": F.col("i")}, attributes={"n": F.col("n")}, known_from=F.col("rec") if recorded else None, how="left", group_rows=group_rows)
        assert {tuple(r) for r in got.collect()} == {(ev[0], best(ev, recorded)) for ev in events}
        inner = as_known_at(e, v, entity="id", at=F.col("d"), version_entity="id", valid_from=F.col("f"), valid_to=F.col("t"), prefer=[-F.col("edit"), F.col("n")], carry={"i": F.col("i")}, attributes={"n": F.col("n")}, known_from=F.col("rec") if recorded else None, group_rows=group_rows)
        assert {tuple(r) for r in inner.collect()} == {(ev[0], b) for ev in events if (b := best(ev, recorded)) is not None}


def test_as_known_at_edge_cases(spark):
    e = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, None, 5), (3, "a", None)], "i int, id string, d int")
    v = spark.createDataFrame([("a", 1, None, 1), ("a", 1, None, 1)], "id string, f int, t int, n int")
    ask = {"entity": "id", "at": F.col("d"), "version_entity": "id", "valid_from": F.col("f"), "valid_to": F.col("t"), "prefer": [F.col("n")], "carry": {"i": F.col("i"), "id": F.col("id")}, "attributes": {"v_id": F.col("id"), "n": F.col("n")}}
    assert sorted(tuple(r) for r in as_known_at(e, v, **ask).collect()) == [(1, "a", "a", 1)] * 2
    assert as_known_at(e, v, **ask, how="left").count() == 4
    assert {r.n for r in as_known_at(e, v.limit(0), **ask, how="left").collect()} == {None}
    assert as_known_at(e.limit(0), v, **ask, how="left").count() == 0
    with pytest.raises(ValueError):
        as_known_at(e, v, **(ask | {"attributes": {"id": F.col("id")}}))


def state_machine(record, n):
    """A plain reader of one record: None if its quotes are broken, else its fields."""
    out, i = [], 0
    while True:
        if record[i : i + 1] == '"':
            j, value = i + 1, ""
            while True:
                k = record.find('"', j)
                if k < 0:
                    return None
                value += record[j:k]
                if record[k + 1 : k + 2] == '"':
                    value += '"'
                    j = k + 2
                    continue
                break
            i = k + 1
            if i < len(record) and record[i] != ",":
                return None
        else:
            k = record.find(",", i)
            value = record[i : k if k >= 0 else len(record)]
            if '"' in value:
                return None
            i = k if k >= 0 else len(record)
        out.append(value)
        if i >= len(record):
            return out
        i += 1


SCHEMA = RecordSchema([Field("k"), Field("am", r"[0-9]{1,3}(?:\.[0-9]{1,2})?", "am"), Field("t"), Field("am2", "[0-9]{2}", "am2")])


def test_records_equal_a_plain_reader(spark):
    rng = random.Random(8)
    pieces = ['"', '""', ",", "a", "12", "7.5", "\n", " ", '"x,y"', '"12"', "", "ب"]
    records = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(600)]
    records += [f'{a},{b},{c},{d}' for a in ("x", '"p,""q"""') for b in ("1", '"1"', " 1", "1.", "1000", "") for c in ("", "z") for d in ("12", "1", "123", '"99"', "12\n")]
    df = spark.createDataFrame([(i, r, "mine") for i, r in enumerate(records)], "i int, record string, reasons string")
    loaded, rejected = split_records(df, "record", SCHEMA)
    good = {r.i: tuple(r.fields) for r in loaded.collect()}
    bad = {r.i: list(r.reasons) for r in rejected.collect()}
    assert set(good) | set(bad) == set(range(len(records))) and not set(good) & set(bad)
    for i, record in enumerate(records):
        fields = state_machine(record, 4)
        if fields is None:
            assert bad[i] == ["quoting"], record
        elif len(fields) != 4:
            assert bad[i] == ["field_count"], record
        else:
            want = [n for n, j, p in (("am", 1, r"[0-9]{1,3}(\.[0-9]{1,2})?"), ("am2", 3, "[0-9]{2}")) if not re.fullmatch(p, fields[j])]
            assert bad.get(i, []) == want, record
            if not want:
                assert good[i] == tuple(fields)


def test_record_edge_cases(spark):
    long = "x," + "1," + '"' + 'ab""' * 200_000 + '"' + ",12"
    df = spark.createDataFrame([(0, None), (1, ""), (2, long), (3, long), (4, long[:-3] + 'z"')], "i int, record string")
    got = {r[0]: (list(r[1]), r[2]) for r in df.select("i", row_reasons(F.col("record"), SCHEMA), first_broken(F.col("record"), SCHEMA)).collect()}
    assert got[0] == (["field_count"], 1) and got[1] == (["field_count"], 2)
    assert got[2] == got[3] == ([], None) and got[4][0] == ["quoting"]
    loaded, rejected = split_records(df.limit(0), "record", SCHEMA)
    assert loaded.count() == rejected.count() == 0


def test_columns_are_judged_by_the_same_patterns(spark):
    rows = [("1", "12", []), (None, "12", ["am"]), (" 1", "1", ["am", "am2"]), ("1\x1f12", "12", ["am"]), ("1,2", '"12"', ["am", "am2"]), ("", "12\n", ["am", "am2"])]
    df = spark.createDataFrame([r[:2] for r in rows], "am string, am2 string")
    got = [list(r[0]) for r in df.select(column_reasons(SCHEMA)).collect()]
    assert got == [r[2] for r in rows]


def test_salted_join_equals_a_join(spark):
    rng = random.Random(9)
    big = spark.createDataFrame([(rng.choice(["hot", "hot", "a", "b", None]), i) for i in range(300)], "k string, i int")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("z", 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(big, other, ["k"], [F.col("i")], rows=20, how=how)
        want = big.join(other, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), how
