"""The calendar against a plain walk over its days."""

from datetime import date

from pyspark.sql import functions as F

from tarazu.functions import jalali


def walk(first, last):
    for y in range(first, last + 1):
        for m in range(1, 13):
            n = 31 if m <= 6 else 30 if m < 12 or jalali.is_leap(y) else 29
            for d in range(1, n + 1):
                yield f"{y:04d}-{m:02d}-{d:02d}"


def test_every_day_round_trips_and_days_are_contiguous(spark):
    days = list(walk(1390, 1415))
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "d string, i int")
    n = jalali.to_days(F.col("d"))
    rows = df.select("d", "i", n.alias("n"), jalali.from_days(n).alias("back"), jalali.next_day(F.col("d")).alias("nx"), jalali.prev_day(F.col("d")).alias("pv")).orderBy("i").collect()
    assert all(r.n - r.i == rows[0].n for r in rows)
    assert all(r.back == r.d for r in rows)
    assert all(a.nx == b.d and b.pv == a.d for a, b in zip(rows, rows[1:]))
    known = {r.d: r.n for r in rows}
    assert known["1404-01-01"] == (date(2025, 3, 21) - date(1970, 1, 1)).days


def test_what_is_no_day(spark):
    bad = ["1404-12-30", "1404-07-31", "1403-13-01", "1403-00-10", "1403-1-01", "1403/01/01", "۱۴۰۳-۰۱-۰۱", "", " 1403-01-01", "1403-01-01\n", None, "9999-12-29"]
    df = spark.createDataFrame([(b,) for b in bad], "d string")
    assert [r[0] for r in df.select(jalali.is_day(F.col("d"))).collect()] == [False] * len(bad)
    assert {r[0] for r in df.select(jalali.to_days(F.col("d"))).collect()} == {None}
    good = spark.createDataFrame([("1403-12-30",), ("1399-12-30",), ("1408-12-30",), ("1404-06-31",)], "d string")
    assert all(r[0] for r in good.select(jalali.is_day(F.col("d"))).collect())
