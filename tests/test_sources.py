"""Files and streams."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from tarazu.operators.parse import Field, RecordSchema
from tarazu.sources import files
from tarazu.sources.tables import CATALOG_COLUMNS, LINE_COLUMNS
from tarazu.streaming import ingest

ROWS = [["2900000000001", 'نام, با "نقل"\nو سطر', "10", "مشمول", "1403-01-01", "", "1403-01-01", "1403-01-01", "نوع", ""], ["2900000000002", "دوم", "9", "معاف", "1403-02-01", "1403-05-01", "", "", "", ""]]


def as_csv(header, rows):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    return "﻿" + "".join(",".join(map(quoted, r)) + "\n" for r in [header, *rows])


def test_csv_and_zip_give_the_same(spark, tmp_path):
    text = as_csv(CATALOG_COLUMNS, ROWS)
    (tmp_path / "c.csv").write_text(text, encoding="utf8")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("inner.csv", text)
    want = [tuple(v or None for v in r) for r in ROWS]
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "c.csv")).collect()] == want
    assert [tuple(r) for r in files.read_catalog(spark, str(tmp_path / "c.zip")).collect()] == want
    assert files.only_zip(str(tmp_path)) == str(tmp_path / "c.zip")
    numbered = spark.read.format("zipcsv").option("path", str(tmp_path)).load()
    assert [r.row_n for r in numbered.collect()] == [1, 2]


def test_wrong_files_fail(spark, tmp_path):
    (tmp_path / "header.csv").write_text(as_csv(["x"] * 10, ROWS), encoding="utf8")
    (tmp_path / "short.csv").write_text(as_csv(CATALOG_COLUMNS, [ROWS[0][:5]]), encoding="utf8")
    for name in ("header.csv", "short.csv"):
        with pytest.raises(Exception):
            files.read_catalog(spark, str(tmp_path / name)).collect()
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "")
        z.writestr("b.csv", "")
    with pytest.raises(Exception, match="not one"):
        files.read_catalog(spark, str(tmp_path / "two.zip")).collect()
    with pytest.raises(ValueError):
        files.only_zip(str(tmp_path / "none"))


def test_lines_golden_synonyms(spark, tmp_path):
    (tmp_path / "l.csv").write_text(as_csv(LINE_COLUMNS, [["L1", "1403-01-01", "1", "x", "1", "", "2", "9", "3", "T6;;T2"], ["L2", "", "", "", "", "", "", "", "", ""]]), encoding="utf8")
    assert [r.labels for r in files.read_lines(spark, str(tmp_path / "l.csv")).collect()] == [["T6", "T2"], []]
    (tmp_path / "g.csv").write_text("query_text,expected_sstid,tier,notes\na,1,S\nb,2,C,n,extra\n", encoding="utf8")
    assert [tuple(r) for r in files.read_golden(spark, str(tmp_path / "g.csv")).collect()] == [("a", "1", "S", None), ("b", "2", "C", "n")]
    (tmp_path / "s.csv").write_text("# list\ncatalog_term,seller_term,note\nx,y,\n# end\n", encoding="utf8")
    assert [tuple(r) for r in files.read_synonyms(spark, str(tmp_path / "s.csv")).collect()] == [("x", "y", None)]


def test_digests_and_sink(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"hello\n")
    r = files.file_digests(spark, str(tmp_path / "f")).first()
    assert r.sha256 == hashlib.sha256(b"hello\n").hexdigest()
    assert r.git_blob == hashlib.sha1(b"blob 6\0hello\n").hexdigest()
    df = spark.createDataFrame([("b", 'q"x'), ("a", "1,2")], "k string, v string")
    got = []
    for n in ("one", "two"):
        files.write_csv(df.repartition(2), str(tmp_path / n), ["k"])
        got.append(next((tmp_path / n).glob("*.csv")).read_text())
    assert got[0] == got[1] == 'k,v\na,"1,2"\nb,"q""x"\n'


SCHEMA = RecordSchema([Field("k"), Field("am", "[0-9]+", "am")])


def test_stream_of_records(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "a,1"), (2, "a,x"), (3, 'a"b,1'), (4, "a"), (5, None)], "i int, record string").withColumn("at", F.lit("2025-01-01 00:10:00").cast("timestamp"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = ingest.split_to(stream, "record", SCHEMA, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.i for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [1]
    assert {r.i: r.reasons for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {2: ["am"], 3: ["quoting"], 4: ["field_count"], 5: ["field_count"]}
    counted = ingest.reasons_by_window(stream, "record", SCHEMA, "at").writeStream.format("memory").queryName("reasons").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert {r.reason: r.n for r in spark.table("reasons").collect()} == {"am": 1, "quoting": 1, "field_count": 2}


def test_stream_of_lines(spark, tmp_path):
    src = str(tmp_path / "in")
    lines = spark.createDataFrame([("L1", "x", "1403-05-01"), ("L1", "x", "1403-05-01"), ("L2", "x", "1404-05-01"), ("L3", None, "1403-05-01")], "line_id string, sstid string, day string").withColumn("at", F.lit("2025-01-01 00:10:00").cast("timestamp"))
    lines.write.parquet(src)
    versions = spark.createDataFrame([("x", "1403-01-01", "1404-01-01", 9), ("x", "1404-01-01", None, 10)], "sstid string, valid_from string, valid_to string, rate int")
    stream = ingest.first_deliveries(spark.readStream.schema(lines.schema).parquet(src), "line_id", "at")
    q = ingest.with_version(stream, versions, F.col("sstid"), F.col("day")).writeStream.format("memory").queryName("versions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.line_id, r.rate) for r in spark.table("versions").collect()) == [("L1", 9), ("L2", 10), ("L3", None)]
