from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests import xml as X

from inspectlake.functions import dates
from inspectlake.plans.inspections import INSPECTIONS
from inspectlake.sources import delimited, documents, files, tables


def test_dates_in_names(frame):
    rows = [
        ("/d/Prohlídky za 07-01-2019.parquet", date(2019, 1, 7), date(2019, 1, 7)),
        ("/d/Prohlídky za 07-01-2019.xml.gz", None, date(2019, 1, 7)),
        ("/d/Prohlídky za 7-1-2019.xml", date(2019, 1, 7), date(2019, 1, 7)),
        ("/d/Prohlídky za 31-02-2019.xml", None, None),
        ("/d/07-01-2019", date(2019, 1, 7), date(2019, 1, 7)),
        ("/d/x.y 07-01-2019.xml", date(2019, 1, 7), None),
        ("/d/poznamky.txt", None, None),
    ]
    df = frame([(row[0],) for row in rows], "path string").select(
        "path",
        dates.day_from_path(F.col("path")).alias("by_path"),
        dates.day_from_title(dates.file_name(F.col("path"))).alias("by_title"),
    )
    assert [tuple(r) for r in df.collect()] == rows


def test_text_dates_round_trip(frame):
    df = frame([("05-11-2020",), ("2020-11-05",), ("x",), (None,)], "t string")
    day = dates.text_to_day(F.col("t"))
    assert [tuple(r) for r in df.select(day, dates.day_to_text(day)).collect()] == [
        (date(2020, 11, 5), "05-11-2020"),
        (None, None),
        (None, None),
        (None, None),
    ]


def test_decoded_path_keeps_plus(frame):
    (row,) = frame([("file:/a/b%20c+d%C3%AD.xml",)], "p string").select(dates.decoded_path(F.col("p"))).collect()
    assert row[0] == "file:/a/b c+dí.xml"


def test_interval(frame):
    df = frame([(date(2020, 1, day),) for day in (1, 2, 3)], "den date")
    first, second = F.lit(date(2020, 1, 2)), F.lit(date(2020, 1, 2))
    assert df.where(dates.within(F.col("den"), first)).count() == 2
    assert df.where(dates.within(F.col("den"), first, second)).count() == 1
    assert df.where(dates.within(F.col("den"), first, F.lit(None).cast("date"))).count() == 2


def test_listing_days_and_work(spark, tmp_path):
    for name in ("B 02-01-2020.xml", "A 03-01-2020.xml", "C 01-01-2020.xml.gz"):
        X.put(tmp_path / "a", name, "x")
    X.put(tmp_path / "b", "A 03-01-2020.xml", "x")
    X.put(tmp_path / "b", "bez data.xml", "x")
    listing = files.list_files(spark, str(tmp_path / "a"))
    assert files.count_files(listing).first().files == 3
    assert [r.soubor for r in files.work_list(listing).collect()] == ["C 01-01-2020", "B 02-01-2020", "A 03-01-2020"]
    where = [str(tmp_path / name) for name in ("a", "b", "absent")]
    days = {r.den for r in files.ingested_days(spark, where).collect()}
    assert days == {date(2020, 1, 2), date(2020, 1, 3)}  # .xml.gz names no day by this rule
    assert files.ingested_days(spark, [str(tmp_path / "absent")]).count() == 0
    waiting = files.pending(listing, files.ingested_days(spark, where))
    assert [r.soubor for r in waiting.collect()] == ["C 01-01-2020"]
    with pytest.raises(Exception, match="no dd-mm-yyyy day"):
        files.work_list(files.list_files(spark, str(tmp_path / "b"))).collect()


def test_sample_is_repeatable(spark, tmp_path):
    for n in range(9):
        X.put(tmp_path, f"F {n + 1}-01-2020.xml", "x")
    listing = files.list_files(spark, str(tmp_path))
    first = [r.path for r in files.sample_files(listing, 5, 1).collect()]
    assert len(set(first)) == 5
    assert first == [r.path for r in files.sample_files(listing, 5, 1).collect()]
    assert first != [r.path for r in files.sample_files(listing, 5, 2).collect()]


def test_audit_finds_the_unreadable(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "good one.parquet")
    pq.write_table(pa.table({"a": pa.array([], pa.int64())}), tmp_path / "empty.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 junk")
    bad = files.unreadable_files(files.list_files(spark, str(tmp_path))).collect()
    assert len(bad) == 1 and bad[0].path.endswith("/bad.parquet") and bad[0].error


def test_forced_schema_over_disagreeing_days(spark, tmp_path):
    pq.write_table(pa.table({"a": ["x"], "b": ["y"]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"a": ["z"]}), tmp_path / "2.parquet")
    pq.write_table(pa.table({"a": ["w"], "b": pa.nulls(1)}), tmp_path / "3.parquet")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    rows = tables.scan_day_files(spark, str(tmp_path), schema)
    assert sorted(tuple(r) for r in rows.collect()) == [("w", None), ("x", "y"), ("z", None)]
    assert [r.a for r in rows.where("b = 'y'").collect()] == ["x"]
    typed = tables.scan_parquet(spark, str(tmp_path / "[12].parquet"), schema).collect()
    assert sorted(tuple(r) for r in typed) == [("x", "y"), ("z", None)]


def test_document_status(spark, tmp_path):
    body = X.inspections(X.simple("1") + X.simple("2"))
    X.put(tmp_path, "dobry 01-01-2020.xml", body)
    X.put(tmp_path, "stlaceny 02-01-2020.xml.gz", body)
    X.put(tmp_path, "bez obalky 03-01-2020.xml", "<DatovaSada><Jine/></DatovaSada>")
    X.put(tmp_path, "prazdna obalka 04-01-2020.xml", "<DatovaSada><DatovyObsah/></DatovaSada>")
    X.put(tmp_path, "prazdny seznam 05-01-2020.xml", X.inspections(""))
    X.put(tmp_path, "rozbity 06-01-2020.xml", body.replace("</CisloProtokolu>", "", 1))
    X.put(tmp_path, "useknuty [1] 07-01-2020.xml", body[: body.rindex("</ProhlidkaSeznam>")])
    X.put(tmp_path, "bez protokolu 08-01-2020.xml", X.inspections("<Prohlidka/>"))
    large = X.inspections("".join(X.simple(str(hash(str(i)))) for i in range(3000)))
    cut = tmp_path / "useknuty gz 09-01-2020.xml.gz"
    X.put(tmp_path, cut.name, large)
    cut.write_bytes(cut.read_bytes()[:-2000])
    rows = documents.check_documents(spark, INSPECTIONS, str(tmp_path)).collect()
    assert {r.soubor.rsplit(" ", 1)[0]: (r.status, r.records) for r in rows if r.status == "ok"} == {
        "dobry": ("ok", 2),
        "stlaceny": ("ok", 2),
        "prazdny seznam": ("ok", 0),
        "bez protokolu": ("ok", 1),
    }
    assert {r.soubor.rsplit(" ", 1)[0]: r.status for r in rows if r.status != "ok"} == {
        "bez obalky": "no_envelope",
        "prazdna obalka": "no_envelope",
        "rozbity": "damaged",
        "useknuty [1]": "damaged",
        "useknuty gz": "damaged",
    }
    with pytest.raises(Exception, match="document is"):
        documents.require_ok(documents.check_documents(spark, INSPECTIONS, str(tmp_path))).collect()


def test_tolerant_csv(spark, tmp_path):
    X.put(tmp_path, "r.csv", 'a,b,c\n1,"x,2\n3\n4,y,5,6,7\n,\\,z\n')
    rows = delimited.scan_tolerant(spark, str(tmp_path / "r.csv")).collect()
    assert sorted(tuple(r) for r in rows if r.a) == [("1", '"x', "2"), ("3", None, None), ("4", "y", "5")]
    assert [tuple(r) for r in rows if not r.a] == [(None, "\\", "z")]


def test_stacked_csv(spark, tmp_path):
    X.put(tmp_path, "2020_V.csv", "SME;VIN\n1;a\n")
    X.put(tmp_path, "2021_V.csv", "VIN;SME;X\nb;2;9\n")
    X.put(tmp_path, "2021_Z.csv", "SME;VIN\n7;z\n")
    listing = delimited.with_stem_ending(files.list_files(spark, str(tmp_path)), "V")
    rows = delimited.stack(spark, [r.path for r in listing.collect()]).select("SME", "VIN", "X").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "a", None), ("2", "b", "9")]


def test_files_of_any_number_are_stacked_by_a_fixed_number_of_jobs(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for count in (3, 12):
        for n in range(count):
            X.put(tmp_path / str(count), f"{n} [x]+.csv", ("a;b\n" if n % 2 else "b;a;a;\n") + f"{n};y;z;w\n")
        spark.sparkContext.setJobGroup(f"stack{count}", "")
        rows = delimited.stack(spark, [str(tmp_path / str(count))])
        jobs.append(len(tracker.getJobIdsForGroup(f"stack{count}")))
        found = [r.asDict() for r in rows.collect()]
        assert len(found) == count and set(rows.columns) == {"a", "b", "a1", "a2", "_c3"}
        assert sorted(r["a"] for r in found if r["a"]) == sorted(str(n) for n in range(count) if n % 2)
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]
    X.put(tmp_path / "empty", "e.csv", "")
    assert delimited.stack(spark, [str(tmp_path / "empty")]).columns == []
