from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tests import xml as X

from inspectlake.plans.inspections import INSPECTIONS, PARENT_SCHEMA, SUMS_SCHEMA
from inspectlake.plans.measurements import MEASUREMENTS
from inspectlake.sources import tables
from inspectlake.streaming import ingest
from inspectlake.workload import queries


def one(number, codes=""):
    listed = "".join(f"<Zavada><Kod>{code}</Kod></Zavada>" for code in codes)
    return X.simple(number, f"<TechnickaCast><ZavadaSeznam>{listed}</ZavadaSeznam></TechnickaCast>")



def contents(spark, target, name):
    stored = spark.read.parquet(f"{target}/{name}")
    columns = T.StructType([f for f in stored.schema if f.name not in ("den", "soubor", "verze")])
    rows = [r.asDict() for r in tables.read_days(spark, f"{target}/{name}", columns).collect()]
    return sorted((str(r["den"]), r["soubor"], r["CisloProtokolu"], r.get("Kod")) for r in rows)


@pytest.fixture
def feed(tmp_path):
    source = tmp_path / "xml"
    X.put(source, "P 01-01-2020.xml", X.inspections(one("1", "ab") + one("2")))
    X.put(source, "P 02-01-2020.xml.gz", X.inspections(one("3", "c")))
    return source


def test_batch_waves_equal_one_run(spark, feed, tmp_path):
    in_two, at_once = str(tmp_path / "two"), str(tmp_path / "one")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), in_two, end=date(2020, 1, 1))
    assert len(contents(spark, in_two, "prohlidky")) == 2
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), in_two)
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), at_once)
    for name in ("prohlidky", "zavady"):
        assert contents(spark, in_two, name) == contents(spark, at_once, name)
    assert len(contents(spark, at_once, "zavady")) == 3
    before = ingest.commits(spark, in_two).count()
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), in_two)
    assert ingest.commits(spark, in_two).count() == before  # nothing was pending
    stored = tables.read_days(spark, f"{in_two}/prohlidky", PARENT_SCHEMA)
    assert stored.where("Vozidlo_Vin IS NULL").count() == 3
    assert len(stored.columns) == 60


def test_corrected_document_replaces_all_its_rows(spark, feed, tmp_path):
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    path = X.put(feed, "P 01-01-2020.xml", X.inspections(one("1")))
    ingest.ingest_files(spark, INSPECTIONS, [path], target, "oprava")
    assert [r[2] for r in contents(spark, target, "prohlidky")] == ["1", "3"]
    assert [r[3] for r in contents(spark, target, "zavady")] == ["c"]
    ingest.ingest_files(spark, INSPECTIONS, [path], target, "oprava")  # a repeated run changes nothing
    assert [r[2] for r in contents(spark, target, "prohlidky")] == ["1", "3"]


def test_damaged_document_is_quarantined_whole_and_retried(spark, feed, tmp_path):
    target = str(tmp_path / "t")
    bad = X.inspections(one("8") + one("9")).replace("</ProhlidkaSeznam>", "")
    X.put(feed, "P 03-01-2020.xml", bad)
    X.put(feed, "P 04-01-2020.xml", "<DatovaSada/>")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    assert {r[0] for r in contents(spark, target, "prohlidky")} == {"2020-01-01", "2020-01-02"}
    status = {r.soubor: r.stav for r in ingest.commits(spark, target).collect()}
    assert status == {
        "P 01-01-2020": "ok",
        "P 02-01-2020": "ok",
        "P 03-01-2020": "damaged",
        "P 04-01-2020": "no_envelope",
    }
    X.put(feed, "P 03-01-2020.xml", X.inspections(one("8")))
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    assert "8" in [r[2] for r in contents(spark, target, "prohlidky")]


def test_stream_equals_batch_and_remembers(spark, feed, tmp_path):
    batch, stream, checkpoint = (str(tmp_path / name) for name in ("b", "s", "c"))
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), batch)
    ingest.ingest_stream(spark, INSPECTIONS, str(feed), stream, checkpoint, files_per_batch=1)
    for name in ("prohlidky", "zavady"):
        assert contents(spark, stream, name) == contents(spark, batch, name)
    runs = ingest.commits(spark, stream).count()
    X.put(feed, "P 03-01-2020.xml", X.inspections(one("4", "d")))
    ingest.ingest_stream(spark, INSPECTIONS, str(feed), stream, checkpoint)
    assert ingest.commits(spark, stream).count() == runs + 1
    assert len(contents(spark, stream, "prohlidky")) == 4


def test_measurements_use_the_same_path(spark, tmp_path):
    X.put(tmp_path / "m", "M 01-01-2020.xml", X.measurements("<Mereni/><Mereni><CisloProtokolu>1</CisloProtokolu></Mereni>"))
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, MEASUREMENTS, str(tmp_path / "m"), target)
    rows = spark.read.parquet(f"{target}/mereni").collect()
    assert sorted((r.CisloProtokolu or "") for r in rows) == ["", "1"]


def test_finished_input_is_archived_on_request(spark, feed, tmp_path):
    target, checkpoint, archive = (str(tmp_path / name) for name in ("t", "c", "done"))
    arguments = (spark, INSPECTIONS, str(feed), target, checkpoint)
    ingest.ingest_stream(*arguments, files_per_batch=1, archive=archive)
    X.put(feed, "P 03-01-2020.xml", X.inspections(one("4")))
    ingest.ingest_stream(*arguments, archive=archive)
    assert list((tmp_path / "done").rglob("P 01-01-2020.xml"))
    assert len(contents(spark, target, "prohlidky")) == 4


def test_scans_prune_and_push_down(spark, feed, tmp_path):
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    table = tables.read_days(spark, f"{target}/prohlidky", PARENT_SCHEMA)
    query = table.where("Vozidlo_Vin = 'V' AND den = DATE '2020-01-01'").select("CisloProtokolu", "Vozidlo_Vin")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Vozidlo_Vin,V)" in plan
    assert "den" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "ReadSchema: struct<CisloProtokolu:string,Vozidlo_Vin:string>" in plan
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # rows are not shuffled


def test_split_documents_hold_the_same_records(spark, tmp_path, monkeypatch):
    """A day with most of the rows is cut into part files, each of them whole."""
    from pyspark.sql import functions as F

    from inspectlake.sources import documents
    from inspectlake.workload import xmltext

    monkeypatch.setattr(xmltext, "RECORDS_PER_FILE", 50)
    hot = F.when(F.col("id") % 10 < 9, "P 01-01-2020").otherwise("P 02-01-2020")
    rows = spark.range(1000).withColumn("soubor", hot)
    record = xmltext.tag("Prohlidka", xmltext.tag("CisloProtokolu", "id"))
    feed = xmltext.write_feed(
        spark, rows, "id", record, "ProhlidkaSeznam", "istp:opendata:schemas:ProhlidkaSeznam:v1", str(tmp_path / "f")
    )
    checked = documents.check_documents(spark, INSPECTIONS, feed, glob="*.gz").collect()
    per_document = {name: [r for r in checked if r.soubor == name] for name in ("P 01-01-2020", "P 02-01-2020")}
    assert [len(parts) for parts in per_document.values()] == [18, 2]
    assert {r.status for r in checked} == {"ok"}
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, feed, target, glob="*.gz")
    assert sorted(int(r[2]) for r in contents(spark, target, "prohlidky")) == list(range(1000))
    assert sorted(r.zaznamu for r in ingest.commits(spark, target).collect()) == [100, 900]


def test_parts_in_several_batches_and_late_parts_keep_every_row(spark, tmp_path):
    source = tmp_path / "x" / "soubor=P 01-01-2020"
    for i in range(3):
        X.put(source, f"part-{i}.xml", X.inspections(one(f"{i}0", "a") + one(f"{i}1")))
    split, late = str(tmp_path / "s"), str(tmp_path / "l")
    ingest.ingest_stream(spark, INSPECTIONS, str(tmp_path / "x"), split, str(tmp_path / "c"), files_per_batch=1)
    ingest.ingest_pending(spark, INSPECTIONS, str(tmp_path / "x"), late, files_per_step=2)
    numbers = ["00", "01", "10", "11", "20", "21"]
    for target in (split, late):
        assert [r[2] for r in contents(spark, target, "prohlidky")] == numbers
        assert len(contents(spark, target, "zavady")) == 3
    X.put(source, "part-9.xml", X.inspections(one("90")))
    ingest.ingest_stream(spark, INSPECTIONS, str(tmp_path / "x"), split, str(tmp_path / "c"))
    ingest.ingest_pending(spark, INSPECTIONS, str(tmp_path / "x"), late)
    for target in (split, late):
        assert [r[2] for r in contents(spark, target, "prohlidky")] == [*numbers, "90"]


def test_a_write_that_dies_between_tables_changes_nothing_and_is_made_up(spark, feed, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    before = contents(spark, target, "prohlidky"), contents(spark, target, "zavady")
    X.put(feed, "P 01-01-2020.xml", X.inspections(one("1", "xyz") + one("7") + one("8")))
    write, calls = ingest.write_days, []

    def dies(rows, path, lookups=()):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk gone")
        write(rows, path, lookups)

    monkeypatch.setattr(ingest, "write_days", dies)
    with pytest.raises(OSError):
        ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    monkeypatch.setattr(ingest, "write_days", write)
    assert (contents(spark, target, "prohlidky"), contents(spark, target, "zavady")) == before
    assert not list((tmp_path / "t" / "_staging").iterdir())
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    assert [r[2] for r in contents(spark, target, "prohlidky")] == ["1", "7", "8", "3"]
    assert [r[3] for r in contents(spark, target, "zavady")] == ["x", "y", "z", "c"]


def test_stream_takes_up_repaired_and_corrected_documents(spark, feed, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    X.put(feed, "P 03-01-2020.xml", X.inspections(one("8")).replace("</ProhlidkaSeznam>", ""))
    ingest.ingest_stream(spark, INSPECTIONS, str(feed), target, checkpoint)
    assert [r[2] for r in contents(spark, target, "prohlidky")] == ["1", "2", "3"]
    X.put(feed, "P 03-01-2020.xml", X.inspections(one("8") + one("9")))
    X.put(feed, "P 01-01-2020.xml", X.inspections(one("1")))
    ingest.ingest_stream(spark, INSPECTIONS, str(feed), target, checkpoint)
    assert [r[2] for r in contents(spark, target, "prohlidky")] == ["1", "3", "8", "9"]


def test_documents_of_one_name_in_two_folders_are_both_kept(spark, tmp_path):
    for folder in "ab":
        X.put(tmp_path / "x" / folder, "P 01-01-2020.xml", X.inspections(one(folder)))
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, str(tmp_path / "x"), target)
    assert [r[2] for r in contents(spark, target, "prohlidky")] == ["a", "b"]


def test_replaced_versions_are_removed_and_lookups_have_bloom_filters(spark, feed, tmp_path):
    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    X.put(feed, "P 01-01-2020.xml", X.inspections(one("1") + one("5") + one("6")))
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    folder = tmp_path / "t" / "prohlidky" / "den=2020-01-01" / "soubor=P 01-01-2020"
    assert len(list(folder.glob("verze=*"))) == 2
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    (kept,) = folder.glob("verze=*")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
        jvm.org.apache.hadoop.fs.Path(str(next(kept.glob("*.parquet")))), conf
    )
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    columns = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks()[0].getColumns()}
    reader.close()
    assert columns["Vozidlo_Vin"] > 0 > columns["CisloProtokolu"]


def test_sums_take_back_what_a_correction_drops(spark, feed, tmp_path):
    def sums():
        kept = tables.read_days(spark, f"{target}/soucty", SUMS_SCHEMA).collect()
        return {(str(r.den), r.pocet) for r in kept}

    target = str(tmp_path / "t")
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    assert sums() == {("2020-01-01", 2), ("2020-01-02", 1)}
    X.put(feed, "P 01-01-2020.xml", X.inspections(one("1")))
    X.put(feed, "P 02-01-2020.xml.gz", X.inspections(one("3") + one("4"))[:-3])
    ingest.ingest_pending(spark, INSPECTIONS, str(feed), target)
    assert sums() == {("2020-01-01", 1), ("2020-01-02", 1)}


def test_incremental_ingest_has_a_document_for_every_day(spark, tmp_path):
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
    days = ["1998-06-29", "1998-06-30", "1998-07-01", "1998-07-02", "1998-07-02"]
    rows = spark.createDataFrame([(k, 1, "F", None, "1-URGENT") for k in range(2, 7)], columns)
    days = spark.createDataFrame(list(zip(range(2, 7), days, strict=True)), "o_orderkey long, d string")
    rows.join(days, "o_orderkey").withColumn("o_orderdate", F.to_timestamp("d")).drop("d").write.parquet(str(tmp_path / "orders.parquet"))
    found = queries.incremental_ingest(spark, str(tmp_path)).where("tabulka = 'prohlidky'").collect()
    assert sorted((str(r["den"]), r["radku"]) for r in found) == [
        ("1998-06-29", 1), ("1998-06-30", 1), ("1998-07-01", 1), ("1998-07-02", 2),
    ]


def test_small_files_have_small_bloom_filters(spark, tmp_path):
    rows = spark.sql("SELECT concat('VIN', id) AS v, DATE '2020-01-01' AS den FROM range(50)").coalesce(1)
    tables.write_days(rows, str(tmp_path / "t"), ["v"])
    (written,) = (tmp_path / "t").rglob("*.parquet")
    assert written.stat().st_size < 200_000
