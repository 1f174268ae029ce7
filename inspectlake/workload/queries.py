"""Registered queries: each operator over the whole of the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectlake.functions import casts, names
from inspectlake.functions.dates import day_from_path, day_from_title, day_to_text, file_stem, text_to_day
from inspectlake.operators import analysis, census, model, ranking, relations, report, search
from inspectlake.plans import inspections, measurements
from inspectlake.plans.inspections import INSPECTIONS, PARENT_COLUMNS, PARENT_SCHEMA, SUMS_SCHEMA
from inspectlake.plans.measurements import MEASUREMENT_HEADS
from inspectlake.sources import catalogue, delimited, documents, files, tables
from inspectlake.streaming import ingest
from inspectlake.workload.feeds import (
    FEED_GLOB,
    daily_inspection_feed,
    inspection_feed,
    inspection_records,
    measurement_feed,
    measurement_table,
    once,
    place_corrections,
    scratch,
    split_inspection_feed,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]

WAVE_END = date(1998, 6, 30)
VIN = "VIN42"
USER = 8


# --- document scans --------------------------------------------------------------------


def inspection_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspections.inspections(inspection_records(spark, sf_dir)).drop("soubor")


def inspection_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspections.defects(inspection_records(spark, sf_dir)).drop("soubor", "den")


def inspection_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspections.actions(inspection_records(spark, sf_dir)).drop("soubor", "den")


def inspection_adr_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspections.adr_types(inspection_records(spark, sf_dir)).drop("soubor", "den")


def measurement_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = documents.records(spark, MEASUREMENT_HEADS, measurement_feed(spark, sf_dir), FEED_GLOB)
    return records.drop("soubor")


def measurement_dtc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = documents.scan(spark, MEASUREMENT_HEADS, measurement_feed(spark, sf_dir), FEED_GLOB)
    records = measurements.shape_head(documents.sound(scanned), dtc_fallback=True)
    return records.groupBy("EmisniSystem", "Obd_PocetDtc").agg(F.count("*").alias("pocet"))


def measurement_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 1970 columns of every record, as one fingerprint per row."""
    wide = measurements.wide(measurement_table(spark, sf_dir))
    values = ", ".join(f"`{name}`" for name in measurements.wide_columns())
    return wide.selectExpr("CisloProtokolu", f"array({values}) AS hodnoty").selectExpr(
        "CisloProtokolu",
        "size(array_compact(hodnoty)) AS vyplneno",
        "md5(array_join(hodnoty, '|', '~')) AS otisk",
    )


def measurement_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements.long(measurement_table(spark, sf_dir)).drop("soubor", "den")


def measurement_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All diesel limits and the first gas tank, read through the wide view."""
    wide = measurements.wide(measurement_table(spark, sf_dir))
    chosen = [c for c in wide.columns if c.startswith(("Nafta_", "Plyn_Nadrz_")) and "Vyusteni" not in c and c != "Nafta_Palivo"]
    return wide.select("CisloProtokolu", *chosen)


def measurement_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of the long table, summed exactly per quantity."""
    typed = casts.lenient(
        measurement_long(spark, sf_dir), {"hodnota": casts.AMOUNT, "vysledek": casts.FLAG, "max_hodnota": casts.AMOUNT}
    )
    return typed.groupBy("palivo", "velicina").agg(
        F.sum("hodnota").cast("double").alias("soucet"),
        F.count_if("vysledek").alias("vyhovelo"),
        F.count("vysledek").alias("s_vysledkem"),
        F.max("max_hodnota").cast("double").alias("nejvyssi_mez"),
    )


# --- files and days --------------------------------------------------------------------


def damaged_feed(spark: SparkSession, sf_dir: str) -> str:
    """Documents without envelope, with an empty one, with an empty list and
    cut off, one per nation."""

    def write(target: str) -> None:
        number = F.col("n_nationkey")
        text = (
            F.when(number % 4 == 0, "<DatovaSada><Jine/></DatovaSada>")
            .when(number % 4 == 1, "<DatovaSada><DatovyObsah/></DatovaSada>")
            .when(number % 4 == 2, "<DatovaSada><DatovyObsah><ProhlidkaSeznam/></DatovyObsah></DatovaSada>")
            .otherwise("<DatovaSada><DatovyObsah><ProhlidkaSeznam><Prohlidka><CisloProtokolu>1")
        )
        name = F.concat(F.lit("Vadny "), number, F.lit(" 01-01-2002"))
        (
            table(spark, sf_dir, "nation")
            .select(F.coalesce(name, F.lit("-")).alias("soubor"), text.alias("value"))
            .write.partitionBy("soubor")
            .option("compression", "gzip")
            .mode("overwrite")
            .text(target)
        )

    return once(spark, sf_dir, "vadne_xml", write)


def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = (inspection_feed(spark, sf_dir), damaged_feed(spark, sf_dir))
    checked = [documents.check_documents(spark, INSPECTIONS, feed, glob=FEED_GLOB) for feed in feeds]
    return (
        checked[0]
        .unionByName(checked[1])
        .groupBy("soubor", "den", "status")
        .agg(F.sum("records").alias("zaznamu"))
    )


def file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = files.list_files(spark, inspection_feed(spark, sf_dir), FEED_GLOB)
    return files.count_files(listing.select("soubor").distinct()).withColumnRenamed("files", "dokumentu")


def ingested_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    directories = [
        inspection_feed(spark, sf_dir),
        measurement_feed(spark, sf_dir),
        scratch(spark, sf_dir, "neni"),
        damaged_feed(spark, sf_dir),
    ]
    title = lambda path: day_from_title(F.regexp_extract(path, "soubor=([^/]+)", 1))
    return files.ingested_days(spark, directories, title)


def pending_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work list: documents of the feed whose day is not among the done ones,
    here the days of every seventh order."""
    listing = files.list_files(spark, inspection_feed(spark, sf_dir), FEED_GLOB)
    done = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.to_date("o_orderdate").alias("den"))
    open_documents = files.work_list(files.pending(listing, done.distinct())).select("den", "soubor").distinct()
    # One row per document; the order of the work list is part of the result.
    return open_documents.withColumn("poradi", F.row_number().over(Window.orderBy("den", "soubor")))


def file_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days out of texts, paths and titles, some of which hold none."""
    day = F.date_format("l_shipdate", "dd-MM-yyyy")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("x"), day)).otherwise(day)
    suffix = F.when(F.col("l_linestatus") == "F", ".xml").otherwise(".xml.gz")
    items = table(spark, sf_dir, "lineitem").select(
        text.alias("text"), F.concat(F.lit("/data/Mereni SME za "), text, suffix).alias("cesta")
    )
    return items.groupBy("text", "cesta").agg(F.count("*").alias("pocet")).select(
        "text",
        "cesta",
        "pocet",
        file_stem(F.col("cesta")).alias("kmen"),
        text_to_day(F.col("text")).alias("den_textu"),
        day_from_path(F.col("cesta")).alias("den_cesty"),
        day_from_title(F.element_at(F.split("cesta", "/"), -1)).alias("den_titulku"),
        day_to_text(text_to_day(F.col("text"))).alias("zpet"),
    )


def parquet_days(spark: SparkSession, sf_dir: str) -> str:
    """``orders`` as a table with one partition per month and document."""

    def write(target: str) -> None:
        orders = table(spark, sf_dir, "orders").withColumn("den", F.trunc("o_orderdate", "month"))
        tables.write_days(orders.withColumn("soubor", F.concat(F.lit("Orders "), F.date_format("den", "yyyy"))), target)

    return once(spark, sf_dir, "dny_parquet", write)


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan under a forced schema, with a column the files lack."""
    columns = table(spark, sf_dir, "orders").schema.add("o_note", "string")
    rows = tables.read_days(spark, parquet_days(spark, sf_dir), columns)
    return rows.groupBy("den", "soubor").agg(F.count("*").alias("pocet"), F.count("o_note").alias("poznamek"))


def parquet_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable and unreadable files by document; the feed's are no parquet."""
    good = files.list_files(spark, parquet_days(spark, sf_dir), "*.parquet")
    bad = files.list_files(spark, inspection_feed(spark, sf_dir), FEED_GLOB)
    audited = files.audit_parquet(good.select("path").union(bad.select("path")))
    document = F.regexp_extract("path", "soubor=([^/]+)", 1)
    return audited.select(document.alias("soubor"), F.col("error").isNull().alias("citelny")).distinct()


# --- ingest ----------------------------------------------------------------------------


def _table_counts(spark: SparkSession, target: str) -> DataFrame:
    key = T.StructType().add("CisloProtokolu", T.StringType())
    counts = [
        tables.read_days(spark, f"{target}/{name}", key)
        .groupBy("den")
        .agg(F.count("*").alias("radku"))
        .withColumn("tabulka", F.lit(name))
        for name in INSPECTIONS.tables
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def incremental_target(spark: SparkSession, sf_dir: str) -> str:
    """Tables filled in two waves, the second of which finds the first done."""
    return _in_two_waves(spark, sf_dir, "prirustky", inspection_feed(spark, sf_dir))


def _in_two_waves(spark: SparkSession, sf_dir: str, name: str, feed: str) -> str:
    def write(target: str) -> None:
        ingest.ingest_pending(spark, INSPECTIONS, feed, target, end=WAVE_END, glob=FEED_GLOB)
        ingest.ingest_pending(spark, INSPECTIONS, feed, target, glob=FEED_GLOB)

    return once(spark, sf_dir, name, write)


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's document, brought in by two waves."""
    target = _in_two_waves(spark, sf_dir, "prirustky_denni", daily_inspection_feed(spark, sf_dir))
    return _table_counts(spark, target)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = inspection_feed(spark, sf_dir)
    target = scratch(spark, sf_dir, f"proud-{uuid.uuid4().hex}")
    ingest.ingest_stream(spark, INSPECTIONS, feed, target, f"{target}/_checkpoint", glob=FEED_GLOB)
    return _settled(spark, sf_dir, _table_counts(spark, target), target)


#: Files of a micro-batch: fewer than the parts of the feed, so documents fall into several.
SPLIT_BATCH = 60


def ingest_split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three parts, whose parts come in different micro-batches."""
    feed = split_inspection_feed(spark, sf_dir)
    target = scratch(spark, sf_dir, f"casti-{uuid.uuid4().hex}")
    ingest.ingest_stream(
        spark, INSPECTIONS, feed, target, f"{target}/_checkpoint", glob=FEED_GLOB, files_per_batch=SPLIT_BATCH
    )
    return _settled(spark, sf_dir, _table_counts(spark, target), target)


def ingest_late_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that finds the first parts of all documents only, then one that finds the rest."""
    feed = split_inspection_feed(spark, sf_dir)
    target = scratch(spark, sf_dir, f"pozde-{uuid.uuid4().hex}")
    ingest.ingest_pending(spark, INSPECTIONS, f"{feed}/soubor=*/kus=[01]", target, glob=FEED_GLOB)
    ingest.ingest_pending(spark, INSPECTIONS, feed, target, glob=FEED_GLOB)
    return _settled(spark, sf_dir, _table_counts(spark, target), target)


def _settled(spark: SparkSession, sf_dir: str, result: DataFrame, *folders: str) -> DataFrame:
    """A small result written down, after which the folders it came from can go."""
    place = scratch(spark, sf_dir, f"vysledek-{uuid.uuid4().hex}")
    result.write.parquet(place)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in folders:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(conf).delete(folder, True)
    return spark.read.schema(result.schema).parquet(place)


def ingest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.commits(spark, incremental_target(spark, sf_dir)).select("soubor", "den", "stav", "zaznamu")


def inspection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vehicle's history out of the ingested table."""
    path = f"{incremental_target(spark, sf_dir)}/prohlidky"
    history = search.vehicle_history(tables.read_days(spark, path, PARENT_SCHEMA), VIN)
    return history.select(*[name for name, _ in PARENT_COLUMNS])


def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report tables written for all days, then again for the second wave's."""
    source = f"{incremental_target(spark, sf_dir)}/prohlidky"
    target = scratch(spark, sf_dir, f"prehled-{uuid.uuid4().hex}")
    done = ingest.processed(spark, incremental_target(spark, sf_dir))
    days = [row["den"] for row in done.select("den").distinct().toLocalIterator()]
    report.refresh_report(spark, source, target, days)
    report.refresh_report(spark, source, target, [day for day in days if day > WAVE_END])
    result = spark.read.parquet(target).select("den", "kraj", "pocet", "uspech", "podil")
    return _settled(spark, sf_dir, result, target)


def _corrected_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums kept by a stream that took up all documents and then corrections of half of them."""

    def write(target: str) -> None:
        feed = scratch(spark, sf_dir, "opravovane_xml")
        for corrected in (False, True):
            place_corrections(spark, sf_dir, feed, corrected)
            ingest.ingest_stream(spark, INSPECTIONS, feed, target, f"{target}/_checkpoint", glob=FEED_GLOB)

    return tables.read_days(spark, f"{once(spark, sf_dir, 'opravene', write)}/soucty", SUMS_SCHEMA)


def report_after_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.months_of_sums(_corrected_sums(spark, sf_dir))


def stations_after_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stations_of_sums(_corrected_sums(spark, sf_dir))


# --- delimited files and search --------------------------------------------------------


def registry_csv(spark: SparkSession, sf_dir: str) -> str:
    def write(target: str) -> None:
        rows = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").cast("string"),
            "c_name",
            F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
            F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit('"'), F.col("c_name"))).otherwise("VIN").alias("c_note"),
        )
        # Some lines have fields too many, some too few.
        line = (
            F.when(F.col("c_custkey") % 3 == 0, F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment", "c_note", F.lit("x"), F.lit("y")))
            .when(F.col("c_custkey") % 3 == 1, F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment"))
            .otherwise(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment", "c_note"))
        )
        # The csv writer adds the header to every part and, without a quote or
        # escape character, leaves the line as it is.
        rows.select(line.alias("c_custkey,c_name,c_mktsegment,c_note")).write.option("header", True).option(
            "sep", "\u0001"
        ).option("quote", "\u0000").option("escapeQuotes", False).option("emptyValue", "").mode("overwrite").csv(target)

    return once(spark, sf_dir, "registr_csv", write)


NEEDLE = "Customer#00000004"


def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.scan_tolerant(spark, registry_csv(spark, sf_dir))


def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.any_column_contains(registry_scan(spark, sf_dir), NEEDLE)


def registry_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exists(registry_search(spark, sf_dir))


def csv_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device files ``…V.csv`` with different columns, stacked by name."""

    def write(target: str) -> None:
        events = table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        layouts = {
            "kind=clickV": events.where("event_type = 'click'").select("event_id", "ts", "user_id", "value"),
            "kind=errorV": events.where("event_type = 'error'").select("value", "event_id", "props"),
            "kind=restX": events.where("event_type NOT IN ('click', 'error')").select("event_id"),
        }
        for folder, rows in layouts.items():
            rows.write.option("header", True).option("sep", ";").mode("overwrite").csv(f"{target}/{folder}")

    folder = once(spark, sf_dir, "pristroje_csv", write)
    listing = files.list_files(spark, folder, "*.csv")
    chosen = delimited.with_stem_ending(listing.withColumn("path", F.regexp_replace("path", "/[^/]*$", "")), "V")
    paths = [row["path"] for row in chosen.select("path").distinct().orderBy("path").toLocalIterator()]
    return delimited.stack(spark, paths).select("event_id", "ts", "user_id", "value", "props")


def vehicle_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("user_id") == USER)
    return search.first_by(rows, [F.col("ts").asc_nulls_first(), F.col("event_id")])


def vehicle_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("user_id") == USER)
    return search.tail_of(rows, ["ts", "event_id"])


def tuple_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"l_quantity": 23.0, "l_discount": 0.05, "l_tax": 0.0, "l_linenumber": 6}
    keep = ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_shipdate"]
    return search.matching(table(spark, sf_dir, "lineitem"), values, keep)


def all_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casts.all_to_text(table(spark, sf_dir, "lineitem"))


def column_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    columns = items.columns
    renamed = names.to_ids(items, columns)
    return renamed


def lenient_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which some do not fit their type, and what the cast loses."""
    broken = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, "sedm").otherwise(F.col("l_linenumber").cast("string")).alias("cislo"),
        F.when(F.col("l_returnflag") == "A", "true")
        .when(F.col("l_returnflag") == "N", "0")
        .otherwise("mozna")
        .alias("priznak"),
        F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.col("l_quantity").cast("string")).alias("mnozstvi"),
    )
    types = {"cislo": casts.INTEGER, "priznak": casts.FLAG, "mnozstvi": casts.AMOUNT}
    typed = casts.lenient(broken, types).groupBy("cislo", "priznak").agg(
        F.count("*").alias("radku"), F.sum("mnozstvi").cast("double").alias("soucet")
    )
    return typed


def cast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What typing would lose in every typed column of the measurements."""
    return measurements.wide_losses(measurement_table(spark, sf_dir))


# --- catalogue, structure, relations ---------------------------------------------------


def catalogue_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as series, nations as datasets, suppliers as distributions."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    dataset = F.concat(F.lit("dataset/"), F.col("n_nationkey"))
    owner = F.concat(F.lit("dataset/"), F.col("s_nationkey"))
    distribution = F.concat(F.lit("dist/"), F.col("s_suppkey"))
    day = F.date_format(F.date_add(F.lit(date(2024, 1, 1)), F.col("n_nationkey")), "dd-MM-yyyy")
    nobody = F.lit(None).cast("string")

    def triple(df: DataFrame, s, p: str, o, lang=nobody) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), lang.alias("lang"))

    parts = [
        triple(nation, F.concat(F.lit("series/"), F.col("n_regionkey")), catalogue.SERIES_MEMBER, dataset),
        triple(nation, dataset, catalogue.TITLE, F.concat(F.col("n_name"), F.lit(" za "), day), F.lit("cs")),
        triple(nation, dataset, catalogue.TITLE, F.concat(F.col("n_name"), F.lit(" of "), day), F.lit("en")),
        triple(supplier, owner, catalogue.DISTRIBUTION, distribution),
        triple(supplier, distribution, catalogue.DOWNLOAD_URL, F.concat(F.lit("https://example.org/"), F.col("s_name"))),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to fetch in an interval, without the days already processed."""
    listed = catalogue.list_series(catalogue_triples(spark, sf_dir))
    events = table(spark, sf_dir, "events").where("event_type = 'error' AND hour(ts) = 3 AND value > 20")
    processed = events.select(F.to_date("ts").alias("den"))
    return catalogue.to_fetch(listed, F.lit(date(2024, 1, 3)), F.lit(date(2024, 1, 20)), processed)


def structure_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = census.scan_children(
        spark, measurement_feed(spark, sf_dir), "Mereni", "PristrojData.detailNafta.mereniVznetLimit", FEED_GLOB
    )
    return census.child_names(children)


def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = census.scan_children(
        spark, measurement_feed(spark, sf_dir), "Mereni", "PristrojData.detailNafta.mereniVznetLimit", FEED_GLOB
    )
    return census.child_counts(children)


def structure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of the inspection records."""
    return census.structure_paths(documents.record_texts(spark, "Prohlidka", inspection_feed(spark, sf_dir), FEED_GLOB))


def sampled_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census over five files chosen by seed."""
    listing = files.list_files(spark, measurement_feed(spark, sf_dir), FEED_GLOB)
    chosen = files.sample_files(listing, 5, seed=7)
    paths = [files.literal_path(row["path"]) for row in chosen.toLocalIterator()]
    children = census.scan_children(spark, paths, "Mereni", "PristrojData.detailNafta.mereniVznetLimit", FEED_GLOB)
    return census.child_names(children)


def child_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    children = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "k")
    return relations.integrity(parents, children, "k")


def childless_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    children = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    return relations.childless(parents, children, "k").select("k", "o_orderstatus")


def child_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects with their inspection, counted by severity and outcome."""
    target = incremental_target(spark, sf_dir)
    text = lambda *columns: T.StructType([T.StructField(c, T.StringType()) for c in columns])
    parents = tables.read_days(spark, f"{target}/prohlidky", text("CisloProtokolu", "Vysledek_Celkovy"))
    children = tables.read_days(spark, f"{target}/zavady", text("CisloProtokolu", "Zdroj", "Kod", "Zavaznost"))
    joined = relations.with_parent(children, parents.drop("den", "soubor"), "CisloProtokolu")
    return joined.groupBy("Zdroj", "Zavaznost", "Vysledek_Celkovy").agg(F.count("*").alias("pocet"))


# --- analysis --------------------------------------------------------------------------


def dup_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return analysis.repeated_signatures(table(spark, sf_dir, "lineitem"), values, "l_orderkey")


def run_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that agree in all values, to the whole number, with a run of another vehicle."""
    runs = measurements.runs(measurement_table(spark, sf_dir))
    found = analysis.repeated_runs(runs, "hodnoty", "Vozidlo_Vin", places=0)
    return found.drop("hodnoty")


def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["l_quantity", "l_discount", "l_tax", "l_partkey"]
    rows = analysis.rows_with_repeated_signature(table(spark, sf_dir, "lineitem"), values, "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", *values)


def station_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = analysis.station_scores(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")
    return ranking.with_rank(scores, "z")


def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = analysis.with_outlier_flags(table(spark, sf_dir, "events"), ["event_type"], "value")
    strange = flagged.where(F.col("mimo_meze") | (F.abs("robustni_z") > 3.5))
    return strange.select(
        "event_id", "event_type", "value", "median", "mad", "dolni_mez", "horni_mez", "robustni_z", "mimo_meze"
    )


def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.monthly_trend(
        table(spark, sf_dir, "orders"),
        "o_orderdate",
        ["o_orderpriority"],
        F.col("o_orderstatus") == "F",
        F.col("o_totalprice").cast("decimal(18,2)"),
    )


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("mesic"))
        .agg(F.count("*").cast("double").alias("pocet"))
    )
    return analysis.forecast(monthly, ["o_orderpriority"], "mesic", "pocet", 3)


def by_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vozidlo"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "vozidlo")
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "vozidlo")
    return analysis.by_vehicle(
        vehicles,
        "vozidlo",
        {
            "prohlidky": (
                orders,
                {"pocet": F.count("*"), "cena": F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")},
            ),
            "udalosti": (events, {"pocet": F.count("*"), "chyb": F.count_if(F.col("event_type") == "error")}),
        },
    )


_outcomes: dict[tuple[str, str], model.Outcome] = {}


def _outcome(spark: SparkSession, sf_dir: str) -> model.Outcome:
    """Fitted once per application and scale; two queries look at it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _outcomes:
        _outcomes[key] = _fit(spark, sf_dir)
    return _outcomes[key]


def _fit(spark: SparkSession, sf_dir: str) -> model.Outcome:
    items = table(spark, sf_dir, "lineitem").withColumn("vraceno", F.col("l_returnflag") == "R")
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    return model.fit_outcome(items, features, "vraceno", ["l_orderkey", "l_linenumber", "l_partkey"], iterations=5)


def outcome_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir).scores(spark)


def outcome_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be said of the fitted models without fitting them again."""
    fitted = _outcome(spark, sf_dir)
    scores = fitted.scores(spark).agg(
        F.count("*").alias("modelu"),
        F.max("trenovacich").alias("trenovacich"),
        F.max("zkusebnich").alias("zkusebnich"),
        (F.max("auc") == F.max(F.when(F.col("vybran"), F.col("auc")))).alias("vybran_nejlepsi"),
        F.min(F.col("auc").between(0.0, 1.0)).alias("auc_platne"),
    )
    shares = fitted.importances(spark).agg(
        F.count("*").alias("priznaku"),
        F.round(F.sum("dulezitost"), 6).alias("soucet_dulezitosti"),
        F.expr("array_sort(collect_list(struct(poradi, dulezitost)))").alias("s"),
    )
    falling = F.expr("forall(sequence(1, size(s) - 1), i -> s[i - 1].dulezitost >= s[i].dulezitost)")
    return scores.join(shares.select("priznaku", "soucet_dulezitosti", falling.alias("serazeno")), how="inner")


def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each feature alone ranks the held-out rows, by line status."""
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    items = table(spark, sf_dir, "lineitem").where(model.held_out(["l_orderkey", "l_linenumber", "l_partkey"]))
    values = items.select("l_linestatus", "l_returnflag", *[F.col(name).cast("double").alias(name) for name in features])
    stacked = values.unpivot(["l_linestatus", "l_returnflag"], features, "priznak", "hodnota")
    found = ranking.rank_auc(stacked, "hodnota", F.col("l_returnflag") == "R", ["priznak", "l_linestatus"])
    return found.withColumn("auc", F.round("auc", 9))


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir).importances(spark)


def defect_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("kod"))
    defects = table(spark, sf_dir, "lineitem").join(brands, "l_partkey").select(F.col("l_orderkey").alias("k"), "kod")
    outcomes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("neuspech")
    )
    return analysis.outcome_correlation(defects, outcomes, "k", "kod", "neuspech")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("bez_trojky", F.nullif(F.col("l_linenumber"), F.lit(3)))
    return analysis.profile(items, items.columns)


def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return analysis.numeric_profile(items, [name for name, kind in items.dtypes if kind in ("int", "bigint", "double")])


def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group without any value, group with some, and a text filled by mode."""
    holes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_returnflag",
        "l_quantity",
        F.when((F.col("l_linenumber") == 7) | (F.col("l_discount") == 0.05), None).otherwise(F.col("l_tax")).alias("hodnota"),
        F.when(F.col("l_quantity") < 10, None).otherwise(F.col("l_linestatus")).alias("stav"),
    )
    filled = analysis.fill_median(holes, ["l_linenumber"], "hodnota")
    return analysis.fill_mode(filled, ["l_returnflag"], "stav")


def unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {
        "prohlidky": inspections.inspections(inspection_records(spark, sf_dir)),
        "mereni": measurement_table(spark, sf_dir),
    }
    return analysis.unify({name: rows.drop("den", "soubor") for name, rows in sets.items()})


def drive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = analysis.with_drive(measurement_table(spark, sf_dir))
    return records.groupBy("pohon", "Vozidlo_Palivo").agg(F.count("*").alias("pocet"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = inspections.inspections(inspection_records(spark, sf_dir))
    chosen = records.select(
        "CisloProtokolu", F.lower("Vozidlo_Vin").alias("Vozidlo_Vin"), "Vozidlo_Druh", "Emise_CisloMotoru"
    )
    return analysis.cleaned(chosen, ["Vozidlo_Vin", "Vozidlo_Druh", "Emise_CisloMotoru"], upper=["Vozidlo_Vin"])


def limit_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    margins = analysis.limit_margins(measurement_long(spark, sf_dir))
    return margins.groupBy("palivo", "velicina").agg(
        F.count("rezerva_min").alias("s_min"),
        F.count_if(F.col("rezerva_min") < 0).alias("pod_min"),
        F.sum("rezerva_min").cast("double").alias("soucet_min"),
        F.count_if(F.col("rezerva_max") < 0).alias("nad_max"),
        F.min("rezerva_max").cast("double").alias("nejmensi_max"),
    )


def fail_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return analysis.failure_cube(items, ["l_linestatus", "l_linenumber"], F.col("l_returnflag") == "R")


def station_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    stations = (
        table(spark, sf_dir, "supplier")
        .where("s_suppkey % 10 != 3")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    )
    joined = analysis.with_station(table(spark, sf_dir, "lineitem"), stations, "l_suppkey")
    return joined.groupBy("n_name").agg(F.count("*").alias("pocet"), F.count("s_name").alias("znamych"))


REGISTERED: tuple[Query, ...] = (
    inspection_flatten,
    inspection_defects,
    inspection_actions,
    inspection_adr_types,
    measurement_head,
    measurement_dtc_fallback,
    measurement_wide,
    measurement_long,
    measurement_limits,
    measurement_typed,
    file_status,
    file_count,
    ingested_days,
    pending_days,
    file_dates,
    parquet_scan,
    parquet_audit,
    incremental_ingest,
    stream_ingest,
    ingest_split_stream,
    ingest_late_part,
    ingest_commits,
    inspection_history,
    daily_report,
    report_after_correction,
    stations_after_correction,
    registry_scan,
    registry_search,
    registry_exists,
    csv_stack,
    vehicle_history,
    vehicle_history_tail,
    tuple_match,
    all_to_text,
    column_ids,
    lenient_types,
    cast_losses,
    catalog_listing,
    structure_census,
    structure_counts,
    structure_paths,
    sampled_census,
    child_integrity,
    childless_parents,
    child_join,
    dup_signature,
    run_signature,
    dup_rows,
    station_rank,
    outliers,
    monthly_trend,
    forecast,
    by_vehicle,
    outcome_model,
    outcome_split,
    feature_auc,
    feature_importance,
    defect_corr,
    profile,
    numeric_profile,
    impute,
    unify,
    drive_split,
    clean_text,
    limit_margin,
    fail_cube,
    station_join,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in REGISTERED}
