"""Document feeds and tables derived from the supplied test tables.

Every feed row is computed from one table row by arithmetic on its keys, so
the feeds grow with the tables and an oracle can restate them in SQL.  Feeds
are written once per application and scale into the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectlake.plans.inspections import INSPECTIONS
from inspectlake.plans.measurements import (
    LIMIT_QUANTITIES,
    MEASUREMENTS,
    MONITOR_GROUPS,
    REGIME_QUANTITIES,
    REGIMES,
    RUN_QUANTITIES,
)
from inspectlake.session import prepare, shared_dir
from inspectlake.sources import documents
from inspectlake.workload.xmltext import joined, many, only_if, tag, write_feed

FEED_GLOB = "*.gz"

_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    scale = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/inspectlake/{spark.sparkContext.applicationId}/{scale}/{name}"


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a derived input, written on first use in this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        target = scratch(spark, sf_dir, name)
        write(target)
        _written[key] = target
    return _written[key]


def orders_by_month(spark: SparkSession, sf_dir: str, title: str) -> DataFrame:
    """``orders`` with the document each belongs to: one per month."""
    return _orders_in_documents(spark, sf_dir, title, F.trunc("o_orderdate", "month"))


def orders_by_day(spark: SparkSession, sf_dir: str, title: str) -> DataFrame:
    """``orders`` with the document each belongs to: one per day, as documents are published."""
    return _orders_in_documents(spark, sf_dir, title, F.col("o_orderdate"))


def _orders_in_documents(spark: SparkSession, sf_dir: str, title: str, day: Column) -> DataFrame:
    name = F.concat(F.lit(f"{title} "), F.date_format(day, "dd-MM-yyyy"))
    return table(spark, sf_dir, "orders").withColumn("soubor", name)


# --- inspections ---------------------------------------------------------------------
#
# Expressions below are SQL text over ``orders``; k and c stand for its keys.

_k = "o_orderkey"
_c = "o_custkey"
_day = "date_format(o_orderdate, 'yyyy-MM-dd')"


def _stamp(hour: str) -> str:
    return joined(_day, "'T'", f"lpad({hour}, 2, '0')", "':15:00.0000000+01:00'")


def _times(start: int) -> str:
    return tag(
        "CasoveUdaje",
        tag("Zahajeni", _stamp(f"({_k} + {start}) % 24")),
        tag("Ukonceni", _stamp(f"({_k} + {start + 1}) % 24")),
    )


def _station(shift: int) -> str:
    number = f"({_k} + {shift})"
    return tag(
        "Stanice",
        tag("Cislo", f"{number} % 100"),
        tag("Kraj", "'K'", f"{number} % 14"),
        only_if(f"{number} % 2 = 0", tag("ORP", "'O'", f"{number} % 6")),
        tag("Obec", "'Obec '", f"{number} % 50"),
    )


def _defect_list(count: str, letter: str) -> str:
    severity = tag("Zavaznost", f"substring('ABC', CAST(({_k} + n) % 3 + 1 AS int), 1)")
    defect = tag(
        "Zavada", tag("Kod", f"'{letter}'", f"({_k} + n) % 40"), only_if(f"({_k} + n) % 5 != 0", severity)
    )
    return tag("ZavadaSeznam", many(count, "n", defect))


def inspection_record() -> str:
    k, c = _k, _c
    emission = tag(
        "EmisniCast",
        tag("CisloProtokolu", "'E-'", k),
        tag("DatumProhlidky", _day),
        _station(5),
        _times(2),
        tag("OdpovednaOsoba", f"{k} % 77"),
        tag("ZakladniPalivo", f"CASE WHEN {k} % 2 = 0 THEN 'BA' ELSE 'NM' END"),
        only_if(f"{k} % 4 = 0", tag("AlternativniPalivo", "'LPG'")),
        tag("EmisniSystem", "o_orderstatus"),
        tag("VyrobceMotoru", "'V'", f"{c} % 9"),
        tag("CisloMotoru", "'-'"),
        tag("RokVyroby", f"{c} % 30 + 1990"),
    )
    adr_type = tag("TypVozidlaADR", only_if("n = 0", joined("'AT'", f"{k} % 4")))
    adr = tag(
        "AdrCast",
        _times(4),
        tag("OdpovednaOsoba", f"{k} % 33"),
        only_if(
            f"{k} % 2 = 0",
            tag("Platnost", tag("Periodicka", "'2030-01-01'"), tag("Meziperiodicka", "'2029-01-01'")),
        ),
        tag("KodCisterny", "'L4BH'"),
        tag("CisloOsvedceni", f"{k} * 7"),
        tag("ZavadyText"),
        tag("Poznamka", "'pozn '", f"{k} % 3"),
        tag("TypVozidlaADRSeznam", many(f"{k} % 3", "n", adr_type)),
    )
    action = tag(
        "KontrolniUkon",
        tag("Typ", "'U'", "n"),
        tag("Nevyhovujici", f"CASE WHEN ({k} + n) % 4 = 0 THEN 'true' ELSE 'false' END"),
    )
    tsk = tag(
        "TskCast",
        _times(5),
        tag("OdpovednaOsoba", f"{k} % 22"),
        _defect_list(f"{k} % 3", "S"),
        tag("KontrolniUkonSeznam", many(f"{k} % 6", "n", action)),
    )
    return tag(
        "Prohlidka",
        only_if(f"{k} % 97 != 1", tag("CisloProtokolu", only_if(f"{k} % 97 != 0", joined("'CZ-'", k)))),
        tag("DatumProhlidky", _day),
        only_if(f"{k} % 13 != 0", _station(0)),
        _times(0),
        tag("OdpovednaOsoba", f"{k} % 1000"),
        tag("DruhProhlidky", "o_orderpriority"),
        tag("RozsahProhlidky", only_if(f"{k} % 3 != 0", joined("'R'", f"{k} % 3"))),
        only_if(
            f"{k} % 10 = 0",
            tag("AdministrativniOprava", tag("CisloProtokolu", "'CZ-'", f"{k} - 1"), tag("DatumProhlidky", "'2001-01-01'")),
        ),
        tag(
            "Vozidlo",
            tag("Vin", "'VIN'", c),
            only_if(f"{k} % 11 = 0", tag("Vin", "'DRUHY'")),
            tag("Druh", "' osobni '"),
            tag("Kategorie", "'M'", f"{c} % 3"),
            tag("Provedeni"),
            tag("Znacka", "'Z'", f"{c} % 20"),
            tag("ObchodniOznaceni", "'A&amp;B '", f"{c} % 7"),
            tag("TypMotoru", f"{c} % 90"),
        ),
        tag(
            "Registrace",
            tag("DatumPrvniRegistrace", "'1990-01-'", f"lpad({c} % 28 + 1, 2, '0')"),
            tag("Stat", "'CZ'"),
            tag("CisloDokladu", "'D'", f"{c} * 3"),
        ),
        only_if("o_orderstatus != 'P'", emission),
        only_if(
            "o_orderstatus != 'O'",
            tag("TechnickaCast", _times(3), tag("OdpovednaOsoba", f"{k} % 55"), _defect_list(f"{k} % 4", "T")),
        ),
        only_if(f"{k} % 5 = 0", adr),
        only_if(f"{k} % 2 = 0", tsk),
        tag(
            "Vysledek",
            tag("Odometr", f"{k} % 300000"),
            only_if(f"{k} % 6 = 0", tag("Poznamka", "'bez zavad'")),
            tag("DatumPristiProhlidky", "'2002-02-02'"),
            tag("NalepkaVylepena", "CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END"),
            tag("VysledekCelkovy", "o_orderstatus"),
            _defect_list(f"{k} % 2", "V"),
        ),
    )


def inspection_feed(spark: SparkSession, sf_dir: str) -> str:
    return _inspection_feed(spark, sf_dir, "prohlidky_xml", 1, orders_by_month)


def split_inspection_feed(spark: SparkSession, sf_dir: str) -> str:
    """The same documents, each in three part files at least."""
    return _inspection_feed(spark, sf_dir, "prohlidky_casti_xml", 3, orders_by_month)


def daily_inspection_feed(spark: SparkSession, sf_dir: str) -> str:
    """The same records in one document per day."""
    return _inspection_feed(spark, sf_dir, "prohlidky_denni_xml", 1, orders_by_day)


def _inspection_feed(
    spark: SparkSession, sf_dir: str, name: str, parts: int, rows: Callable[[SparkSession, str, str], DataFrame]
) -> str:
    return once(
        spark,
        sf_dir,
        name,
        lambda target: write_feed(
            spark,
            rows(spark, sf_dir, "Prohlidky vozidel za"),
            "o_orderkey",
            inspection_record(),
            "ProhlidkaSeznam",
            "istp:opendata:schemas:ProhlidkaSeznam:v1",
            target,
            parts,
        ),
    )


def place_corrections(spark: SparkSession, sf_dir: str, feed: str, corrected: bool) -> None:
    """Inspection documents under fixed names: at first those of odd months lack
    a fifth of their records, then they are replaced by whole ones."""
    orders = orders_by_month(spark, sf_dir, "Prohlidky vozidel za")
    odd, lacking = F.month("o_orderdate") % 2 == 1, F.col("o_orderkey") % 5 == 0
    rows = orders.where(odd if corrected else ~(odd & lacking))
    written = scratch(spark, sf_dir, f"opravy-{uuid.uuid4().hex}")
    write_feed(
        spark, rows, "o_orderkey", inspection_record(), "ProhlidkaSeznam", "istp:opendata:schemas:ProhlidkaSeznam:v1", written, 1
    )
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(path(f"{written}/soubor=*/kus=*/*.gz")):
        own = status.getPath()
        folder = path(f"{feed}/{own.getParent().getParent().getName()}/{own.getParent().getName()}")
        system.mkdirs(folder)
        final = path(folder, "zaznamy.xml.gz")
        system.delete(final, False)
        system.rename(own, final)


# --- measurements --------------------------------------------------------------------
#
# A value is (31 k + 17 outlet + 7 place + 3 quantity) mod 9973, read as
# hundredths; k is the order key and the place counts regimes or runs.


def _value(outlet: str, place: str, quantity: int) -> str:
    rest = str(int(place) * 7 + quantity * 3) if place.isdigit() else f"{place} * 7 + {quantity * 3}"
    number = f"(({_k} * 31 + {outlet} * 17 + {rest}) % 9973)"
    return joined(f"{number} div 100", "'.'", f"lpad({number} % 100, 2, '0')")


def _bound(side: str, offset: int, quantity: int) -> str:
    manual = "'true'" if quantity % 2 else "'false'"
    number = f"({_k} + {quantity}) % 10 + {offset}"
    return tag(side, attributes={"hodnota": number, "rucniZadani": manual})


def _measured_tag(name: str, outlet: str, place: str, quantity: int) -> str:
    """Quantity 3 has no result, every second one a minimum, every third a maximum."""
    attributes = {"hodnota": _value(outlet, place, quantity)}
    if quantity != 3:
        attributes["vysledek"] = f"CASE WHEN ({_k} + {quantity}) % 7 = 0 THEN 'false' ELSE 'true' END"
    content = []
    if quantity % 2 == 0:
        content.append(_bound("min", 0, quantity))
    if quantity % 3 == 0:
        content.append(_bound("max", 100, quantity))
    return tag(name, *content, attributes=attributes)


_outlets = f"CASE {_k} % 10 WHEN 7 THEN 5 WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 1 END"
_runs = f"CASE WHEN {_k} % 9 = 0 THEN 6 ELSE 4 END"


def _quantity_tags(names: dict[str, str], outlet: str, place: str) -> list[str]:
    return [_measured_tag(name, outlet, place, quantity) for quantity, name in enumerate(names.values())]


def _spark_outlets() -> str:
    regimes = [
        tag(regime, *_quantity_tags(REGIME_QUANTITIES, "v", str(place))) for place, regime in enumerate(REGIMES.values())
    ]
    return many(_outlets, "v", tag("vyusteni", *regimes))


def _diesel_outlets() -> str:
    average = tag("mereniPrumer", *_quantity_tags(RUN_QUANTITIES, "v", "0"))
    runs = many(_runs, "m", tag("mereni", *_quantity_tags(RUN_QUANTITIES, "v", "(m + 1)")))
    return many(_outlets, "v", tag("vyusteni", average, runs))


def _limits() -> str:
    """The smoke-range limit (number 3) is rare, as rare elements are in feeds."""
    tags = []
    for quantity, name in enumerate(LIMIT_QUANTITIES.values()):
        both = tag(name, _bound("min", 0, quantity), _bound("max", 100, quantity))
        tags.append(only_if(f"{_k} % 50 = 1", both) if quantity == 3 else both)
    return tag("mereniVznetLimit", *tags)


def _readiness() -> str:
    groups = []
    for number, ((_, element), monitors) in enumerate(MONITOR_GROUPS.items()):
        tags = [
            tag(
                monitor,
                attributes={
                    "podporovano": f"CASE WHEN ({_k} + {place}) % 3 = 0 THEN 'true' ELSE 'false' END",
                    "otestovano": "'true'",
                },
            )
            for place, monitor in enumerate(monitors)
        ]
        groups.append(only_if(f"{_k} % 12 = {4 * number}", tag(element, *tags)))
    return tag("readiness", *groups, attributes={"vysledek": "'OK'"})


def _device() -> str:
    k, c = _k, _c
    notes = [
        only_if(f"{k} % 4 > 0", tag("poznamka", "'prvni '", k)),
        only_if(f"{k} % 4 = 2", joined(tag("poznamka"), tag("poznamka", "'druha'"))),
    ]
    instrument = {"vyrobce": "'ACME'", "typ": f"concat('T', {k} % 6)", "verze": "'-'", "OBD": "''", "verzeSoftware": "'3.05'"}
    results = {
        "vysledekVisualniKontroly": "'true'",
        "vysledekReadiness": f"{k} % 2",
        "vysledekRidiciJednotka": "''",
        "vysledekRidiciJednotkaStav": "'1'",
        "vysledekMIL": f"{k} % 3",
        "vysledekTesnostPlynovehoZarizeni": "'x'",
    }
    passed = tag("vyhovuje", attributes={"pristiProhlidka": "'2003-03-03'"})
    obd = tag(
        "rizenyOBD",
        tag("komunikacniProtokol", "'ISO '", f"{k} % 5"),
        tag("VIN", "'VIN'", c),
        tag("pocetDTC", f"{k} % 8"),
        tag("vzdalenostDTC", f"{k} % 800"),
        tag("casDTC"),
        tag("kontrolaMIL", "'true'"),
        _readiness(),
    )
    tank = {"vyrobce": "concat('N', n)", "homologace": k, "zivotnost": "'2030'", "kontrola": "''"}
    return tag(
        "PristrojData",
        only_if(
            f"{k} % 4 != 3",
            tag(
                "prohlidka",
                tag("mericiPristroj", attributes=instrument),
                *notes,
                attributes={"cisloProtokolu": f"concat('P-', {k})", "datumProhlidky": _stamp(f"{k} % 24")},
            ),
        ),
        tag(
            "vozidlo",
            tag("VIN", "'VIN'", c),
            tag("tovazniZnacka", "'Z'", f"{c} % 20"),
            tag("typVozidla", "'typ '", f"{c} % 7"),
            tag("typMotoru", f"{c} % 90"),
            tag("cisloMotoru", "'-'"),
            tag("stavTachometru", f"{k} % 300000"),
            tag("rokVyroby", f"{c} % 30 + 1990"),
            tag("datumPrvniRegistrace", "'1990-01-01'"),
            tag("palivo", f"CASE WHEN {k} % 3 = 1 THEN 'NM' ELSE 'BA' END"),
        ),
        tag(
            "vysledekMereni",
            f"CASE o_orderstatus WHEN 'F' THEN {passed} WHEN 'O' THEN {tag('vyhovuje')} ELSE '' END",
            attributes=results,
        ),
        only_if(
            f"{k} % 4 < 3",
            tag(
                "emisniSystem",
                only_if(f"{k} % 4 = 0", obd),
                only_if(f"{k} % 8 <= 1", tag("rizeny", tag("pocetDTC", f"{k} % 9"))),
                only_if(f"{k} % 4 = 2", tag("nerizeny")),
            ),
        ),
        only_if(f"{k} % 3 = 0", tag("detailBenzin", _spark_outlets(), attributes={"palivo": "'Benzin'"})),
        only_if(f"{k} % 3 = 1", tag("detailNafta", _limits(), _diesel_outlets(), attributes={"palivo": "'NM'"})),
        only_if(
            f"{k} % 3 = 2",
            tag(
                "detailPlyn",
                _spark_outlets(),
                tag("kontrolaNadrzi", many(f"{k} % 4", "n", tag("nadrz", attributes=tank))),
                attributes={"palivo": "'Plyn'"},
            ),
        ),
    )


def measurement_record() -> str:
    return tag(
        "Mereni",
        only_if(f"{_k} % 97 != 1", tag("CisloProtokolu", "'M-'", _k)),
        tag("DatumProhlidky", _day),
        tag("Stanice", tag("Cislo", f"{_k} % 100")),
        _times(0),
        tag("OdpovednaOsoba", f"{_k} % 1000"),
        _device(),
    )


def measurement_feed(spark: SparkSession, sf_dir: str) -> str:
    return once(
        spark,
        sf_dir,
        "mereni_xml",
        lambda target: write_feed(
            spark,
            orders_by_month(spark, sf_dir, "Data z mericich pristroju za"),
            "o_orderkey",
            measurement_record(),
            "MereniSeznam",
            "istp:opendata:schemas:MereniSeznam:v1",
            target,
        ),
    )


def inspection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.records(spark, INSPECTIONS, inspection_feed(spark, sf_dir), FEED_GLOB)


def measurement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.records(spark, MEASUREMENTS, measurement_feed(spark, sf_dir), FEED_GLOB)


def measurement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested table as written, the form every later query reads."""
    path = once(
        spark,
        sf_dir,
        "mereni_tabulka",
        lambda target: measurement_records(spark, sf_dir).write.mode("overwrite").parquet(target),
    )
    return spark.read.parquet(path)
