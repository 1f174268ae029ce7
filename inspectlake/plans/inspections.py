"""Inspection records: one parent row and three lists of child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectlake.functions.elements import (
    child_list,
    descend,
    element_text,
    literal,
    named,
    struct,
    text_or_null,
    value_at,
)
from inspectlake.plans.dataset import Dataset, document_columns
from inspectlake.plans.layout import fixed_table, record_schema

KEY = "CisloProtokolu"

# Parent column and the path of its element, in table order.
PARENT_COLUMNS = fixed_table("""
CisloProtokolu                        CisloProtokolu
DatumProhlidky                        DatumProhlidky
DruhProhlidky                         DruhProhlidky
RozsahProhlidky                       RozsahProhlidky
Prohlidka_OdpovednaOsoba              OdpovednaOsoba
Prohlidka_Stanice_Cislo               Stanice.Cislo
Prohlidka_Stanice_Kraj                Stanice.Kraj
Prohlidka_Stanice_ORP                 Stanice.ORP
Prohlidka_Stanice_Obec                Stanice.Obec
Prohlidka_Zahajeni                    CasoveUdaje.Zahajeni
Prohlidka_Ukonceni                    CasoveUdaje.Ukonceni
AdministrativniOprava_CisloProtokolu  AdministrativniOprava.CisloProtokolu
AdministrativniOprava_DatumProhlidky  AdministrativniOprava.DatumProhlidky
Vozidlo_Vin                           Vozidlo.Vin
Vozidlo_Druh                          Vozidlo.Druh
Vozidlo_Kategorie                     Vozidlo.Kategorie
Vozidlo_Provedeni                     Vozidlo.Provedeni
Vozidlo_Znacka                        Vozidlo.Znacka
Vozidlo_ObchodniOznaceni              Vozidlo.ObchodniOznaceni
Vozidlo_TypMotoru                     Vozidlo.TypMotoru
Registrace_DatumPrvni                 Registrace.DatumPrvniRegistrace
Registrace_Stat                       Registrace.Stat
Registrace_CisloDokladu               Registrace.CisloDokladu
Emise_CisloProtokolu                  EmisniCast.CisloProtokolu
Emise_DatumProhlidky                  EmisniCast.DatumProhlidky
Emise_Stanice_Cislo                   EmisniCast.Stanice.Cislo
Emise_Stanice_Kraj                    EmisniCast.Stanice.Kraj
Emise_Stanice_ORP                     EmisniCast.Stanice.ORP
Emise_Stanice_Obec                    EmisniCast.Stanice.Obec
Emise_Zahajeni                        EmisniCast.CasoveUdaje.Zahajeni
Emise_Ukonceni                        EmisniCast.CasoveUdaje.Ukonceni
Emise_OdpovednaOsoba                  EmisniCast.OdpovednaOsoba
Emise_ZakladniPalivo                  EmisniCast.ZakladniPalivo
Emise_AlternativniPalivo              EmisniCast.AlternativniPalivo
Emise_EmisniSystem                    EmisniCast.EmisniSystem
Emise_VyrobceMotoru                   EmisniCast.VyrobceMotoru
Emise_CisloMotoru                     EmisniCast.CisloMotoru
Emise_RokVyroby                       EmisniCast.RokVyroby
Technicka_Zahajeni                    TechnickaCast.CasoveUdaje.Zahajeni
Technicka_Ukonceni                    TechnickaCast.CasoveUdaje.Ukonceni
Technicka_OdpovednaOsoba              TechnickaCast.OdpovednaOsoba
Adr_Zahajeni                          AdrCast.CasoveUdaje.Zahajeni
Adr_Ukonceni                          AdrCast.CasoveUdaje.Ukonceni
Adr_OdpovednaOsoba                    AdrCast.OdpovednaOsoba
Adr_Platnost_Periodicka               AdrCast.Platnost.Periodicka
Adr_Platnost_Meziperiodicka           AdrCast.Platnost.Meziperiodicka
Adr_KodCisterny                       AdrCast.KodCisterny
Adr_CisloOsvedceni                    AdrCast.CisloOsvedceni
Adr_ZavadyText                        AdrCast.ZavadyText
Adr_Poznamka                          AdrCast.Poznamka
Tsk_Zahajeni                          TskCast.CasoveUdaje.Zahajeni
Tsk_Ukonceni                          TskCast.CasoveUdaje.Ukonceni
Tsk_OdpovednaOsoba                    TskCast.OdpovednaOsoba
Vysledek_Odometr                      Vysledek.Odometr
Vysledek_Poznamka                     Vysledek.Poznamka
Vysledek_DatumPristiProhlidky         Vysledek.DatumPristiProhlidky
Vysledek_NalepkaVylepena              Vysledek.NalepkaVylepena
Vysledek_Celkovy                      Vysledek.VysledekCelkovy
""")

# Parts of a record that carry a defect list; the part's name
# becomes the source of the defect.
DEFECT_SOURCES = ("TechnickaCast", "TskCast", "Vysledek")

_LIST_PATHS = [
    *[f"{part}.ZavadaSeznam.Zavada.{field}" for part in DEFECT_SOURCES for field in ("Kod", "Zavaznost")],
    "TskCast.KontrolniUkonSeznam.KontrolniUkon.Typ",
    "TskCast.KontrolniUkonSeznam.KontrolniUkon.Nevyhovujici",
    "AdrCast.TypVozidlaADRSeznam.TypVozidlaADR",
]

SCHEMA = record_schema([*(path for _, path in PARENT_COLUMNS), *_LIST_PATHS])

#: Schema to enforce when the written parent table is read.
PARENT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name, _ in PARENT_COLUMNS])


_DEFECT = "struct<Zdroj: string, Kod: string, Zavaznost: string>"


def _defects() -> str:
    """Defects of all sources in one list; a part without a list adds nothing."""

    def tagged(part: str) -> str:
        found = child_list(descend(None, part, "ZavadaSeznam"), "Zavada")
        row = struct(Zdroj=literal(part), Kod=element_text("z", "Kod"), Zavaznost=element_text("z", "Zavaznost"))
        return f"coalesce(transform({found}, z -> {row}), CAST(array() AS array<{_DEFECT}>))"

    return f"concat({', '.join(tagged(part) for part in DEFECT_SOURCES)})"


def _actions() -> str:
    found = child_list(descend(None, "TskCast", "KontrolniUkonSeznam"), "KontrolniUkon")
    row = struct(Typ=element_text("u", "Typ"), Nevyhovujici=element_text("u", "Nevyhovujici"))
    return f"transform({found}, u -> {row})"


def _adr_types() -> str:
    found = child_list(descend(None, "AdrCast", "TypVozidlaADRSeznam"), "TypVozidlaADR")
    return f"transform({found}, t -> {text_or_null('t')})"


def shape(scanned: DataFrame) -> DataFrame:
    """58 flat columns and three lists per record; records without a protocol
    number are dropped."""
    return scanned.where(f"{value_at(KEY)} IS NOT NULL").selectExpr(
        *[named(value_at(path), name) for name, path in PARENT_COLUMNS],
        named(_defects(), "zavady"),
        named(_actions(), "ukony"),
        named(_adr_types(), "adr_typy"),
        *document_columns(scanned),
    )


def inspections(records: DataFrame) -> DataFrame:
    return records.select(*[name for name, _ in PARENT_COLUMNS], *document_columns(records))


def defects(records: DataFrame) -> DataFrame:
    return records.select(KEY, *document_columns(records), F.inline("zavady")).select(
        KEY, "Zdroj", "Kod", "Zavaznost", *document_columns(records)
    )


def actions(records: DataFrame) -> DataFrame:
    return records.select(KEY, *document_columns(records), F.inline("ukony")).select(
        KEY, "Typ", "Nevyhovujici", *document_columns(records)
    )


def adr_types(records: DataFrame) -> DataFrame:
    return records.select(KEY, F.explode("adr_typy").alias("TypVozidlaADR"), *document_columns(records))


SUMS_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("kraj", "stanice")]
    + [T.StructField(name, T.LongType()) for name in ("pocet", "uspech", "oznaceno")]
)


def sums(records: DataFrame) -> DataFrame:
    """Per file, region and station: inspections, those without objection and those found unfit."""
    documents = document_columns(records)
    outcome = F.col("Vysledek_Celkovy")
    found = records.groupBy(
        *documents, F.col("Prohlidka_Stanice_Kraj").alias("kraj"), F.col("Prohlidka_Stanice_Cislo").alias("stanice")
    ).agg(F.count("*").alias("pocet"), F.count_if(outcome == "F").alias("uspech"), F.count_if(outcome == "P").alias("oznaceno"))
    # The sums of a file are few; together they are one part file.
    return found.select(*SUMS_SCHEMA.names, *documents).repartition(*documents)


INSPECTIONS = Dataset(
    name="prohlidky_vozidel",
    row_tag="Prohlidka",
    schema=SCHEMA,
    shape=shape,
    tables={"prohlidky": inspections, "zavady": defects, "ukony": actions, "adr_typy": adr_types},
    lookups=("Vozidlo_Vin",),
    sums={"soucty": sums},
)

__all__ = ["INSPECTIONS", "PARENT_COLUMNS", "PARENT_SCHEMA", "SCHEMA", "SUMS_SCHEMA"]
