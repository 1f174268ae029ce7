"""Hand-written documents; nothing here comes from Spark's XML writer."""

import gzip
from pathlib import Path

P = "istp:opendata:schemas:ProhlidkaSeznam:v1"
M = "istp:opendata:schemas:MereniSeznam:v1"
D = "istp:opendata:schemas:DatovaSada:v1"


def inspections(body: str, prefix: str = "") -> str:
    if prefix:
        return (
            f'<d:DatovaSada xmlns:d="{D}" xmlns:{prefix}="{P}"><d:DatovyObsah><{prefix}:ProhlidkaSeznam>'
            f"{body}</{prefix}:ProhlidkaSeznam></d:DatovyObsah></d:DatovaSada>"
        )
    return (
        f'<DatovaSada xmlns="{D}"><DatovyObsah><ProhlidkaSeznam xmlns="{P}">\n{body}\n'
        "</ProhlidkaSeznam></DatovyObsah></DatovaSada>"
    )


def measurements(body: str) -> str:
    return (
        f'<DatovaSada xmlns="{D}"><DatovyObsah><MereniSeznam xmlns="{M}">\n{body}\n'
        "</MereniSeznam></DatovyObsah></DatovaSada>"
    )


def put(directory: Path, name: str, text: str) -> str:
    directory.mkdir(parents=True, exist_ok=True)
    path = directory / name
    if name.endswith(".gz"):
        with gzip.open(path, "wt", encoding="utf-8") as stream:
            stream.write(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


STATION = "<Stanice><Cislo>3237</Cislo><Kraj>Praha</Kraj><ORP>ORP1</ORP><Obec>Obec1</Obec></Stanice>"


def times(start: int) -> str:
    return f"<CasoveUdaje><Zahajeni>Z{start}</Zahajeni><Ukonceni>U{start}</Ukonceni></CasoveUdaje>"


def defects(code: str) -> str:
    return f"<ZavadaSeznam><Zavada><Kod>{code}</Kod><Zavaznost>B</Zavaznost></Zavada></ZavadaSeznam>"


FULL = f"""<Prohlidka>
<CisloProtokolu>CZ-1</CisloProtokolu><DatumProhlidky>2020-01-01</DatumProhlidky>{STATION}{times(1)}
<OdpovednaOsoba>os</OdpovednaOsoba><DruhProhlidky>druh</DruhProhlidky><RozsahProhlidky>rozsah</RozsahProhlidky>
<AdministrativniOprava><CisloProtokolu>CZ-0</CisloProtokolu><DatumProhlidky>2019-12-31</DatumProhlidky></AdministrativniOprava>
<Vozidlo><Vin>VIN1</Vin><Druh>d</Druh><Kategorie>M1</Kategorie><Provedeni>p</Provedeni><Znacka>z</Znacka>
<ObchodniOznaceni>o</ObchodniOznaceni><TypMotoru>t</TypMotoru></Vozidlo>
<Registrace><DatumPrvniRegistrace>2001-01-01</DatumPrvniRegistrace><Stat>CZ</Stat><CisloDokladu>dok</CisloDokladu></Registrace>
<EmisniCast><CisloProtokolu>E-1</CisloProtokolu><DatumProhlidky>2020-01-02</DatumProhlidky>{STATION}{times(2)}
<OdpovednaOsoba>eo</OdpovednaOsoba><ZakladniPalivo>BA</ZakladniPalivo><AlternativniPalivo>LPG</AlternativniPalivo>
<EmisniSystem>R</EmisniSystem><VyrobceMotoru>vm</VyrobceMotoru><CisloMotoru>cm</CisloMotoru><RokVyroby>2000</RokVyroby></EmisniCast>
<TechnickaCast>{times(3)}<OdpovednaOsoba>to</OdpovednaOsoba>{defects("1.1")}</TechnickaCast>
<AdrCast>{times(4)}<OdpovednaOsoba>ao</OdpovednaOsoba><Platnost><Periodicka>per</Periodicka><Meziperiodicka>mez</Meziperiodicka></Platnost>
<KodCisterny>kc</KodCisterny><CisloOsvedceni>co</CisloOsvedceni><ZavadyText>zt</ZavadyText><Poznamka>ap</Poznamka>
<TypVozidlaADRSeznam><TypVozidlaADR>FL</TypVozidlaADR></TypVozidlaADRSeznam></AdrCast>
<TskCast>{times(5)}<OdpovednaOsoba>so</OdpovednaOsoba>{defects("2.2")}
<KontrolniUkonSeznam><KontrolniUkon><Typ>u1</Typ><Nevyhovujici>false</Nevyhovujici></KontrolniUkon></KontrolniUkonSeznam></TskCast>
<Vysledek><Odometr>1000</Odometr><Poznamka>vp</Poznamka><DatumPristiProhlidky>2022-01-01</DatumPristiProhlidky>
<NalepkaVylepena>true</NalepkaVylepena><VysledekCelkovy>1</VysledekCelkovy>{defects("3.3")}</Vysledek>
</Prohlidka>"""

# The 58 parent values of FULL, in column order.
FULL_ROW = (
    "CZ-1 2020-01-01 druh rozsah os 3237 Praha ORP1 Obec1 Z1 U1 CZ-0 2019-12-31 VIN1 d M1 p z o t 2001-01-01 CZ dok "
    "E-1 2020-01-02 3237 Praha ORP1 Obec1 Z2 U2 eo BA LPG R vm cm 2000 Z3 U3 to Z4 U4 ao per mez kc co zt ap "
    "Z5 U5 so 1000 vp 2022-01-01 true 1"
).split()


def simple(number: str, extra: str = "") -> str:
    return f"<Prohlidka><CisloProtokolu>{number}</CisloProtokolu>{extra}</Prohlidka>"
