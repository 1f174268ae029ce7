"""The registered queries restated in SQL over the supplied tables."""

from __future__ import annotations

from inspectlake.plans import measurements as m
from inspectlake.workload.queries import NEEDLE, USER, VIN

K, C = "o_orderkey", "o_custkey"
DAY = "strftime(o_orderdate, '%Y-%m-%d')"
MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
KEPT = f"{K} % 97 NOT IN (0, 1)"


def _pad(number: str) -> str:
    return f"lpad(CAST({number} AS VARCHAR), 2, '0')"


def _stamp(shift: int) -> str:
    return f"{DAY} || 'T' || {_pad(f'(({K} + {shift}) % 24)')} || ':15:00.0000000+01:00'"


def _text(number: str) -> str:
    return f"CAST({number} AS VARCHAR)"


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def _station(prefix: str, shift: int, condition: str) -> dict[str, str]:
    number = f"({K} + {shift})"
    return {
        f"{prefix}_Stanice_Cislo": _when(condition, _text(f"{number} % 100")),
        f"{prefix}_Stanice_Kraj": _when(condition, f"'K' || {number} % 14"),
        f"{prefix}_Stanice_ORP": _when(f"{condition} AND {number} % 2 = 0", f"'O' || {number} % 6"),
        f"{prefix}_Stanice_Obec": _when(condition, f"'Obec ' || {number} % 50"),
    }


def _times(prefix: str, shift: int, condition: str = "true") -> dict[str, str]:
    return {
        f"{prefix}_Zahajeni": _when(condition, _stamp(shift)),
        f"{prefix}_Ukonceni": _when(condition, _stamp(shift + 1)),
    }


def inspection_columns() -> dict[str, str]:
    emission, technical, adr, tsk = "o_orderstatus <> 'P'", "o_orderstatus <> 'O'", f"{K} % 5 = 0", f"{K} % 2 = 0"
    return {
        "CisloProtokolu": f"'CZ-' || {K}",
        "DatumProhlidky": DAY,
        "DruhProhlidky": "o_orderpriority",
        "RozsahProhlidky": _when(f"{K} % 3 <> 0", f"'R' || {K} % 3"),
        "Prohlidka_OdpovednaOsoba": _text(f"{K} % 1000"),
        **_station("Prohlidka", 0, f"{K} % 13 <> 0"),
        **_times("Prohlidka", 0),
        "AdministrativniOprava_CisloProtokolu": _when(f"{K} % 10 = 0", f"'CZ-' || ({K} - 1)"),
        "AdministrativniOprava_DatumProhlidky": _when(f"{K} % 10 = 0", "'2001-01-01'"),
        "Vozidlo_Vin": f"'VIN' || {C}",
        "Vozidlo_Druh": "' osobni '",
        "Vozidlo_Kategorie": f"'M' || {C} % 3",
        "Vozidlo_Provedeni": "CAST(NULL AS VARCHAR)",
        "Vozidlo_Znacka": f"'Z' || {C} % 20",
        "Vozidlo_ObchodniOznaceni": f"'A&B ' || {C} % 7",
        "Vozidlo_TypMotoru": _text(f"{C} % 90"),
        "Registrace_DatumPrvni": f"'1990-01-' || {_pad(f'({C} % 28 + 1)')}",
        "Registrace_Stat": "'CZ'",
        "Registrace_CisloDokladu": f"'D' || {C} * 3",
        "Emise_CisloProtokolu": _when(emission, f"'E-' || {K}"),
        "Emise_DatumProhlidky": _when(emission, DAY),
        **_station("Emise", 5, emission),
        **_times("Emise", 2, emission),
        "Emise_OdpovednaOsoba": _when(emission, _text(f"{K} % 77")),
        "Emise_ZakladniPalivo": _when(emission, f"CASE WHEN {K} % 2 = 0 THEN 'BA' ELSE 'NM' END"),
        "Emise_AlternativniPalivo": _when(f"{emission} AND {K} % 4 = 0", "'LPG'"),
        "Emise_EmisniSystem": _when(emission, "o_orderstatus"),
        "Emise_VyrobceMotoru": _when(emission, f"'V' || {C} % 9"),
        "Emise_CisloMotoru": _when(emission, "'-'"),
        "Emise_RokVyroby": _when(emission, _text(f"{C} % 30 + 1990")),
        **_times("Technicka", 3, technical),
        "Technicka_OdpovednaOsoba": _when(technical, _text(f"{K} % 55")),
        **_times("Adr", 4, adr),
        "Adr_OdpovednaOsoba": _when(adr, _text(f"{K} % 33")),
        "Adr_Platnost_Periodicka": _when(f"{adr} AND {K} % 2 = 0", "'2030-01-01'"),
        "Adr_Platnost_Meziperiodicka": _when(f"{adr} AND {K} % 2 = 0", "'2029-01-01'"),
        "Adr_KodCisterny": _when(adr, "'L4BH'"),
        "Adr_CisloOsvedceni": _when(adr, _text(f"{K} * 7")),
        "Adr_ZavadyText": "CAST(NULL AS VARCHAR)",
        "Adr_Poznamka": _when(adr, f"'pozn ' || {K} % 3"),
        **_times("Tsk", 5, tsk),
        "Tsk_OdpovednaOsoba": _when(tsk, _text(f"{K} % 22")),
        "Vysledek_Odometr": _text(f"{K} % 300000"),
        "Vysledek_Poznamka": _when(f"{K} % 6 = 0", "'bez zavad'"),
        "Vysledek_DatumPristiProhlidky": "'2002-02-02'",
        "Vysledek_NalepkaVylepena": "CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END",
        "Vysledek_Celkovy": "o_orderstatus",
    }


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f'{value} AS "{name}"' for name, value in columns.items())


def _defects(extra: str = "") -> str:
    parts = [
        ("TechnickaCast", "T", "o_orderstatus <> 'O'", 4),
        ("TskCast", "S", f"{K} % 2 = 0", 3),
        ("Vysledek", "V", "true", 2),
    ]
    return " UNION ALL ".join(
        f"""SELECT 'CZ-' || {K} AS "CisloProtokolu", '{part}' AS "Zdroj", '{letter}' || ({K} + n) % 40 AS "Kod",
            CASE WHEN ({K} + n) % 5 <> 0 THEN substring('ABC', CAST(({K} + n) % 3 + 1 AS INT), 1) END AS "Zavaznost"
            {extra}
        FROM orders, range(0, {modulus}) AS r(n) WHERE {KEPT} AND {condition} AND n < {K} % {modulus}"""
        for part, letter, condition, modulus in parts
    )


def _actions(extra: str = "") -> str:
    return f"""SELECT 'CZ-' || {K} AS "CisloProtokolu", 'U' || n AS "Typ",
            CASE WHEN ({K} + n) % 4 = 0 THEN 'true' ELSE 'false' END AS "Nevyhovujici" {extra}
        FROM orders, range(0, 6) AS r(n) WHERE {KEPT} AND {K} % 2 = 0 AND n < {K} % 6"""


def _adr_types(extra: str = "") -> str:
    return f"""SELECT 'CZ-' || {K} AS "CisloProtokolu", CASE WHEN n = 0 THEN 'AT' || {K} % 4 END AS "TypVozidlaADR" {extra}
        FROM orders, range(0, 3) AS r(n) WHERE {KEPT} AND {K} % 5 = 0 AND n < {K} % 3"""


# --- measurements --------------------------------------------------------------------

PROTOCOL = _when(f"{K} % 97 <> 1", f"'M-' || {K}")
OUTLETS = f"(CASE {K} % 10 WHEN 7 THEN 5 WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 1 END)"
RUNS = f"(CASE WHEN {K} % 9 = 0 THEN 6 ELSE 4 END)"
OBD = f"{K} % 4 = 0"
NULL = "CAST(NULL AS VARCHAR)"


def measurement_head_columns() -> dict[str, str]:
    inspected = f"{K} % 4 <> 3"
    notes = (
        f"CASE {K} % 4 WHEN 0 THEN '' WHEN 1 THEN 'prvni ' || {K} "
        f"WHEN 2 THEN 'prvni ' || {K} || chr(10) || 'druha' END"
    )
    return {
        "CisloProtokolu": PROTOCOL,
        "DatumProhlidky": DAY,
        "StaniceCislo": _text(f"{K} % 100"),
        "Zahajeni": _stamp(0),
        "Ukonceni": _stamp(1),
        "OdpovednaOsoba": _text(f"{K} % 1000"),
        "Prohlidka_CisloProtokolu": _when(inspected, f"'P-' || {K}"),
        "Prohlidka_DatumProhlidky": _when(inspected, _stamp(0)),
        "MericiPristroj_Vyrobce": _when(inspected, "'ACME'"),
        "MericiPristroj_Typ": _when(inspected, f"'T' || {K} % 6"),
        "MericiPristroj_Verze": _when(inspected, "'-'"),
        "MericiPristroj_OBD": _when(inspected, "''"),
        "MericiPristroj_VerzeSoftware": _when(inspected, "'3.05'"),
        "Poznamky": notes,
        "Vozidlo_Vin": f"'VIN' || {C}",
        "Vozidlo_Znacka": f"'Z' || {C} % 20",
        "Vozidlo_ObchodniOznaceni": f"'typ ' || {C} % 7",
        "Vozidlo_TypMotoru": _text(f"{C} % 90"),
        "Vozidlo_CisloMotoru": "'-'",
        "Vozidlo_Odometer": _text(f"{K} % 300000"),
        "Vozidlo_RokVyroby": _text(f"{C} % 30 + 1990"),
        "Vozidlo_DatumPrvniRegistrace": "'1990-01-01'",
        "Vozidlo_Palivo": f"CASE WHEN {K} % 3 = 1 THEN 'NM' ELSE 'BA' END",
        "Vysledek_VisualniKontrola": "'true'",
        "Vysledek_Readiness": _text(f"{K} % 2"),
        "Vysledek_RidiciJednotka": "''",
        "Vysledek_RidiciJednotkaStav": "'1'",
        "Vysledek_Mil": _text(f"{K} % 3"),
        "Vysledek_TesnostPlynovehoZarizeni": "'x'",
        "Vysledek_Vyhovuje": _when("o_orderstatus IN ('F', 'O')", "'true'"),
        "PristiProhlidka": _when("o_orderstatus = 'F'", "'2003-03-03'"),
        "EmisniSystem": f"CASE {K} % 4 WHEN 0 THEN 'Rizeny_Obd' WHEN 1 THEN CASE WHEN {K} % 8 = 1 THEN 'Rizeny' END "
        "WHEN 2 THEN 'Nerizeny' END",
        "Obd_KomunikacniProtokol": _when(OBD, f"'ISO ' || {K} % 5"),
        "Obd_Vin": _when(OBD, f"'VIN' || {C}"),
        "Obd_PocetDtc": _when(OBD, _text(f"{K} % 8")),
        "Obd_VzdalenostDtc": _when(OBD, _text(f"{K} % 800")),
        "Obd_CasDtc": NULL,
        "Obd_KontrolaMil": _when(OBD, "'true'"),
        "Obd_Readiness_Vysledek": _when(OBD, "'OK'"),
    }


def _value(outlet: str | int, place: str | int, quantity: str | int) -> str:
    number = f"(({K} * 31 + {outlet} * 17 + {place} * 7 + {quantity} * 3) % 9973)"
    return f"({number} // 100) || '.' || {_pad(f'({number} % 100)')}"


def _sextet(outlet: int, place: int, quantity: int, condition: str) -> list[str]:
    """The six columns of a measured quantity, in order."""
    manual = "'true'" if quantity % 2 else "'false'"
    low = quantity % 2 == 0
    high = quantity % 3 == 0
    judged = f"CASE WHEN ({K} + {quantity}) % 7 = 0 THEN 'false' ELSE 'true' END"
    return [
        _when(condition, _value(outlet, place, quantity)),
        _when(condition, judged) if quantity != 3 else NULL,
        _when(condition, _text(f"({K} + {quantity}) % 10")) if low else NULL,
        _when(condition, manual) if low else NULL,
        _when(condition, _text(f"({K} + {quantity}) % 10 + 100")) if high else NULL,
        _when(condition, manual) if high else NULL,
    ]


def _limit_values() -> list[str]:
    values = []
    for quantity in range(len(m.LIMIT_QUANTITIES)):
        condition = f"{K} % 3 = 1" + (f" AND {K} % 50 = 1" if quantity == 3 else "")
        manual = "'true'" if quantity % 2 else "'false'"
        for offset in (0, 100):
            values += [_when(condition, _text(f"({K} + {quantity}) % 10 + {offset}")), _when(condition, manual)]
    return values


def _spark_values(remainder: int, fuel: str) -> list[str]:
    values = [_when(f"{K} % 3 = {remainder}", f"'{fuel}'")]
    for slot in range(4):
        condition = f"{K} % 3 = {remainder} AND {OUTLETS} > {slot}"
        for place in range(len(m.REGIMES)):
            for quantity in range(len(m.REGIME_QUANTITIES)):
                values += _sextet(slot, place, quantity, condition)
    return values


def _diesel_values() -> list[str]:
    values = [_when(f"{K} % 3 = 1", "'NM'"), *_limit_values()]
    for slot in range(4):
        for place in range(5):  # the average, then four runs, which every record has
            for quantity in range(len(m.RUN_QUANTITIES)):
                values += _sextet(slot, place, quantity, f"{K} % 3 = 1 AND {OUTLETS} > {slot}")
    return values


def _wide_values() -> list[str]:
    values = list(measurement_head_columns().values())
    for number, monitors in enumerate(m.MONITOR_GROUPS.values()):
        condition = f"{OBD} AND {K} % 12 = {4 * number}"
        for place in range(len(monitors)):
            supported = f"CASE WHEN ({K} + {place}) % 3 = 0 THEN 'true' ELSE 'false' END"
            values += [_when(condition, supported), _when(condition, "'true'")]
    values += _spark_values(0, "Benzin")
    values += _diesel_values()
    values += _spark_values(2, "Plyn")
    tank = f"{K} % 3 = 2 AND {K} % 4 > 0"
    return values + [_when(tank, "'N0'"), _when(tank, _text(K)), _when(tank, "'2030'"), _when(tank, "''")]


def measurement_wide() -> str:
    """Every value of a row in one list, from which count and digest follow."""
    values = ", ".join(f"CAST({value} AS VARCHAR)" for value in _wide_values())
    return f"""WITH w AS (SELECT {PROTOCOL} AS p, [{values}] AS v FROM orders)
        SELECT p AS "CisloProtokolu", CAST(len(list_filter(v, lambda x: x IS NOT NULL)) AS INT) AS vyplneno,
            md5(array_to_string(list_transform(v, lambda x: coalesce(x, '~')), '|')) AS otisk FROM w"""


def structure_paths() -> str:
    """Paths of the inspection records by block, each with the rows that have it."""
    blocks: list[tuple[str, str, str]] = [
        ("Prohlidka", "true", """. DatumProhlidky CasoveUdaje CasoveUdaje/Zahajeni CasoveUdaje/Ukonceni OdpovednaOsoba DruhProhlidky RozsahProhlidky
            Vozidlo Vozidlo/Vin Vozidlo/Druh Vozidlo/Kategorie Vozidlo/Provedeni Vozidlo/Znacka Vozidlo/ObchodniOznaceni
            Vozidlo/TypMotoru Registrace Registrace/DatumPrvniRegistrace Registrace/Stat Registrace/CisloDokladu
            Vysledek Vysledek/Odometr Vysledek/DatumPristiProhlidky Vysledek/NalepkaVylepena Vysledek/VysledekCelkovy"""),
        ("Prohlidka", f"{K} % 97 <> 1", "CisloProtokolu"),
        ("Prohlidka", f"{K} % 6 = 0", "Vysledek/Poznamka"),
        ("Prohlidka/AdministrativniOprava", f"{K} % 10 = 0", ". CisloProtokolu DatumProhlidky"),
        ("Prohlidka/EmisniCast", "o_orderstatus <> 'P'", """. CisloProtokolu DatumProhlidky CasoveUdaje CasoveUdaje/Zahajeni
            CasoveUdaje/Ukonceni OdpovednaOsoba ZakladniPalivo EmisniSystem VyrobceMotoru CisloMotoru RokVyroby"""),
        ("Prohlidka/EmisniCast", f"o_orderstatus <> 'P' AND {K} % 4 = 0", "AlternativniPalivo"),
        ("Prohlidka/TechnickaCast", "o_orderstatus <> 'O'", ". CasoveUdaje CasoveUdaje/Zahajeni CasoveUdaje/Ukonceni OdpovednaOsoba"),
        ("Prohlidka/AdrCast", f"{K} % 5 = 0", """. CasoveUdaje CasoveUdaje/Zahajeni CasoveUdaje/Ukonceni OdpovednaOsoba KodCisterny
            CisloOsvedceni ZavadyText Poznamka TypVozidlaADRSeznam"""),
        ("Prohlidka/AdrCast", f"{K} % 10 = 0", "Platnost Platnost/Periodicka Platnost/Meziperiodicka"),
        ("Prohlidka/AdrCast", f"{K} % 5 = 0 AND {K} % 3 > 0", "TypVozidlaADRSeznam/TypVozidlaADR"),
        ("Prohlidka/TskCast", f"{K} % 2 = 0", ". CasoveUdaje CasoveUdaje/Zahajeni CasoveUdaje/Ukonceni OdpovednaOsoba KontrolniUkonSeznam"),
        ("Prohlidka/TskCast/KontrolniUkonSeznam", f"{K} % 2 = 0 AND {K} % 6 > 0", "KontrolniUkon KontrolniUkon/Typ KontrolniUkon/Nevyhovujici"),
    ]
    for part, shift, condition in (("Prohlidka", 0, f"{K} % 13 <> 0"), ("Prohlidka/EmisniCast", 5, "o_orderstatus <> 'P'")):
        blocks.append((f"{part}/Stanice", condition, ". Cislo Kraj Obec"))
        blocks.append((f"{part}/Stanice", f"{condition} AND ({K} + {shift}) % 2 = 0", "ORP"))
    for part, condition, modulus in (("TechnickaCast", "o_orderstatus <> 'O'", 4), ("TskCast", f"{K} % 2 = 0", 3), ("Vysledek", "true", 2)):
        count = f"{K} % {modulus}"
        severe = " OR ".join(f"({n} < {count} AND ({K} + {n}) % 5 <> 0)" for n in range(modulus - 1))
        blocks.append((f"Prohlidka/{part}", condition, "ZavadaSeznam"))
        blocks.append((f"Prohlidka/{part}/ZavadaSeznam", f"{condition} AND {count} > 0", "Zavada Zavada/Kod"))
        blocks.append((f"Prohlidka/{part}/ZavadaSeznam", f"{condition} AND ({severe})", "Zavada/Zavaznost"))
    counted = " UNION ALL ".join(
        f"""SELECT unnest([{", ".join(f"'{block}'" if name == "." else f"'{block}/{name}'" for name in names.split())}]) AS cesta,
        zaznamu, souboru FROM (SELECT count(*) AS zaznamu, count(DISTINCT date_trunc('month', o_orderdate)) AS souboru
        FROM orders WHERE {condition})"""
        for block, condition, names in blocks
    )
    return f"SELECT cesta, zaznamu, souboru FROM ({counted}) WHERE zaznamu > 0"


def _named(names) -> str:
    return "(VALUES " + ", ".join(f"('{name}', {number})" for number, name in enumerate(names)) + ")"


def measurement_long() -> str:
    columns = f"""
        CASE WHEN q <> 3 THEN CASE WHEN ({K} + q) % 7 = 0 THEN 'false' ELSE 'true' END END AS vysledek,
        CASE WHEN q % 2 = 0 THEN CAST(({K} + q) % 10 AS VARCHAR) END AS min_hodnota,
        CASE WHEN q % 2 = 0 THEN 'false' END AS min_rucni,
        CASE WHEN q % 3 = 0 THEN CAST(({K} + q) % 10 + 100 AS VARCHAR) END AS max_hodnota,
        CASE WHEN q % 3 = 0 THEN CASE q % 2 WHEN 1 THEN 'true' ELSE 'false' END END AS max_rucni"""
    # A diesel record states limits for the first five quantities of a run; the
    # fourth of its six limits is of none of them.
    stated = f"({K} + q + CASE WHEN q > 2 THEN 1 ELSE 0 END) % 10"
    limits = f"""CASE WHEN q < 5 THEN CAST({stated} AS VARCHAR) END AS min_zaznamu,
        CASE WHEN q < 5 THEN CAST({stated} + 100 AS VARCHAR) END AS max_zaznamu"""
    spark = f"""SELECT {PROTOCOL} AS "CisloProtokolu",
            CASE {K} % 3 WHEN 0 THEN 'Benzin' ELSE 'Plyn' END AS palivo, CAST(v AS INT) AS vyusteni, rezim,
            CAST(NULL AS INT) AS beh, velicina, {_value("v", "r", "q")} AS hodnota, {columns},
            CAST(NULL AS VARCHAR) AS min_zaznamu, CAST(NULL AS VARCHAR) AS max_zaznamu
        FROM orders, range(0, 5) AS a(v), {_named(m.REGIMES)} AS b(rezim, r), {_named(m.REGIME_QUANTITIES)} AS c(velicina, q)
        WHERE {K} % 3 <> 1 AND v < {OUTLETS}"""
    diesel = f"""SELECT {PROTOCOL} AS "CisloProtokolu", 'Nafta' AS palivo, CAST(v AS INT) AS vyusteni,
            CASE WHEN r = 0 THEN 'MereniPrumer' ELSE 'Mereni' END AS rezim,
            CASE WHEN r > 0 THEN CAST(r - 1 AS INT) END AS beh, velicina, {_value("v", "r", "q")} AS hodnota, {columns}, {limits}
        FROM orders, range(0, 5) AS a(v), range(0, 7) AS b(r), {_named(m.RUN_QUANTITIES)} AS c(velicina, q)
        WHERE {K} % 3 = 1 AND v < {OUTLETS} AND r <= {RUNS}"""
    return f"{spark} UNION ALL {diesel}"


def run_signature() -> str:
    """Runs (averages left out) by their values rounded to whole numbers."""
    keys = f"""{K} AS k, {PROTOCOL} AS "CisloProtokolu", 'VIN' || {C} AS "Vozidlo_Vin", CAST(v AS INT) AS vyusteni"""
    each = f"velicina || '=' || round(CAST({_value('v', 'r', 'q')} AS DECIMAL(18, 6)))"
    spark = f"""SELECT {keys}, CASE {K} % 3 WHEN 0 THEN 'Benzin' ELSE 'Plyn' END AS palivo, rezim, CAST(NULL AS INT) AS beh, {each} AS x
        FROM orders, range(0, 5) AS a(v), {_named(m.REGIMES)} AS b(rezim, r), {_named(m.REGIME_QUANTITIES)} AS c(velicina, q)
        WHERE {K} % 3 <> 1 AND v < {OUTLETS}"""
    diesel = f"""SELECT {keys}, 'Nafta' AS palivo, 'Mereni' AS rezim, CAST(r - 1 AS INT) AS beh, {each} AS x
        FROM orders, range(0, 5) AS a(v), range(1, 7) AS b(r), {_named(m.RUN_QUANTITIES)} AS c(velicina, q)
        WHERE {K} % 3 = 1 AND v < {OUTLETS} AND r <= {RUNS}"""
    return f"""WITH r AS (
            SELECT "CisloProtokolu", "Vozidlo_Vin", palivo, vyusteni, rezim, beh, list(x ORDER BY x) AS podpis
            FROM ({spark} UNION ALL {diesel}) GROUP BY k, "CisloProtokolu", "Vozidlo_Vin", palivo, vyusteni, rezim, beh),
        g AS (SELECT podpis, count(*) AS radku, count(DISTINCT "Vozidlo_Vin") AS vozidel FROM r GROUP BY podpis)
        SELECT "CisloProtokolu", "Vozidlo_Vin", palivo, vyusteni, rezim, beh, radku, vozidel
        FROM r JOIN g USING (podpis) WHERE vozidel > 1"""


def _cast_losses() -> str:
    """Results are the words true and false, which a number type loses; all
    other typed columns hold what their type allows."""
    columns = dict(zip(m.wide_columns(), _wide_values(), strict=True))
    types = m.wide_types()
    counts = ", ".join(f"count({columns[name]}) AS p{i}" for i, name in enumerate(types))
    rows = ", ".join(f"('{name}', '{target}', {i})" for i, (name, target) in enumerate(types.items()))
    picked = ", ".join(f"p{i}" for i in range(len(types)))
    return f"""WITH c AS (SELECT {counts} FROM orders), l AS (SELECT [{picked}] AS p FROM c)
        SELECT n.name AS column_name, n.target AS target_type, l.p[n.i + 1] AS present,
        CASE WHEN suffix(n.name, '_Vysledek') THEN l.p[n.i + 1] ELSE 0 END AS lost
        FROM (VALUES {rows}) AS n(name, target, i), l"""


# --- oracles ---------------------------------------------------------------------------


def _statuses() -> str:
    title = "'Prohlidky vozidel za ' || strftime(date_trunc('month', o_orderdate), '%d-%m-%Y')"
    return f"""SELECT {title} AS soubor, {MONTH} AS den, 'ok' AS status, count(*) AS zaznamu FROM orders GROUP BY ALL
        UNION ALL
        SELECT 'Vadny ' || n_nationkey || ' 01-01-2002', DATE '2002-01-01',
            CASE n_nationkey % 4 WHEN 2 THEN 'ok' WHEN 3 THEN 'damaged' ELSE 'no_envelope' END, 0
        FROM nation"""


def _table_counts(day: str = MONTH) -> str:
    den = f", {day} AS den"
    parts = {
        "prohlidky": f"SELECT {day} AS den FROM orders WHERE {KEPT}",
        "zavady": _defects(den),
        "ukony": _actions(den),
        "adr_typy": _adr_types(den),
    }
    return " UNION ALL ".join(
        f"SELECT den, count(*) AS radku, '{name}' AS tabulka FROM ({part}) GROUP BY den" for name, part in parts.items()
    )


def _document_names() -> str:
    return f"""SELECT DISTINCT {MONTH} AS den,
        'Prohlidky vozidel za ' || strftime(date_trunc('month', o_orderdate), '%d-%m-%Y') AS soubor FROM orders"""


FILE_DATES = """
WITH i AS (
    SELECT CASE WHEN l_linenumber = 1 THEN 'x' ELSE '' END || strftime(l_shipdate, '%d-%m-%Y') AS text,
        CASE WHEN l_linestatus = 'F' THEN '.xml' ELSE '.xml.gz' END AS pripona FROM lineitem
), g AS (SELECT text, pripona, count(*) AS pocet FROM i GROUP BY ALL),
d AS (SELECT *, CAST(try_strptime(text, '%d-%m-%Y') AS DATE) AS den FROM g)
SELECT text, '/data/Mereni SME za ' || text || pripona AS cesta, pocet,
    'Mereni SME za ' || text || CASE WHEN pripona = '.xml' THEN '' ELSE '.xml' END AS kmen,
    den AS den_textu, CASE WHEN pripona = '.xml' THEN den END AS den_cesty, den AS den_titulku,
    strftime(den, '%d-%m-%Y') AS zpet FROM d
"""

REGISTRY = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment,
    CASE WHEN c_custkey % 3 <> 1 THEN CASE WHEN c_custkey % 7 = 0 THEN '"' || c_name ELSE 'VIN' END END AS c_note
FROM customer
"""

_FOUND = " OR ".join(
    f"coalesce(contains({name}, '{NEEDLE}'), false)" for name in ("c_custkey", "c_name", "c_mktsegment", "c_note")
)

LENIENT = """
SELECT CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS cislo,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS priznak,
    count(*) AS radku,
    CAST(sum(CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS DECIMAL(18, 6)) END) AS DOUBLE) AS soucet
FROM lineitem GROUP BY 1, 2
"""

CATALOG = """
SELECT 'series/' || n_regionkey AS series, n_name || ' za ' || strftime(DATE '2024-01-01' + n_nationkey, '%d-%m-%Y') AS title,
    'https://example.org/' || s_name AS url, CAST(DATE '2024-01-01' + n_nationkey AS DATE) AS den
FROM nation JOIN supplier ON s_nationkey = n_nationkey
WHERE DATE '2024-01-01' + n_nationkey BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
    AND DATE '2024-01-01' + n_nationkey NOT IN (
        SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error' AND hour(ts) = 3 AND value > 20)
"""

STATION_RANK = """
WITH s AS (SELECT l_suppkey, count(*) AS pocet, count(*) FILTER (l_returnflag = 'R') AS oznaceno FROM lineitem GROUP BY 1),
t AS (SELECT sum(oznaceno)::DOUBLE / sum(pocet) AS p FROM s),
z AS (SELECT l_suppkey, pocet, oznaceno, round(oznaceno / pocet, 6) AS podil, round(p, 6) AS podil_celkem,
    round((oznaceno / pocet - p) / sqrt(p * (1 - p) / pocet), 6) AS z FROM s, t)
SELECT *, rank() OVER (ORDER BY z DESC) AS poradi FROM z
"""

HELD_OUT = "(('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey)), 1, 8))::BIGINT % 5 = 0)"

OUTLIERS = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
e AS (SELECT event_id, events.event_type, value, median, round(q1 - 1.5 * (q3 - q1), 6) AS dolni_mez,
    round(q3 + 1.5 * (q3 - q1), 6) AS horni_mez, round(abs(value - median), 6) AS d
    FROM events JOIN q USING (event_type)),
m AS (SELECT event_type, quantile_cont(d, 0.5) AS mad FROM e GROUP BY 1),
f AS (SELECT event_id, e.event_type, value, median, mad, dolni_mez, horni_mez,
    CASE WHEN mad > 0 THEN round(0.6745 * (value - median) / mad, 6) END AS robustni_z,
    value < dolni_mez OR value > horni_mez AS mimo_meze FROM e JOIN m USING (event_type))
SELECT * FROM f WHERE mimo_meze OR abs(robustni_z) > 3.5
"""

MONTHLY = """
WITH t AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS mesic, count(*) AS pocet,
    count(*) FILTER (o_orderstatus = 'F') AS f, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS s FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, mesic, pocet, round(f / pocet, 6) AS podil, round(CAST(s AS DOUBLE) / pocet, 4) AS prumer,
    pocet - lag(pocet) OVER w AS zmena,
    round(avg(pocet) OVER (PARTITION BY o_orderpriority ORDER BY mesic ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)
        AS klouzavy_prumer
FROM t WINDOW w AS (PARTITION BY o_orderpriority ORDER BY mesic)
"""

FORECAST = """
WITH t AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS mesic,
    CAST(count(*) AS DOUBLE) AS pocet FROM orders GROUP BY 1, 2),
r AS (SELECT o_orderpriority, regr_slope(pocet, year(mesic) * 12 + month(mesic)) AS a,
    regr_intercept(pocet, year(mesic) * 12 + month(mesic)) AS b, max(mesic) AS posledni FROM t GROUP BY 1),
f AS (SELECT o_orderpriority, CAST(posledni + to_months(CAST(n AS INT)) AS DATE) AS mesic, a, b FROM r, range(1, 4) AS x(n))
SELECT o_orderpriority, mesic, round(b + a * (year(mesic) * 12 + month(mesic)), 4) AS odhad FROM f
"""

BY_VEHICLE = """
WITH o AS (SELECT o_custkey AS v, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS s
    FROM orders GROUP BY 1),
e AS (SELECT user_id AS v, count(*) AS n, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY 1)
SELECT c_custkey AS vozidlo, c_mktsegment, o.n AS prohlidky_pocet, o.s AS prohlidky_cena, e.n AS udalosti_pocet,
    e.c AS udalosti_chyb
FROM customer LEFT JOIN o ON o.v = c_custkey LEFT JOIN e ON e.v = c_custkey
"""

DEFECT_CORR = """
WITH d AS (SELECT DISTINCT l_orderkey AS k, p_brand AS kod FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS f FROM orders),
c AS (SELECT kod, count(*) AS s_kodem, count(*) FILTER (o_orderstatus = 'F') AS s_kodem_neuspech
    FROM d JOIN orders ON o_orderkey = k GROUP BY 1)
SELECT kod, s_kodem, s_kodem_neuspech, round((n * s_kodem_neuspech - s_kodem * f)
    / (sqrt(CAST(s_kodem AS DOUBLE)) * sqrt(n - s_kodem) * sqrt(f) * sqrt(n - f)), 6) AS phi FROM c, t
"""


def _profile() -> str:
    names = """l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag
        l_linestatus l_shipdate""".split()
    columns = {name: name for name in names} | {"bez_trojky": "nullif(l_linenumber, 3)"}
    stacked = " UNION ALL ".join(
        f"SELECT '{name}' AS sloupec, CAST({value} AS VARCHAR) AS hodnota FROM lineitem" for name, value in columns.items()
    )
    ends = " UNION ALL ".join(
        f"""SELECT '{name}' AS sloupec, regexp_replace(CAST(min({value}) AS VARCHAR), '^-0.0$', '0.0') AS nejmensi,
        CAST(max({value}) AS VARCHAR) AS nejvetsi FROM lineitem"""
        for name, value in columns.items()
    )
    return f"""WITH s AS ({stacked}), e AS ({ends}), c AS (SELECT sloupec, hodnota, count(*) AS n FROM s GROUP BY 1, 2),
        t AS (SELECT sloupec, hodnota, n, row_number() OVER (PARTITION BY sloupec ORDER BY n DESC, hodnota) AS r
            FROM c WHERE hodnota IS NOT NULL)
        SELECT c.sloupec, CAST(sum(c.n) AS BIGINT) AS radku,
            CAST(coalesce(sum(c.n) FILTER (c.hodnota IS NULL), 0) AS BIGINT) AS prazdnych, count(c.hodnota) AS ruznych,
            any_value(e.nejmensi) AS nejmensi, any_value(e.nejvetsi) AS nejvetsi, any_value(f.nejcastejsi) AS nejcastejsi
        FROM c JOIN e USING (sloupec) LEFT JOIN (
            SELECT sloupec, string_agg(hodnota || ':' || n, ', ' ORDER BY r) AS nejcastejsi FROM t WHERE r <= 5 GROUP BY 1) AS f USING (sloupec)
        GROUP BY 1"""


def _numeric_profile() -> str:
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
    stacked = " UNION ALL ".join(f"SELECT '{name}' AS sloupec, CAST({name} AS DOUBLE) AS h FROM lineitem" for name in names)
    return f"""SELECT sloupec, round(avg(h), 6) AS prumer, quantile_disc(h, 0.25) AS kvartil_1,
        quantile_disc(h, 0.5) AS kvartil_2, quantile_disc(h, 0.75) AS kvartil_3 FROM ({stacked}) GROUP BY 1"""


IMPUTE = """
WITH h AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_quantity,
    CASE WHEN l_linenumber = 7 OR l_discount = 0.05 THEN NULL ELSE l_tax END AS hodnota,
    CASE WHEN l_quantity < 10 THEN NULL ELSE l_linestatus END AS stav FROM lineitem),
g AS (SELECT l_linenumber, quantile_cont(hodnota, 0.5) AS m FROM h GROUP BY 1),
a AS (SELECT quantile_cont(hodnota, 0.5) AS m FROM h),
c AS (SELECT l_returnflag, stav, count(*) AS n FROM h WHERE stav IS NOT NULL GROUP BY 1, 2),
s AS (SELECT l_returnflag, stav, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, stav) AS r FROM c)
SELECT l_orderkey, l_partkey, h.l_linenumber, h.l_returnflag, l_quantity, coalesce(hodnota, g.m, a.m) AS hodnota,
    coalesce(h.stav, s.stav) AS stav
FROM h JOIN g USING (l_linenumber) JOIN s ON s.l_returnflag = h.l_returnflag AND s.r = 1, a
"""


def _unify() -> str:
    head, inspection = measurement_head_columns(), inspection_columns()
    shared = ["CisloProtokolu", "DatumProhlidky", "Vozidlo_Vin", "Vozidlo_Znacka", "Vozidlo_ObchodniOznaceni", "Vozidlo_TypMotoru"]
    first = _select({name: inspection[name] for name in shared})
    second = _select({name: head[name] for name in shared})
    return f"""SELECT 'prohlidky' AS zdroj, {first} FROM orders WHERE {KEPT}
        UNION ALL SELECT 'mereni', {second} FROM orders"""


def oracle_sql() -> dict[str, str]:
    inspection = _select(inspection_columns())
    head = _select(measurement_head_columns())
    vehicle = f"SELECT * FROM events WHERE user_id = {USER} ORDER BY ts, event_id LIMIT 1000"
    wide = dict(zip(m.wide_columns(), _wide_values(), strict=True))
    limits = [c for c in wide if c.startswith(("Nafta_", "Plyn_Nadrz_")) and "Vyusteni" not in c and c != "Nafta_Palivo"]
    diesel = f"FROM orders WHERE {K} % 3 = 1"
    return {
        "inspection_flatten": f"SELECT {inspection}, {MONTH} AS den FROM orders WHERE {KEPT}",
        "inspection_defects": _defects(),
        "inspection_actions": _actions(),
        "inspection_adr_types": _adr_types(),
        "measurement_head": f"SELECT {head}, {MONTH} AS den FROM orders",
        "measurement_dtc_fallback": f"""SELECT {measurement_head_columns()["EmisniSystem"]} AS "EmisniSystem",
            CAST(CASE WHEN {OBD} THEN {K} % 8 WHEN {K} % 8 = 1 THEN {K} % 9 END AS VARCHAR) AS "Obd_PocetDtc",
            count(*) AS pocet FROM orders GROUP BY 1, 2""",
        "measurement_wide": measurement_wide(),
        "measurement_long": measurement_long(),
        "measurement_limits": f"""SELECT {_select({"CisloProtokolu": PROTOCOL} | {name: wide[name] for name in limits})}
            FROM orders""",
        "measurement_typed": f"""SELECT palivo, velicina, CAST(sum(CAST(hodnota AS DECIMAL(18, 6))) AS DOUBLE) AS soucet,
            count(*) FILTER (vysledek = 'true') AS vyhovelo, count(vysledek) AS s_vysledkem,
            CAST(max(CAST(max_hodnota AS DECIMAL(18, 6))) AS DOUBLE) AS nejvyssi_mez
            FROM ({measurement_long()}) GROUP BY 1, 2""",
        "file_status": _statuses(),
        "file_count": "SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS dokumentu FROM orders",
        "ingested_days": f"SELECT {MONTH} AS den FROM orders UNION SELECT DATE '2002-01-01'",
        "pending_days": f"""SELECT den, soubor, CAST(row_number() OVER (ORDER BY den, soubor) AS INT) AS poradi FROM ({_document_names()}) WHERE den NOT IN
            (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE {K} % 7 = 0)""",
        "file_dates": FILE_DATES,
        "parquet_scan": f"""SELECT {MONTH} AS den, 'Orders ' || year(o_orderdate) AS soubor, count(*) AS pocet,
            CAST(0 AS BIGINT) AS poznamek FROM orders GROUP BY 1, 2""",
        "parquet_audit": f"""SELECT DISTINCT 'Orders ' || year(o_orderdate) AS soubor, true AS citelny FROM orders
            UNION ALL SELECT soubor, false FROM ({_document_names()})""",
        "incremental_ingest": _table_counts("CAST(o_orderdate AS DATE)"),
        "stream_ingest": _table_counts(),
        "ingest_split_stream": _table_counts(),
        "ingest_late_part": _table_counts(),
        "ingest_commits": f"""SELECT soubor, den, 'ok' AS stav, count(*) AS zaznamu FROM
            (SELECT 'Prohlidky vozidel za ' || strftime(date_trunc('month', o_orderdate), '%d-%m-%Y') AS soubor,
            {MONTH} AS den FROM orders) GROUP BY 1, 2""",
        "inspection_history": f"""SELECT * FROM (SELECT {inspection} FROM orders WHERE {KEPT})
            WHERE "Vozidlo_Vin" = '{VIN}' ORDER BY "Technicka_Zahajeni" NULLS FIRST, "CisloProtokolu" LIMIT 1000""",
        "daily_report": f"""SELECT {MONTH} AS den, {inspection_columns()["Prohlidka_Stanice_Kraj"]} AS kraj,
            count(*) AS pocet, count(*) FILTER (o_orderstatus = 'F') AS uspech,
            round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS podil
            FROM orders WHERE {KEPT} GROUP BY 1, 2""",
        "report_after_correction": f"""WITH m AS (
            SELECT {inspection_columns()["Prohlidka_Stanice_Kraj"]} AS kraj, {MONTH} AS mesic, count(*) AS pocet,
                count(*) FILTER (o_orderstatus = 'F') AS uspech FROM orders WHERE {KEPT} GROUP BY 1, 2)
            SELECT kraj, mesic, pocet, uspech, round(uspech / pocet, 6) AS podil,
                pocet - lag(pocet) OVER (PARTITION BY kraj ORDER BY mesic) AS zmena FROM m""",
        "stations_after_correction": f"""WITH s AS (
            SELECT {inspection_columns()["Prohlidka_Stanice_Cislo"]} AS stanice, count(*) AS pocet,
                count(*) FILTER (o_orderstatus = 'P') AS oznaceno FROM orders WHERE {KEPT} GROUP BY 1),
            t AS (SELECT *, sum(oznaceno) OVER () / sum(pocet) OVER () AS p FROM s)
            SELECT stanice, pocet, oznaceno, round(oznaceno / pocet, 6) AS podil, round(p, 6) AS podil_celkem,
                round(CASE WHEN p * (1 - p) > 0 THEN (oznaceno / pocet - p) / sqrt(p * (1 - p) / pocet) ELSE 0.0 END, 6) AS z FROM t""",
        "registry_scan": REGISTRY,
        "registry_search": f"SELECT * FROM ({REGISTRY}) WHERE {_FOUND}",
        "registry_exists": f"SELECT count(*) > 0 AS nalezeno FROM ({REGISTRY}) WHERE {_FOUND}",
        "csv_stack": """SELECT CAST(event_id AS VARCHAR) AS event_id,
            CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
            CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS user_id,
            CAST(value AS VARCHAR) AS value, CASE WHEN event_type = 'error' THEN props END AS props
            FROM events WHERE event_type IN ('click', 'error')""",
        "vehicle_history": vehicle,
        "vehicle_history_tail": f"SELECT * FROM ({vehicle}) ORDER BY ts DESC, event_id DESC LIMIT 10",
        "tuple_match": """SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_tax, l_linenumber, l_shipdate
            FROM lineitem WHERE l_quantity = 23.0 AND l_discount = 0.05 AND l_tax = 0.0 AND l_linenumber = 6""",
        "all_to_text": "SELECT CAST(COLUMNS(*) AS VARCHAR) FROM lineitem",
        "column_ids": """SELECT l_orderkey AS "000", l_partkey AS "001", l_suppkey AS "002", l_linenumber AS "003",
            l_quantity AS "004", l_extendedprice AS "005", l_discount AS "006", l_tax AS "007", l_returnflag AS "008",
            l_linestatus AS "009", l_shipdate AS "00a" FROM lineitem""",
        "lenient_types": LENIENT,
        "cast_losses": _cast_losses(),
        "catalog_listing": CATALOG,
        "structure_census": f"""SELECT element, count(*) AS zaznamu, count(DISTINCT {MONTH}) AS souboru FROM orders, {_named(m.LIMIT_QUANTITIES.values())}
            AS e(element, q) WHERE {K} % 3 = 1 AND (q <> 3 OR {K} % 50 = 1) GROUP BY 1""",
        "sampled_census": f"""WITH n AS (SELECT DISTINCT {MONTH} AS den,
            'Data z mericich pristroju za ' || strftime(date_trunc('month', o_orderdate), '%d-%m-%Y') AS soubor FROM orders),
            d AS (SELECT den FROM n ORDER BY md5(soubor || '|7') LIMIT 5)
            SELECT element, count(*) AS zaznamu, count(DISTINCT {MONTH}) AS souboru
            FROM orders, {_named(m.LIMIT_QUANTITIES.values())} AS e(element, q)
            WHERE {K} % 3 = 1 AND (q <> 3 OR {K} % 50 = 1) AND {MONTH} IN (SELECT den FROM d) GROUP BY 1""",
        "structure_counts": f"""SELECT CAST(CASE WHEN {K} % 50 = 1 THEN 6 ELSE 5 END AS INT) AS pocet_deti,
            count(*) AS zaznamu {diesel} GROUP BY 1""",
        "child_integrity": """WITH c AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
            SELECT count(*) FILTER (o_orderkey IS NOT NULL AND k IS NOT NULL) AS rodicu_s_detmi,
            count(*) FILTER (o_orderkey IS NOT NULL AND k IS NULL) AS rodicu_bez_deti,
            CAST(coalesce(sum(n) FILTER (o_orderkey IS NULL), 0) AS BIGINT) AS deti_bez_rodice
            FROM orders FULL JOIN c ON k = o_orderkey""",
        "childless_parents": """SELECT o_orderkey AS k, o_orderstatus FROM orders
            WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
        "child_join": f"""SELECT "Zdroj", "Zavaznost", s AS "Vysledek_Celkovy", count(*) AS pocet
            FROM ({_defects(", o_orderstatus AS s")}) GROUP BY 1, 2, 3""",
        "run_signature": run_signature(),
        "structure_paths": structure_paths(),
        "outcome_split": f"""SELECT 2::BIGINT AS modelu, count(*) FILTER (WHERE NOT {HELD_OUT}) AS trenovacich,
            count(*) FILTER (WHERE {HELD_OUT}) AS zkusebnich, true AS vybran_nejlepsi, true AS auc_platne,
            5::BIGINT AS priznaku, 1.0::DOUBLE AS soucet_dulezitosti, true AS serazeno FROM lineitem""",
        "feature_auc": f"""WITH t AS (SELECT * FROM lineitem WHERE {HELD_OUT}),
            s AS (SELECT l_linestatus, l_returnflag = 'R' AS p, unnest(['l_quantity', 'l_extendedprice', 'l_discount',
                'l_tax', 'l_linenumber']) AS priznak,
                unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE]) AS h FROM t),
            r AS (SELECT *, rank() OVER g + (count(*) OVER (PARTITION BY priznak, l_linestatus, h) - 1) / 2.0 AS rank
                FROM s WINDOW g AS (PARTITION BY priznak, l_linestatus ORDER BY h)),
            c AS (SELECT priznak, l_linestatus, count(*) FILTER (WHERE p) AS kladnych, count(*) FILTER (WHERE NOT p) AS zapornych,
                sum(rank) FILTER (WHERE p) AS ranks FROM r GROUP BY 1, 2)
            SELECT priznak, l_linestatus, kladnych, zapornych,
                CASE WHEN kladnych * zapornych > 0
                THEN round((ranks - kladnych * (kladnych + 1) / 2.0) / (kladnych::DOUBLE * zapornych), 9) END AS auc FROM c""",
        "dup_signature": """SELECT l_quantity, l_extendedprice, l_discount, l_tax, count(*) AS radku,
            count(DISTINCT l_orderkey) AS vozidel FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT l_orderkey) > 1""",
        "dup_rows": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_partkey FROM lineitem
            SEMI JOIN (SELECT l_quantity, l_discount, l_tax, l_partkey FROM lineitem GROUP BY ALL
                HAVING count(DISTINCT l_orderkey) > 1) USING (l_quantity, l_discount, l_tax, l_partkey)""",
        "station_rank": STATION_RANK,
        "outliers": OUTLIERS,
        "monthly_trend": MONTHLY,
        "forecast": FORECAST,
        "by_vehicle": BY_VEHICLE,
        "defect_corr": DEFECT_CORR,
        "profile": _profile(),
        "numeric_profile": _numeric_profile(),
        "impute": IMPUTE,
        "unify": _unify(),
        "drive_split": f"""SELECT CASE {K} % 3 WHEN 0 THEN 'benzin' WHEN 1 THEN 'nafta' ELSE 'plyn' END AS pohon,
            CASE WHEN {K} % 3 = 1 THEN 'NM' ELSE 'BA' END AS "Vozidlo_Palivo", count(*) AS pocet
            FROM orders GROUP BY 1, 2""",
        "clean_text": f"""SELECT 'CZ-' || {K} AS "CisloProtokolu", 'VIN' || {C} AS "Vozidlo_Vin", 'osobni' AS "Vozidlo_Druh",
            {NULL} AS "Emise_CisloMotoru", CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS zastupnych
            FROM orders WHERE {KEPT}""",
        "limit_margin": f"""WITH v AS (SELECT palivo, velicina, CAST(hodnota AS DECIMAL(18, 6)) - CAST(coalesce(min_hodnota, min_zaznamu) AS DECIMAL(18, 6)) AS d,
            CAST(coalesce(max_hodnota, max_zaznamu) AS DECIMAL(18, 6)) - CAST(hodnota AS DECIMAL(18, 6)) AS h FROM ({measurement_long()}))
            SELECT palivo, velicina, count(d) AS s_min, count(*) FILTER (d < 0) AS pod_min,
            CAST(sum(d) AS DOUBLE) AS soucet_min, count(*) FILTER (h < 0) AS nad_max, CAST(min(h) AS DOUBLE) AS nejmensi_max
            FROM v GROUP BY 1, 2""",
        "fail_cube": """SELECT l_linestatus, l_linenumber, CAST(grouping_id(l_linestatus, l_linenumber) AS INT) AS uroven,
            count(*) AS pocet, count(*) FILTER (l_returnflag = 'R') AS neuspech,
            round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS podil
            FROM lineitem GROUP BY CUBE (l_linestatus, l_linenumber)""",
        "station_join": """SELECT n_name, count(*) AS pocet, count(s_name) AS znamych FROM lineitem
            LEFT JOIN (SELECT * FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 <> 3)
            ON s_suppkey = l_suppkey GROUP BY 1""",
    }


