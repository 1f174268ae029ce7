import re

import pytest
from tests import xml as X

from inspectlake.functions import casts, names
from inspectlake.operators import analysis, census
from inspectlake.plans import measurements as plan
from inspectlake.sources import documents


@pytest.fixture
def read(spark, tmp_path):
    def run(body, **options):
        X.put(tmp_path / "in", "Data za 05-06-2021.xml", X.measurements(body))
        scanned = documents.scan(spark, plan.MEASUREMENTS, str(tmp_path / "in"))
        return plan.shape(documents.sound(scanned), **options)

    return run


def measured(name, value, low="", high=""):
    bounds = (f'<min hodnota="{low}" rucniZadani="false"/>' if low else "") + (f'<max hodnota="{high}"/>' if high else "")
    return f'<{name} hodnota="{value}" vysledek="true">{bounds}</{name}>'


def device(inner):
    return f"<Mereni><CisloProtokolu>M</CisloProtokolu><PristrojData>{inner}</PristrojData></Mereni>"


def test_wide_names_follow_the_grammar():
    columns = list(plan.wide_columns())
    assert len(columns) == len({name.lower() for name in columns}) == 1970
    blocks = {"Obd_Readiness_": 77, "Benzin_": 433, "Nafta_": 985, "Plyn_": 437}
    assert {prefix: sum(name.startswith(prefix) for name in columns) for prefix in blocks} == blocks
    assert columns[39] == "Obd_Readiness_Zazeh_AC_Podporovano"
    start = columns.index("Benzin_Vyusteni0_OtackyVolnobezne_CO_Hodnota")
    assert [re.sub("^.*_CO_", "", name) for name in columns[start : start + 6]] == (
        "Hodnota Vysledek Min_Hodnota Min_RucniZadani Max_Hodnota Max_RucniZadani".split()
    )
    assert columns[-1] == "Plyn_Nadrz_Kontrola"
    ids = names.column_ids(columns)
    assert ids[columns[0]] == "000" and ids[columns[-1]] == "7b1"


def test_a_path_is_walked_once_for_all_leaves_below():
    """Every step of a path costs time in every record."""
    outlets = plan._spark_outlets("d") + plan._diesel_outlets("d") + plan._diesel_limits("d")
    for step in ("`min`", "`max`"):
        assert outlets.count(step) == len(plan.REGIMES) * len(plan.REGIME_QUANTITIES) + 2 * len(plan.RUN_QUANTITIES) + len(plan.LIMIT_QUANTITIES)


def test_planned_types():
    types = list(plan.wide_types().values())
    assert (types.count(casts.AMOUNT), types.count(casts.FLAG), types.count(casts.INTEGER)) == (1228, 696, 2)


def test_empty_record_is_kept(read):
    (row,) = read("<Mereni/>").drop("den", "soubor", "Detaily").collect()
    assert all(value is None for value in row)


def test_nested_lowercase_element_is_no_record(read):
    body = device(f"<detailNafta><vyusteni><mereni>{measured('TPS', 1)}</mereni></vyusteni></detailNafta>")
    assert read(body).count() == 1


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ("<prohlidka><poznamka>a</poznamka><poznamka/><poznamka>b</poznamka></prohlidka>", "a\nb"),
        ("<prohlidka/>", ""),
        ("<prohlidka><poznamka/></prohlidka>", ""),
        ("", None),
    ],
)
def test_notes(read, inner, expected):
    assert read(device(inner)).first().Poznamky == expected


def test_presence_and_attributes(read):
    bare = read(device("<vysledekMereni vysledekMIL=''><vyhovuje/></vysledekMereni>")).first()
    assert (bare.Vysledek_Vyhovuje, bare.PristiProhlidka, bare.Vysledek_Mil) == ("true", None, "")


@pytest.mark.parametrize(
    ("system", "label"),
    [
        ("<rizenyOBD/><rizeny/>", "Rizeny_Obd"),
        ("<rizeny/><nerizeny/>", "Rizeny"),
        ("<nerizeny/>", "Nerizeny"),
        ("", None),
    ],
)
def test_emission_system(read, system, label):
    assert read(device(f"<emisniSystem>{system}</emisniSystem>")).first().EmisniSystem == label


def test_fault_count_falls_back_only_on_request(read):
    body = device("<emisniSystem><rizeny><pocetDTC>3</pocetDTC></rizeny></emisniSystem>")
    assert read(body).first().Obd_PocetDtc is None
    assert read(body, dtc_fallback=True).first().Obd_PocetDtc == "3"


def test_head_scan_equals_the_head_of_the_full_scan(spark, read, tmp_path):
    prohlidka = "<prohlidka cisloProtokolu='p'><mericiPristroj typ='t'/><poznamka>n</poznamka></prohlidka>"
    body = device(prohlidka + "<emisniSystem><rizeny/></emisniSystem><detailBenzin palivo='x'/>") + "<Mereni/>"
    full = read(body).select(*[name for name, _ in plan.HEAD_COLUMNS], "soubor", "den")
    heads = documents.records(spark, plan.MEASUREMENT_HEADS, str(tmp_path / "in")).select(*full.columns)
    assert sorted(map(str, heads.collect())) == sorted(map(str, full.collect()))


def test_slots_cut_the_wide_view_only(read):
    outlets = "".join(
        f"<vyusteni><otackyVolnobezne>{measured('CO', i, low=1, high=2)}</otackyVolnobezne></vyusteni>" for i in range(5)
    )
    runs = "".join(f"<mereni>{measured('TPS', i)}</mereni>" for i in range(6))
    diesel = f"<detailNafta palivo='NM'><vyusteni><mereniPrumer>{measured('teplota', 9)}</mereniPrumer>{runs}</vyusteni></detailNafta>"
    tanks = "<kontrolaNadrzi><nadrz vyrobce='N1' kontrola=''/><nadrz vyrobce='N2'/></kontrolaNadrzi>"
    records = read(device(f"<detailBenzin palivo='BA'>{outlets}</detailBenzin>{diesel}<detailPlyn>{tanks}</detailPlyn>"))
    (row,) = plan.wide(records).collect()
    assert [row[f"Benzin_Vyusteni{i}_OtackyVolnobezne_CO_Hodnota"] for i in range(4)] == ["0", "1", "2", "3"]
    assert row.Benzin_Vyusteni0_OtackyVolnobezne_CO_Min_RucniZadani == "false"
    assert row.Benzin_Vyusteni0_OtackyVolnobezne_CO_Max_RucniZadani is None
    assert row.Benzin_Vyusteni0_OtackyZvysene_CO_Hodnota is None
    assert [row[f"Nafta_Vyusteni0_Mereni{i}_Tps_Hodnota"] for i in range(4)] == ["0", "1", "2", "3"]
    assert (row.Nafta_Vyusteni0_MereniPrumer_Teplota_Hodnota, row.Nafta_Vyusteni1_Mereni0_Tps_Hodnota) == ("9", None)
    assert (row.Plyn_Nadrz_Vyrobce, row.Plyn_Nadrz_Kontrola, row.Plyn_Nadrz_Zivotnost) == ("N1", "", None)
    long = plan.long(records).drop("den", "soubor").collect()
    assert len(long) == 5 + 1 + 6
    assert {(r.vyusteni, r.hodnota) for r in long if r.palivo == "Benzin"} == {(i, str(i)) for i in range(5)}
    assert {(r.beh, r.hodnota) for r in long if r.rezim == "Mereni"} == {(i, str(i)) for i in range(6)}


def test_every_wide_column_reads_its_own_place(spark, read):
    """Fill all slots with values that name their place, and compare by rule."""

    def six(name, where):
        return (
            f'<{name} hodnota="{where}|Hodnota" vysledek="{where}|Vysledek">'
            f'<min hodnota="{where}|Min_Hodnota" rucniZadani="{where}|Min_RucniZadani"/>'
            f'<max hodnota="{where}|Max_Hodnota" rucniZadani="{where}|Max_RucniZadani"/></{name}>'
        )

    def spark_detail(fuel, tag, extra=""):
        outlets = ""
        for i in range(4):
            regimes = "".join(
                f"<{regime}>" + "".join(six(q, f"{fuel}_Vyusteni{i}_{name}_{q}") for q in plan.REGIME_QUANTITIES) + f"</{regime}>"
                for name, regime in plan.REGIMES.items()
            )
            outlets += f"<vyusteni>{regimes}</vyusteni>"
        return f'<{tag} palivo="{fuel}_Palivo|">{outlets}{extra}</{tag}>'

    def run(tag, prefix):
        return f"<{tag}>" + "".join(six(q, f"{prefix}_{name}") for name, q in plan.RUN_QUANTITIES.items()) + f"</{tag}>"

    limits = "".join(
        f"<{q}>"
        + "".join(
            f'<{side.lower()} hodnota="Nafta_{name}_{side}|Hodnota" rucniZadani="Nafta_{name}_{side}|RucniZadani"/>'
            for side in ("Min", "Max")
        )
        + f"</{q}>"
        for name, q in plan.LIMIT_QUANTITIES.items()
    )
    outlets = "".join(
        "<vyusteni>"
        + run("mereniPrumer", f"Nafta_Vyusteni{i}_MereniPrumer")
        + "".join(run("mereni", f"Nafta_Vyusteni{i}_Mereni{j}") for j in range(4))
        + "</vyusteni>"
        for i in range(4)
    )
    diesel = f'<detailNafta palivo="Nafta_Palivo|"><mereniVznetLimit>{limits}</mereniVznetLimit>{outlets}</detailNafta>'
    tank = "".join(f'{tag}="Plyn_Nadrz|{name}" ' for name, tag in plan.TANK.items())
    groups = "".join(
        f"<{tag}>"
        + "".join(
            f'<{x} podporovano="Obd_Readiness_{name}_{x}|Podporovano" otestovano="Obd_Readiness_{name}_{x}|Otestovano"/>'
            for x in monitors
        )
        + f"</{tag}>"
        for (name, tag), monitors in plan.MONITOR_GROUPS.items()
    )
    system = f"<emisniSystem><rizenyOBD><readiness>{groups}</readiness></rizenyOBD></emisniSystem>"
    gas = spark_detail("Plyn", "detailPlyn", f"<kontrolaNadrzi><nadrz {tank}/></kontrolaNadrzi>")
    records = read(device(system + spark_detail("Benzin", "detailBenzin") + diesel + gas))
    (row,) = plan.wide(records).drop("den", "soubor").collect()
    values = row.asDict()
    head = {name for name, _ in plan.HEAD_COLUMNS}
    wrong = [name for name, v in values.items() if name not in head and (v or "").replace("|", "_").rstrip("_") != name]
    assert wrong == []


def test_typing_counts_its_losses(read):
    outlet = "<vyusteni><otackyVolnobezne><CO hodnota='1.5' vysledek='true'/><HC hodnota='x'/></otackyVolnobezne></vyusteni>"
    records = read(device(f"<detailBenzin palivo='BA'>{outlet}</detailBenzin>"))
    types = plan.wide_types()
    losses = {r.column_name: (r.present, r.lost) for r in casts.cast_losses(plan.wide(records), types).collect()}
    assert len(losses) == len(types)
    where = "Benzin_Vyusteni0_OtackyVolnobezne"
    assert losses[f"{where}_CO_Hodnota"] == (1, 0)
    assert losses[f"{where}_CO_Vysledek"] == (1, 1)
    assert losses[f"{where}_HC_Hodnota"] == (1, 1)
    assert losses["Plyn_Vyusteni0_OtackyVolnobezne_CO_Hodnota"] == (0, 0)
    leaves = {r.column_name: (r.present, r.lost) for r in plan.wide_losses(records).collect()}
    assert leaves == losses
    (typed,) = casts.lenient(plan.wide(records), types).select(f"{where}_CO_Hodnota", f"{where}_HC_Hodnota").collect()
    assert float(typed[0]) == 1.5 and typed[1] is None


def test_losses_from_leaves_equal_those_of_the_wide_view(read):
    run = "<TPS hodnota='a' vysledek='1'><min hodnota='2' rucniZadani='ano'/></TPS><teplota hodnota='3'/>"
    outlet = f"<vyusteni><mereniPrumer>{run}</mereniPrumer>" + f"<mereni>{run}</mereni>" * 6 + "</vyusteni>"
    limits = "<mereniVznetLimit><TPS><min hodnota='z' rucniZadani='true'/></TPS></mereniVznetLimit>"
    records = read(device(f"<detailNafta>{limits}{outlet * 5}</detailNafta>"))
    wide = {tuple(r) for r in casts.cast_losses(plan.wide(records), plan.wide_types()).collect()}
    leaves = {tuple(r) for r in plan.wide_losses(records).collect()}
    assert leaves == wide and ("Nafta_TPS_Min_Hodnota", casts.AMOUNT, 1, 1) not in leaves
    assert ("Nafta_Tps_Min_Hodnota", casts.AMOUNT, 1, 1) in leaves
    assert sum(r[2] for r in leaves) == 2 + 4 * 5 * 5 + sum(r[2] for r in leaves if r[0] in ("StaniceCislo", "OdpovednaOsoba"))


def test_runs_keep_all_outlets_and_signatures_need_two_vehicles(read):
    def vehicle(vin, *values):
        runs = "".join(f"<mereni><TPS hodnota='{v}'/><teplota hodnota='7'/></mereni>" for v in values)
        return (
            f"<Mereni><PristrojData><vozidlo><VIN>{vin}</VIN></vozidlo><detailNafta>"
            f"<vyusteni><mereniPrumer><TPS hodnota='1.26'/></mereniPrumer>{runs}</vyusteni></detailNafta></PristrojData></Mereni>"
        )

    records = read(vehicle("A", "1.26", "1.26", "2", "x") + vehicle("B", "1.26", "1.31", "y") + vehicle("B", "2.0"))
    runs = plan.runs(records)
    assert runs.count() == 8 and {len(r.hodnoty) for r in runs.collect()} == {2}
    exact = analysis.repeated_runs(runs, "hodnoty", "Vozidlo_Vin").collect()
    assert sorted((r.Vozidlo_Vin, r.beh, r.radku, r.vozidel) for r in exact) == [("A", 0, 3, 2), ("A", 1, 3, 2), ("B", 0, 3, 2)]
    rounded = analysis.repeated_runs(runs, "hodnoty", "Vozidlo_Vin", places=1).collect()
    assert sorted((r.Vozidlo_Vin, r.beh, r.radku, r.vozidel) for r in rounded) == [
        ("A", 0, 4, 2), ("A", 1, 4, 2), ("A", 2, 2, 2), ("B", 0, 2, 2), ("B", 0, 4, 2), ("B", 1, 4, 2),
    ]


def test_pruning_reaches_the_leaf(spark, read, tmp_path):
    read(device(f"<detailBenzin><vyusteni><otackyVolnobezne>{measured('CO', 1)}</otackyVolnobezne></vyusteni></detailBenzin>")).drop(
        "den", "soubor"
    ).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    query = plan.wide(stored).select("Benzin_Vyusteni0_OtackyVolnobezne_CO_Hodnota")
    text = query._jdf.queryExecution().executedPlan().toString()
    schema = re.search("ReadSchema: .*", text).group()
    assert "OtackyVolnobezne" in schema and "OtackyZvysene" not in schema and "Nafta" not in schema


def test_drive_class(spark, read, tmp_path):
    bodies = {
        "plyn": "<detailBenzin/><detailPlyn/>",
        "nafta": "<detailNafta/>",
        "benzin": "<vozidlo><palivo>BA</palivo></vozidlo>",
        "jine": "",
    }
    for drive, inner in bodies.items():
        assert analysis.with_drive(read(device(inner))).first().pohon == drive
    analysis.write_by_drive(read("".join(map(device, bodies.values()))), str(tmp_path / "split"))
    split = spark.read.parquet(str(tmp_path / "split"))
    assert sorted(r.pohon for r in split.select("pohon").collect()) == sorted(bodies)


def test_census(spark, read, tmp_path):
    body = device("<detailNafta><mereniVznetLimit x='1'><TPS/><TPS/><kourivost/></mereniVznetLimit></detailNafta>")
    read(body + device("") + device("<detailNafta><mereniVznetLimit><TPS/></mereniVznetLimit></detailNafta>"))
    path = "PristrojData.detailNafta.mereniVznetLimit"
    children = census.scan_children(spark, str(tmp_path / "in"), "Mereni", path)
    found = {r.element: (r.zaznamu, r.souboru) for r in census.child_names(children).collect()}
    assert found == {"TPS": (2, 1), "kourivost": (1, 1)}
    assert {r.pocet_deti: r.zaznamu for r in census.child_counts(children).collect()} == {2: 1, 1: 1}


def test_paths_of_all_depths(spark, tmp_path):
    body = "<Mereni a='1'><x:B xmlns:x='u'><C/><C d='2'>t</C></x:B></Mereni><Mereni><B/></Mereni><Mereni/>"
    X.put(tmp_path, "Data za 05-06-2021.xml", X.measurements(body))
    X.put(tmp_path, "Data za 06-06-2021.xml.gz", X.measurements("<Mereni><B><E></B></Mereni>"))
    rows = census.structure_paths(documents.record_texts(spark, "Mereni", str(tmp_path))).collect()
    assert {r.cesta: (r.zaznamu, r.souboru) for r in rows} == {
        "Mereni": (4, 2), "Mereni/@a": (1, 1), "Mereni/B": (3, 2), "Mereni/B/@xmlns:x": (1, 1),
        "Mereni/B/C": (1, 1), "Mereni/B/C/@d": (1, 1), "Mereni/B/E": (1, 1),
    }


def test_short_ids_of_the_wide_view_lead_back(read):
    outlet = f"<vyusteni><otackyVolnobezne>{measured('CO', 1)}</otackyVolnobezne></vyusteni>"
    wide = plan.wide(read(device(f"<detailPlyn>{outlet}</detailPlyn>")))
    columns = list(plan.wide_columns())
    short = names.to_ids(wide, columns)
    assert short.columns[:1970] == [format(i, "03x") for i in range(1970)]
    back = names.from_ids(short, columns)
    assert back.columns == wide.columns
    place = "Plyn_Vyusteni0_OtackyVolnobezne_CO_Hodnota"
    assert back.select(place).first()[0] == short.select(format(columns.index(place), "03x")).first()[0] == "1"


def test_a_plain_record_is_found_without_replacing_text(spark, tmp_path):
    between = ["<R>a</R>", " \n<R>b</R>", "<R>c:R</R>", "<R>d<Rx/></R>", "<p:R>e</p:R>", "<R h='1'>f</R>", "<R/><R>g</R>"]
    (tmp_path / "Feed 01-01-2020.xml").write_text(f"<L><DatovyObsah>{''.join(between)}</DatovyObsah></L>")
    rows = documents.record_texts(spark, "R", str(tmp_path))
    assert sorted(r._text for r in rows.where("_text is not null").collect()) == sorted(
        ["<R>a</R>", "<R>b</R>", "<R>c:R</R>", "<R>d<Rx/></R>", "<p:R>e</p:R>", "<R h='1'>f</R>", "<R/>", "<R>g</R>"]
    )
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(value" not in plan and plan.count("locate(") == 1
