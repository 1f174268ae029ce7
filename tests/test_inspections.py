import pytest
from tests import xml as X

from inspectlake.plans import inspections as plan
from inspectlake.sources import documents


@pytest.fixture
def read(spark, tmp_path):
    def run(text, name="Prohlidky za 01-01-2020.xml"):
        X.put(tmp_path / "in", name, text)
        return documents.records(spark, plan.INSPECTIONS, str(tmp_path / "in"))

    return run


def test_full_record(read):
    records = read(X.inspections(X.FULL))
    row = plan.inspections(records).drop("den", "soubor").collect()
    assert [list(r) for r in row] == [X.FULL_ROW]
    assert len(plan.PARENT_COLUMNS) == 58
    found = {(r.Zdroj, r.Kod, r.Zavaznost) for r in plan.defects(records).collect()}
    assert found == {("TechnickaCast", "1.1", "B"), ("TskCast", "2.2", "B"), ("Vysledek", "3.3", "B")}
    assert [(r.Typ, r.Nevyhovujici) for r in plan.actions(records).collect()] == [("u1", "false")]
    assert [r.TypVozidlaADR for r in plan.adr_types(records).collect()] == ["FL"]


def test_missing_blocks_and_missing_protocol(read):
    body = X.simple("CZ-9") + X.simple("", "<TechnickaCast>" + X.defects("9") + "</TechnickaCast>") + "<Prohlidka/>"
    records = read(X.inspections(body))
    (row,) = plan.inspections(records).drop("den", "soubor").collect()
    assert row[0] == "CZ-9" and all(value is None for value in row[1:])
    assert plan.defects(records).count() == 0
    assert plan.actions(records).count() == 0
    assert plan.adr_types(records).count() == 0


def test_text_rules(read):
    vehicle = "<Vozidlo><Vin> x </Vin><Vin>second</Vin><Druh/><Kategorie>  </Kategorie><Znacka>a&amp;b</Znacka></Vozidlo>"
    vehicle += "<Vozidlo><Provedeni>late</Provedeni></Vozidlo>"
    (row,) = read(X.inspections(X.simple("1", vehicle))).collect()
    assert row.Vozidlo_Vin == " x "  # untrimmed, and the first of two
    assert row.Vozidlo_Druh is None  # an empty element has no text
    assert row.Vozidlo_Kategorie == "  "
    assert row.Vozidlo_Znacka == "a&b"
    assert row.Vozidlo_Provedeni is None  # only the first vehicle counts


def test_duplicate_defects_and_empty_items_stay(read):
    items = "<Zavada><Kod>1</Kod></Zavada><Zavada><Kod>1</Kod></Zavada><Zavada/>"
    types = "<AdrCast><TypVozidlaADRSeznam><TypVozidlaADR/><TypVozidlaADR>AT</TypVozidlaADR></TypVozidlaADRSeznam></AdrCast>"
    records = read(X.inspections(X.simple("1", f"<TechnickaCast><ZavadaSeznam>{items}</ZavadaSeznam></TechnickaCast>{types}")))
    assert sorted((r.Kod or "") for r in plan.defects(records).collect()) == ["", "1", "1"]
    assert sorted((r.TypVozidlaADR or "") for r in plan.adr_types(records).collect()) == ["", "AT"]


def test_namespaces_and_compression_make_no_difference(spark, tmp_path):
    body = X.simple("1", "<Vozidlo><Vin>V</Vin></Vozidlo>")
    prefixed = body.replace("</", "</p:").replace("<", "<p:").replace("<p:/p:", "</p:")
    X.put(tmp_path, "A 01-01-2020.xml", X.inspections(body))
    X.put(tmp_path, "B 02-01-2020.xml.gz", X.inspections(body))
    X.put(tmp_path, "C 03-01-2020.xml", X.inspections(prefixed, "p"))
    rows = documents.records(spark, plan.INSPECTIONS, str(tmp_path)).select("Vozidlo_Vin", "den", "soubor").collect()
    assert sorted((r.Vozidlo_Vin, str(r.den), r.soubor) for r in rows) == [
        ("V", "2020-01-01", "A 01-01-2020"),
        ("V", "2020-01-02", "B 02-01-2020"),
        ("V", "2020-01-03", "C 03-01-2020"),
    ]


def test_name_without_day_and_damage_are_errors(spark, tmp_path):
    X.put(tmp_path / "a", "beze dne.xml", X.inspections(X.simple("1")))
    with pytest.raises(Exception, match="no dd-mm-yyyy day"):
        documents.records(spark, plan.INSPECTIONS, str(tmp_path / "a")).collect()
    X.put(tmp_path / "b", "x 01-01-2020.xml", X.inspections(X.simple("1") + "<Prohlidka><Vozidlo></Prohlidka>"))
    with pytest.raises(Exception, match="damaged document"):
        documents.records(spark, plan.INSPECTIONS, str(tmp_path / "b")).collect()
