"""Feed text: few parts a row, the same text."""

import re

from inspectlake.workload import xmltext
from inspectlake.workload.feeds import inspection_record, measurement_record
from inspectlake.workload.xmltext import joined, only_if, tag


def test_neighbouring_literals_are_one_part():
    inner = tag("B", "k", attributes={"h": "'it\\'s'"})
    assert joined("'a'", "''", joined("'b'", "k"), "'c'") == "concat('ab', k, 'c')"
    assert tag("A", tag("E"), inner) == "concat('<A><E/><B h=\"it\\'s\">', k, '</B></A>')"
    for record in (inspection_record(), measurement_record()):
        assert not re.search(r"', '<|>', '", record)


def test_merged_parts_give_the_text(spark):
    text = tag("A", only_if("k > 1", tag("B", "k", "'&amp;'")), tag("C"), attributes={"h": "k + 1"})
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int").selectExpr(f"{text} AS t").collect()
    assert [r.t for r in rows] == ['<A h="2"><C/></A>', '<A h="3"><B>2&amp;</B><C/></A>', None]


def test_feeds_are_written_at_the_level_asked_for(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "'Feed 01-01-2020' AS soubor")
    record = tag("R", "id", "md5(CAST(id % 50 AS string))")
    sizes, texts = [], []
    for level in (xmltext.GZIP_LEVEL, "BEST_COMPRESSION"):
        monkeypatch.setattr(xmltext, "GZIP_LEVEL", level)
        target = xmltext.write_feed(spark, rows, "id", record, "L", "urn:n", str(tmp_path / level))
        sizes.append(sum(p.stat().st_size for p in (tmp_path / level).rglob("*.gz")))
        texts.append(sorted(r.value for r in spark.read.text(target).collect()))
    assert sizes[0] > sizes[1] and texts[0] == texts[1] and len(texts[0]) == 3003
