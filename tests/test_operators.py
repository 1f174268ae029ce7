import math
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from inspectlake.operators import analysis, model, ranking, relations, report, search
from inspectlake.sources import catalogue


def test_tuple_search_never_matches_nulls(frame):
    df = frame([(1.88, 1.84, "a"), (1.88, None, "b"), (1.88, 1.85, "c")], "x double, y double, vin string")
    assert [r.vin for r in search.matching(df, {"x": 1.88, "y": 1.84}, ["vin"]).collect()] == ["a"]


def test_any_column_search(frame):
    df = frame([(1, "abc", None), (23, None, "x"), (4, "a.c", "y")], "n int, s string, t string")
    assert search.any_column_contains(df, "3").count() == 1
    assert search.any_column_contains(df, "a.c").count() == 1
    assert search.any_column_contains(df, "a.c", pattern=True).count() == 2
    assert search.exists(search.any_column_contains(df, "nic")).first().nalezeno is False


def test_history_is_a_top_k(frame):
    df = frame([(str(i), "V" if i % 2 else "W", None if i == 3 else f"{i:04}") for i in range(50)],
               "CisloProtokolu string, Vozidlo_Vin string, Technicka_Zahajeni string")
    rows = [r.CisloProtokolu for r in search.vehicle_history(df, "V", 3).collect()]
    assert rows == ["3", "1", "5"]
    plan = search.vehicle_history(df, "V")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    tail = search.tail_of(df, ["CisloProtokolu"], limit=20, tail=3)
    expected = sorted(str(i) for i in range(50))[:20][-3:]
    assert sorted(r.CisloProtokolu for r in tail.collect()) == expected


@pytest.mark.parametrize("scores", [[1.0] * 300 + [2.0], [float(i % 17) for i in range(500)], [5.0], []])
def test_rank_matches_its_definition(frame, scores):
    random.Random(1).shuffle(scores)
    df = frame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = {r.i: r.poradi for r in ranking.with_rank(df, "s", most=3).collect()}
    assert got == {i: 1 + sum(other > s for other in scores) for i, s in enumerate(scores)}


def test_rows_without_a_score_rank_last(frame):
    df = frame([("a", 2.0), ("b", None), ("c", 3.0), ("d", None)], "k string, s double")
    assert {r.k: r.poradi for r in ranking.with_rank(df, "s").collect()} == {"a": 2, "b": 3, "c": 1, "d": 3}


@pytest.mark.parametrize("discrete", [False, True])
@pytest.mark.parametrize("most", [2_000_000, 40])
def test_quantiles_of_a_hot_group(frame, discrete, most):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else "cold", None if i % 50 == 0 else rng.choice([rng.random(), 0.5])) for i in range(3000)]
    rows += [(None, 1.0), ("none", None)]
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = ranking.quantiles(frame(rows, "g string, v double"), ["g"], F.col("v"), shares, "q", discrete, most=most)
    out = {r.g: list(r.q) for r in got.collect()}
    assert set(out) == {"hot", "cold", None}
    for g, found in out.items():
        values = sorted(v for k, v in rows if k == g and v is not None)
        for share, q in zip(shares, found, strict=True):
            place = share * (len(values) - 1)
            low = math.floor(place)
            want = values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])
            if discrete:
                want = values[max(1, math.ceil(share * len(values))) - 1]
            assert q == pytest.approx(want)


def test_groups_on_different_scales_send_few_values(frame, monkeypatch):
    monkeypatch.setattr(ranking, "SKETCH", 200)
    rng = random.Random(6)
    rows = [("large", rng.uniform(1e6, 2e6)) for _ in range(20_000)] + [(None, rng.random()) for _ in range(200)] + [("nan", math.nan)]
    df = frame(rows, "g string, v double")
    out = {r.g: r.q[0] for r in ranking.quantiles(df, ["g"], F.col("v"), (0.5,), "q", True).collect()}
    median = lambda g: sorted(v for k, v in rows if k == g)[sum(k == g for k, _ in rows) // 2 - 1]
    assert out == {"large": median("large"), None: median(None)}


def test_null_groups_are_groups(frame):
    df = frame([(None, 1.0), (None, 1.0), (None, None), ("a", 9.0), ("a", 9.0), ("a", 9.0), ("b", None)], "g string, v double")
    assert sorted((r.g or "", r.v) for r in analysis.fill_median(df, ["g"], "v").collect()) == [("", 1.0)] * 3 + [("a", 9.0)] * 3 + [("b", 9.0)]
    filled = analysis.fill_mode(frame([(None, "x"), (None, None), ("a", "y"), ("a", "y"), ("a", "y")], "g string, v string"), ["g"], "v")
    assert sorted(r.v for r in filled.where("g is null").collect()) == ["x", "x"]
    rows = [(None, float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("a", float(v)) for v in range(90, 110)]
    flagged = analysis.with_outlier_flags(frame(rows, "g string, v double"), ["g"], "v")
    assert [tuple(r) for r in flagged.where("mimo_meze").select("g", "v").collect()] == [(None, 100.0)]


def test_a_day_that_lost_its_rows_leaves_the_report(spark, frame, tmp_path):
    schema = "CisloProtokolu string, Prohlidka_Stanice_Kraj string, Vysledek_Celkovy string, den date, soubor string"
    days = [date(2020, 1, 1), date(2020, 1, 2)]
    rows, path = str(tmp_path / "rows"), str(tmp_path / "report")
    for kept in (days, days[:1]):
        frame([("1", "K", "F", day, "d") for day in kept], schema).write.mode("overwrite").parquet(rows)
        report.refresh_report(spark, rows, path, days)
    assert [r.den for r in spark.read.parquet(path).collect()] == days[:1]


def test_outliers_match_statistics(frame):
    rng = random.Random(2)
    rows = [(g, round(rng.gauss(10, 2), 2)) for g in "ab" for _ in range(101)] + [("a", 99.0)]
    got = analysis.with_outlier_flags(frame(rows, "g string, v double"), ["g"], "v").collect()
    for group in "ab":
        values = [v for g, v in rows if g == group]
        median = statistics.median(values)
        mad = statistics.median([round(abs(v - median), 6) for v in values])
        low, _, high = statistics.quantiles(values, n=4, method="inclusive")
        for r in (r for r in got if r.g == group):
            assert r.median == pytest.approx(median) and r.mad == pytest.approx(mad)
            assert r.horni_mez == pytest.approx(high + 1.5 * (high - low), abs=1e-5)
    assert [r.v for r in got if r.mimo_meze and r.v > 50] == [99.0]


def test_signatures_need_two_vehicles(frame):
    df = frame([(1, 1, "a"), (1, 1, "a"), (2, 2, "a"), (2, 2, "b")], "x int, y int, vin string")
    assert [tuple(r) for r in analysis.repeated_signatures(df, ["x", "y"], "vin").collect()] == [(2, 2, 2, 2)]
    assert analysis.rows_with_repeated_signature(df, ["x", "y"], "vin").count() == 2


def test_phi_by_hand(frame):
    outcomes = frame([(i, i < 4) for i in range(10)], "k int, bad boolean")
    defects = frame([(0, "A"), (0, "A"), (1, "A"), (5, "A"), (9, "B")], "k int, code string")
    got = {r.code: (r.s_kodem, r.phi) for r in analysis.outcome_correlation(defects, outcomes, "k", "code", "bad").collect()}
    expected = (10 * 2 - 3 * 4) / (3 * 7 * 4 * 6) ** 0.5
    assert got["A"] == (3, pytest.approx(expected, abs=1e-6))
    assert got["B"][1] < 0


def test_trend_and_forecast(frame):
    rows = [(date(2020, m, 1 + i), "g", i % 2 == 0, m) for m in (1, 2, 3) for i in range(2 * m)]
    df = frame(rows, "d date, g string, ok boolean, v int")
    trend = analysis.monthly_trend(df, "d", ["g"], F.col("ok"), F.col("v")).orderBy("mesic").collect()
    assert [(r.pocet, r.podil, r.prumer, r.zmena, r.klouzavy_prumer) for r in trend] == [
        (2, 0.5, 1.0, None, 2.0),
        (4, 0.5, 2.0, 2, 3.0),
        (6, 0.5, 3.0, 2, 4.0),
    ]
    series = frame([("g", date(2019, 11 + i, 1) if i < 2 else date(2020, i - 1, 1), float(10 + i)) for i in range(4)],
                   "g string, m date, v double")
    ahead = analysis.forecast(series, ["g"], "m", "v", 2).orderBy("mesic").collect()
    assert [(r.mesic, r.odhad) for r in ahead] == [(date(2020, 3, 1), 14.0), (date(2020, 4, 1), 15.0)]


def test_fill(frame):
    df = frame([("a", 1.0, "x"), ("a", 3.0, "x"), ("a", None, None), ("b", None, None)], "g string, v double, s string")
    filled = analysis.fill_mode(analysis.fill_median(df, ["g"], "v"), ["g"], "s")
    assert sorted((r.g, r.v, r.s) for r in filled.collect()) == [
        ("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 3.0, "x"), ("b", 2.0, "x"),
    ]


def test_rows_of_few_groups_do_not_move_to_their_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, None), (None, 3.0, "y")], "g string, v double, s string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (analysis.fill_median(df, ["g"], "v"), analysis.fill_mode(df, ["g"], "s"), analysis.with_outlier_flags(df, ["g"], "v")):
            joins = rows._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin [coalesce(g#" in joins and "SortMergeJoin [coalesce(g#" not in joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cleaning_profile_and_unify(frame):
    df = frame([(" wv1 ", "-"), ("x", " y "), (None, "")], "vin string, motor string")
    rows = analysis.cleaned(df, ["vin", "motor"], upper=["vin"]).collect()
    assert [tuple(r) for r in rows] == [("WV1", None, 1), ("X", "y", 0), (None, None, 0)]
    got = {r.sloupec: r for r in analysis.profile(frame([(1, "a"), (1, "b"), (2, None)], "n int, s string"), ["n", "s"]).collect()}
    assert (got["n"].radku, got["n"].ruznych, got["n"].nejcastejsi) == (3, 2, "1:2, 2:1")
    assert (got["s"].prazdnych, got["s"].nejcastejsi) == (1, "a:1, b:1")
    (empty,) = analysis.profile(frame([(None,)], "n int"), ["n"]).collect()
    assert (empty.prazdnych, empty.ruznych, empty.nejcastejsi) == (1, 0, None)
    many = frame([(f"v{i % 997}",) for i in range(3000)] + [("often",)] * 9, "s string")
    assert analysis.profile(many, ["s"]).first().nejcastejsi == "often:9, v0:4, v1:4, v2:4, v3:4"
    both = analysis.unify({"p": frame([(1, 2)], "a int, b int"), "m": frame([(3, 4)], "c int, a int")})
    assert sorted(tuple(r) for r in both.collect()) == [("m", 4), ("p", 1)]


def test_integrity(frame):
    parents, children = frame([(1,), (2,)], "k int"), frame([(1,), (1,), (9,)], "k int")
    assert tuple(relations.integrity(parents, children, "k").first()) == (1, 1, 1)
    assert [r.k for r in relations.orphans(children, parents, "k").collect()] == [9]
    assert [r.k for r in relations.childless(parents, children, "k").collect()] == [2]
    assert relations.with_parent(children, parents, "k").count() == 2


def test_catalogue(frame):
    c = catalogue
    triples = frame(
        [
            ("S", c.SERIES_MEMBER, "d1", None),
            ("S", c.SERIES_MEMBER, "d2", None),
            ("other", c.SERIES_MEMBER, "d3", None),
            *[(f"d{i}", c.TITLE, f"Data 0{i}-01-2020", "cs") for i in (1, 2, 3)],
            ("d1", c.TITLE, "Data 01-01-2020", "en"),
            *[(f"d{i}", c.DISTRIBUTION, f"x{i}", None) for i in (1, 2, 3)],
            ("d1", c.DISTRIBUTION, "x1b", None),
            *[(f"x{i}", c.DOWNLOAD_URL, f"u{i}", None) for i in ("1", "1b", "2", "3")],
        ],
        "s string, p string, o string, lang string",
    )
    listed = c.list_series(triples, "S")
    assert sorted(r.url for r in listed.collect()) == ["u1", "u1b", "u2"]
    done = frame([(date(2020, 1, 1),)], "den date")
    assert [r.url for r in c.to_fetch(listed, F.lit(date(2020, 1, 1)), processed=done).collect()] == ["u2"]
    assert c.to_fetch(listed, F.lit(date(2020, 1, 1)), F.lit(date(2020, 1, 1))).count() == 2
    nameless = frame([("d9", "Data bez dne", "u")], "series string, title string, url string")
    with pytest.raises(Exception, match="no dd-mm-yyyy day"):
        c.to_fetch(nameless, F.lit(date(2020, 1, 1))).collect()


def test_auc_counts_pairs_and_halves_of_ties(frame):
    rng = random.Random(8)
    rows = [(g, rng.choice([1.0, 2.0, 2.5, None, rng.random()]), rng.choice([True, False, None])) for g in ("a", None) for _ in range(300)]
    rows += [("one kind", 1.0, True)]
    df = frame(rows, "g string, s double, p boolean")
    for most in (2_000_000, 20):
        got = {r.g: r for r in ranking.rank_auc(df, "s", F.col("p"), ["g"], most=most).collect()}
        assert got["one kind"].auc is None
        for g in ("a", None):
            pos, neg = ([s for k, s, p in rows if k == g and s is not None and p is want] for want in (True, False))
            wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
            assert (got[g].kladnych, got[g].zapornych) == (len(pos), len(neg)) and got[g].auc == pytest.approx(wins / len(pos) / len(neg))


def test_permuted_columns_keep_their_values(frame):
    rows = frame([(i, float(i), i * 2) for i in range(500)], "k int, v double, w int")
    out = model.permuted(rows, "v", ["k"], 3).collect()
    assert sorted(r.v for r in out) == [float(i) for i in range(500)] and all(r.w == 2 * r.k for r in out)
    assert sum(r.v == r.k for r in out) < 20


def test_permutations_in_turn_are_those_of_each_column(frame, monkeypatch):
    rows = [(i if i % 7 else None, i // 3, float(i), None if i % 5 == 0 else i * 2) for i in range(500)]
    df = frame(rows, "k int, l int, v double, w int")
    each = lambda: sorted(map(str, model.permuted_in_turn(df, ["v", "w"], ["k", "l"], 3, "co").collect()))
    at_once = each()
    monkeypatch.setattr(model, "MOST_IN_PYTHON", 1)
    assert at_once == each() and len(at_once) == 1000


def test_permutations_take_one_shuffle(frame):
    df = frame([(i, float(i), float(i)) for i in range(50)], "k int, v double, w double")
    plan = model.permuted_in_turn(df, ["v", "w"], ["k"], 3, "co")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("FlatMapGroupsInArrow") == 1


def test_importance_goes_to_the_feature_that_decides(spark, frame):
    rng = random.Random(9)
    rows = [(i, rng.random(), rng.random()) for i in range(600)]
    fitted = model.fit_outcome(frame([(i, a, b, a > 0.5) for i, a, b in rows], "k int, a double, b double, y boolean"), ["a", "b"], "y", ["k"], 3)
    first, second = fitted.importances(spark).collect()
    assert first.priznak == "a" and first.dulezitost > 0.8 and first.dulezitost + second.dulezitost == pytest.approx(1)


def test_model_uses_rows_with_missing_features(spark, frame):
    rows = [(i, None if i % 2 else float(i % 10), i % 10 > 4) for i in range(400)] + [(1000, 1.0, None)]
    outcome = model.fit_outcome(frame(rows, "k int, x double, bad boolean"), ["x"], "bad", ["k"], iterations=2)
    assert all(0.5 <= auc <= 1 for auc in outcome.aucs.values())


def test_model_prefers_the_shape_it_can_fit(spark, frame):
    rng = random.Random(3)
    rows = [(i, x, y, (x > 0.5) != (y > 0.5)) for i in range(2000) for x, y in [(rng.random(), rng.random())]]
    outcome = model.fit_outcome(frame(rows, "k int, x double, y double, bad boolean"), ["x", "y"], "bad", ["k"], iterations=3)
    assert outcome.chosen == "boostovane_stromy"
    assert outcome.aucs["boostovane_stromy"] > 0.9 > outcome.aucs["logisticka_regrese"]
    assert {r.priznak for r in outcome.importances(spark).collect()} == {"x", "y"}
    assert outcome.scores(spark).where("vybran").count() == 1


def test_examples_lie_in_parts_by_their_number(spark, frame, monkeypatch):
    monkeypatch.setattr(model, "ROWS_TOGETHER", 50)
    rows = frame([(None if i % 2 else 1, float(i)) for i in range(1000)], "k int, v double").coalesce(1)
    sizes = model.in_parts(rows, 1000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) < 150
    assert model.in_parts(rows, 50) is rows
