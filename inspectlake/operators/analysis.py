"""Cleaning, anomalies and trends over the tables.

Medians and quartiles are exact: sketches per group bracket them, and only the
values inside a bracket are looked into.  A null is a group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectlake.operators.ranking import kept, matched_groups, quantiles

PLACEHOLDER = "-"
#: Most frequent values of a profile, and the parts of a column they are sought in.
TOP = 5
PARTS = 256


# --- suspicious values -----------------------------------------------------------------


def repeated_signatures(df: DataFrame, values: Sequence[str], vehicle: str) -> DataFrame:
    """Value tuples shared by more than one vehicle."""
    groups = df.groupBy(*values).agg(F.count("*").alias("radku"), F.countDistinct(vehicle).alias("vozidel"))
    return groups.where("vozidel > 1")


def rows_with_repeated_signature(df: DataFrame, values: Sequence[str], vehicle: str) -> DataFrame:
    # Two vehicles exist exactly if the smallest differs from the largest.
    shared = df.groupBy(*values).agg(F.min(vehicle).alias("_lo"), F.max(vehicle).alias("_hi")).where("_lo != _hi")
    return df.join(shared.select(*values), list(values), "left_semi")


def repeated_runs(runs: DataFrame, values: str, vehicle: str, places: int | None = None) -> DataFrame:
    """Runs whose whole set of measured values occurs with another vehicle too, with ``radku`` and ``vozidel``.

    ``values`` is an array of quantity and value; ``places`` rounds the values
    (null: exactly equal texts).  Signatures are written once.  Hashes of the
    sorted sets are counted first; only runs of a hash with two vehicles are
    grouped by the values themselves.
    """
    number = "try_cast(x.hodnota AS decimal(18,6))"
    shown = "x.hodnota" if places is None else f"coalesce(cast(round({number}, {places}) AS string), x.hodnota)"
    signature = F.expr(f"array_sort(transform(`{values}`, x -> named_struct('velicina', x.velicina, 'hodnota', {shown})))")
    signed = kept(runs.withColumn("_podpis", signature).withColumn("_otisk", F.xxhash64("_podpis")), "podpisy")
    often = signed.groupBy("_otisk").agg(F.min(vehicle).alias("_lo"), F.max(vehicle).alias("_hi")).where("_lo != _hi")
    likely = signed.join(often.select("_otisk"), "_otisk", "left_semi")
    shared = likely.groupBy("_otisk", "_podpis").agg(F.count("*").alias("radku"), F.countDistinct(vehicle).alias("vozidel"))
    return likely.join(shared.where("vozidel > 1"), ["_otisk", "_podpis"]).drop("_otisk", "_podpis")


def station_scores(df: DataFrame, station: str, flagged: Column) -> DataFrame:
    """Per station: flagged share, national share and z-score of the difference."""
    return scores_of_counts(df.groupBy(station).agg(F.count("*").alias("pocet"), F.count_if(flagged).alias("oznaceno")), station)


def scores_of_counts(stations: DataFrame, station: str) -> DataFrame:
    """The same from one row per station with ``pocet`` and ``oznaceno``."""
    totals = stations.agg(F.sum("pocet").alias("_n"), F.sum("oznaceno").alias("_f")).first()
    national = totals["_f"] / totals["_n"] if totals["_n"] else 0.0
    share = F.col("oznaceno") / F.col("pocet")
    deviation = F.sqrt(F.lit(national * (1 - national)) / F.col("pocet"))
    z = F.when(deviation > 0, (share - national) / deviation).otherwise(F.lit(0.0))
    return stations.select(
        station,
        "pocet",
        "oznaceno",
        F.round(share, 6).alias("podil"),
        F.round(F.lit(national), 6).alias("podil_celkem"),
        F.round(z, 6).alias("z"),
    )


def with_outlier_flags(df: DataFrame, groups: Sequence[str], value: str, fence: float = 1.5) -> DataFrame:
    """Robust z-score (median and MAD) and quartile fences of the row's group."""
    column = F.col(value)
    quartiles = quantiles(df, groups, column, (0.25, 0.5, 0.75), "_q").select(
        *groups,
        F.col("_q")[1].alias("median"),
        F.round(F.col("_q")[0] - fence * (F.col("_q")[2] - F.col("_q")[0]), 6).alias("dolni_mez"),
        F.round(F.col("_q")[2] + fence * (F.col("_q")[2] - F.col("_q")[0]), 6).alias("horni_mez"),
    )
    centred = matched_groups(df, quartiles, groups, "left")
    distance = F.round(F.abs(column - F.col("median")), 6)
    mads = quantiles(centred, groups, distance, (0.5,), "_m").select(*groups, F.col("_m")[0].alias("mad"))
    # 0.6745 scales the MAD of a normal distribution to its standard deviation.
    robust = F.when(F.col("mad") > 0, F.round(0.6745 * (column - F.col("median")) / F.col("mad"), 6))
    outside = (column < F.col("dolni_mez")) | (column > F.col("horni_mez"))
    return matched_groups(centred, mads, groups, "left").withColumn("robustni_z", robust).withColumn("mimo_meze", outside)


def limit_margins(values: DataFrame) -> DataFrame:
    """Distance of each measured value to its limits; negative means outside.

    Takes the long measurement table; a value's own limit comes before the
    record's.  A text that is no number gives null.
    """
    names = ("hodnota", "min_hodnota", "max_hodnota", "min_zaznamu", "max_zaznamu")
    number = {name: F.col(name).try_cast("decimal(18,6)") for name in names}
    low = F.coalesce(number["min_hodnota"], number["min_zaznamu"])
    high = F.coalesce(number["max_hodnota"], number["max_zaznamu"])
    return values.withColumn("rezerva_min", number["hodnota"] - low).withColumn("rezerva_max", high - number["hodnota"])


def failure_cube(df: DataFrame, conditions: Sequence[str], failed: Column) -> DataFrame:
    """Failure rate under every subset of the conditions."""
    cube = df.cube(*conditions).agg(
        F.grouping_id().cast("int").alias("uroven"), F.count("*").alias("pocet"), F.count_if(failed).alias("neuspech")
    )
    return cube.withColumn("podil", F.round(F.col("neuspech") / F.col("pocet"), 6))


def outcome_correlation(defects: DataFrame, outcomes: DataFrame, key: str, code: str, failed: str) -> DataFrame:
    """Phi coefficient between having a defect code and failing, per code.

    ``outcomes`` has one row per key.  A code counts once per key.
    """
    totals = outcomes.agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("f")).first()
    n, f = totals["n"], totals["f"]
    with_code = (
        defects.select(key, code)
        .distinct()
        .join(outcomes.select(key, failed), key)
        .groupBy(code)
        .agg(F.count("*").alias("s_kodem"), F.count_if(F.col(failed)).alias("s_kodem_neuspech"))
    )
    c, cf = F.col("s_kodem").cast("double"), F.col("s_kodem_neuspech").cast("double")
    scale = F.sqrt(c) * F.sqrt(F.lit(float(n)) - c) * F.sqrt(F.lit(float(f))) * F.sqrt(F.lit(float(n - f)))
    phi = F.when(scale > 0, F.round((F.lit(float(n)) * cf - c * F.lit(float(f))) / scale, 6))
    return with_code.withColumn("phi", phi)


# --- trends ----------------------------------------------------------------------------


def monthly_trend(df: DataFrame, day: str, groups: Sequence[str], passed: Column, amount: Column) -> DataFrame:
    """Per group and month: count, pass rate, mean, change to the month before
    and mean of three months.  Windows run over months, not over rows."""
    month = F.trunc(day, "month")
    monthly = df.groupBy(*groups, month.alias("mesic")).agg(
        F.count("*").alias("pocet"), F.count_if(passed).alias("uspech"), F.sum(amount).alias("_sum")
    )
    order = Window.partitionBy(*groups).orderBy("mesic")
    recent = order.rowsBetween(-2, 0)
    return monthly.select(
        *groups,
        "mesic",
        "pocet",
        F.round(F.col("uspech") / F.col("pocet"), 6).alias("podil"),
        F.round(F.col("_sum").cast("double") / F.col("pocet"), 4).alias("prumer"),
        (F.col("pocet") - F.lag("pocet").over(order)).alias("zmena"),
        F.round(F.avg("pocet").over(recent), 4).alias("klouzavy_prumer"),
    )


def forecast(series: DataFrame, groups: Sequence[str], month: str, value: str, months: int) -> DataFrame:
    """Linear trend per group, continued for the given number of months."""
    index = F.year(month) * 12 + F.month(month)
    fitted = (
        series.withColumn("_x", index.cast("double"))
        .groupBy(*groups)
        .agg(
            F.regr_slope(value, "_x").alias("_slope"),
            F.regr_intercept(value, "_x").alias("_intercept"),
            F.max(month).alias("_last"),
        )
    )
    ahead = fitted.select(
        *groups, "_slope", "_intercept", "_last", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("_step")
    )
    target = F.add_months("_last", F.col("_step"))
    position = F.year(target) * 12 + F.month(target)
    return ahead.select(
        *groups, target.alias("mesic"), F.round(F.col("_intercept") + F.col("_slope") * position, 4).alias("odhad")
    )


# --- views over several sets -----------------------------------------------------------


def by_vehicle(vehicles: DataFrame, key: str, sets: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """One row per vehicle with aggregates of several sets; each set has the
    key column and is aggregated before it is joined."""
    result = vehicles
    for name, (rows, aggregates) in sets.items():
        columns = [value.alias(f"{name}_{column}") for column, value in aggregates.items()]
        result = result.join(rows.groupBy(key).agg(*columns), key, "left")
    return result


def unify(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several sets over the columns all of them have, with the source."""
    first = next(iter(sets.values()))
    shared = [name for name in first.columns if all(name in df.columns for df in sets.values())]
    tagged = [df.select(F.lit(source).alias("zdroj"), *shared) for source, df in sets.items()]
    return reduce(DataFrame.unionByName, tagged)


def with_drive(records: DataFrame) -> DataFrame:
    """Drive class from the fuel detail that is present, else from the fuel code."""
    drive = (
        F.when(F.array_contains("Detaily", "Plyn"), "plyn")
        .when(F.array_contains("Detaily", "Nafta"), "nafta")
        .when(F.array_contains("Detaily", "Benzin"), "benzin")
        .when(F.col("Vozidlo_Palivo") == "BA", "benzin")
        .when(F.col("Vozidlo_Palivo") == "NM", "nafta")
        .otherwise("jine")
    )
    return records.withColumn("pohon", drive)


def write_by_drive(records: DataFrame, path: str) -> None:
    with_drive(records).write.partitionBy("pohon").mode("overwrite").parquet(path)


def cleaned(df: DataFrame, columns: Sequence[str], upper: Sequence[str] = ()) -> DataFrame:
    """Trim the columns, turn placeholders and blanks into null, raise codes to
    upper case; ``zastupnych`` counts the placeholders of a row."""
    trimmed = {name: F.trim(F.col(f"`{name}`")) for name in columns}

    def clean(name: str) -> Column:
        value = F.nullif(F.nullif(trimmed[name], F.lit(PLACEHOLDER)), F.lit(""))
        return F.upper(value) if name in upper else value

    found = [F.coalesce((value == PLACEHOLDER).cast("int"), F.lit(0)) for value in trimmed.values()]
    return df.select(
        *[clean(name).alias(name) if name in trimmed else F.col(f"`{name}`") for name in df.columns],
        reduce(Column.__add__, found).alias("zastupnych"),
    )


def with_station(df: DataFrame, stations: DataFrame, number: str) -> DataFrame:
    """Rows with the station register's columns; unknown stations keep their rows."""
    return df.join(stations, number, "left")


# --- profile and missing values --------------------------------------------------------


def _plain(value: Column) -> Column:
    """A value as text; both zeros of a float are one."""
    text = value.cast("string")
    return F.when(text == "-0.0", "0.0").otherwise(text)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values, smallest and largest value in
    the column's own order, and the five most frequent with their counts, as
    ``value:count`` by falling count, then text.

    Values are counted per column first, so the second step sees each distinct
    value once.  The most frequent are found in parts of a column's values, then
    among those of the parts, so a column of unique values meets in no task.
    """
    texts = df.select(*[F.col(f"`{name}`").cast("string").alias(name) for name in columns])
    stacked = texts.unpivot([], list(columns), "sloupec", "hodnota")
    counted = stacked.groupBy("sloupec", "hodnota").agg(F.count("*").alias("_times"))
    present = F.col("hodnota").isNotNull()
    parts = counted.where(present).withColumn("_part", F.pmod(F.xxhash64("hodnota"), F.lit(PARTS)))
    order = [F.desc("_times"), "hodnota"]
    for where in (["sloupec", "_part"], ["sloupec"]):
        place = F.row_number().over(Window.partitionBy(*where).orderBy(*order))
        parts = parts.withColumn("_place", place).where(F.col("_place") <= TOP)
    entry = F.concat_ws(":", "hodnota", F.col("_times").cast("string"))
    top = parts.groupBy("sloupec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", entry.alias("e")))), lambda x: x["e"]), ", ").alias("nejcastejsi")
    )
    ends = df.agg(
        *[
            F.struct(
                F.lit(name).alias("sloupec"),
                _plain(F.min(f"`{name}`")).alias("nejmensi"),
                _plain(F.max(f"`{name}`")).alias("nejvetsi"),
            ).alias(f"c{i}")
            for i, name in enumerate(columns)
        ]
    ).select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    counts = counted.groupBy("sloupec").agg(
        F.sum("_times").alias("radku"),
        F.coalesce(F.sum(F.when(~present, F.col("_times"))), F.lit(0)).alias("prazdnych"),
        F.count("hodnota").alias("ruznych"),
    )
    return counts.join(ends, "sloupec").join(top, "sloupec", "left")


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: mean and exact quartiles (values that occur)."""
    stacked = df.select(*[F.col(f"`{name}`").cast("double").alias(name) for name in columns]).unpivot(
        [], list(columns), "sloupec", "hodnota"
    )
    means = stacked.groupBy("sloupec").agg(F.round(F.avg("hodnota"), 6).alias("prumer"))
    ends = quantiles(stacked, ["sloupec"], F.col("hodnota"), (0.25, 0.5, 0.75), "_q", discrete=True)
    return means.join(ends, "sloupec", "left").select(
        "sloupec", "prumer", *[F.col("_q")[n].alias(f"kvartil_{n + 1}") for n in range(3)]
    )


def fill_median(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Missing numbers become the group's median, or the overall one."""
    medians = quantiles(df, groups, F.col(value), (0.5,), "_median")
    overall = quantiles(df, [], F.col(value), (0.5,), "_median").first()
    fallback = overall["_median"][0] if overall and overall["_median"] else None
    filled = F.coalesce(F.col(value), F.col("_median")[0], F.lit(fallback))
    return matched_groups(df, medians, groups, "left").withColumn(value, filled).drop("_median")


def fill_mode(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Missing values become the group's most frequent one, or the overall one;
    of several the smallest."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_times"))
    best = F.min(F.struct((-F.col("_times")).alias("t"), F.col(value).alias("v")))["v"]
    modes = counted.groupBy(*groups).agg(best.alias("_mode"))
    overall = counted.groupBy(value).agg(F.sum("_times").alias("_times")).agg(best.alias("_mode")).first()
    filled = F.coalesce(F.col(value), F.col("_mode"), F.lit(overall["_mode"] if overall else None))
    return matched_groups(df, modes, groups, "left").withColumn(value, filled).drop("_mode")
