"""Reports: every published table as a frame of named columns, and files of them. Tables start from the crosstab and are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..domain import LAND_USES
from ..functions.scalar import below
from ..operators import agreement as A
from ..operators import crosstab as C
from .sinks import check, write_csv, write_json

NO_PARCEL = "No parcel (ROW/water)"


def crosstab_tables(cells: DataFrame, xwalk: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Acres, and percentages of the row, of each use: a row for each district, each group, unclassified land and everything."""
    long = C.subtotals(cells, xwalk).join(F.broadcast(xwalk.select("zone", "district").distinct()), "zone", "left")
    name = F.when(F.col("level") == 2, "Total").when((F.col("level") == 1) & F.col("grp").isNotNull(), F.concat("grp", F.lit(" total"))).otherwise(F.coalesce("district", F.lit("Unclassified")))
    rows = long.select("level", F.coalesce("grp", F.lit("~")).alias("grp"), name.alias("zone_name"), "lu", F.col("n") * s.cell_acres).toDF("level", "grp", "zone_name", "lu", "acres").where("level <> 1 OR grp <> '~'")
    uses = {**{i + 1: u for i, u in enumerate(LAND_USES)}, 0: NO_PARCEL}
    each = [F.coalesce(F.sum(F.when(F.col("lu") == code, F.col("acres"))), F.lit(0.0)).alias(u) for code, u in uses.items()]
    acres = rows.groupBy("level", "grp", "zone_name").agg(*each, F.sum("acres").alias("Total"))
    part = lambda u: C.share(F.col(f"`{u}`"), F.col("Total")).alias(u)
    return acres, acres.select("level", "grp", "zone_name", *[part(u) for u in uses.values()], part("Total"))


def stats_summary(observed: DataFrame, expected: DataFrame, null: DataFrame, intervals: DataFrame) -> DataFrame:
    """A row for each group: agreement, baseline, corrected index, null model and intervals side by side."""
    e = expected.select("grp", F.col("strict_pct").alias("strict_baseline"), F.col("cumulative_pct").alias("cumulative_baseline"))
    return observed.join(e, "grp").join(A.corrected(observed, expected), "grp").join(null, "grp").join(intervals, "grp")


def accuracy_report(overall: DataFrame, by_class: DataFrame, ratios: DataFrame) -> DataFrame:
    """(part, name, measure, value): the accuracy results in one long table."""
    parts = [_long(overall.withColumn("name", F.lit("all")), "overall", F.col("name"), "name"), _long(by_class, "class", F.col("cls"), "cls"), _long(ratios.withColumn("name", F.lit("all")), "ratio", F.col("name"), "name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _long(df: DataFrame, part: str, name: Column, *keys: str) -> DataFrame:
    measures = [c for c in df.columns if c not in keys]
    pairs = F.array([F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures])
    return df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), F.explode(pairs).alias("m")).select("part", "name", "m.*")


def results_bundle(groups: DataFrame, districts: DataFrame, flows: DataFrame, decay: DataFrame, sensitivity: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(part, name, measure, value): all six parts of the published results in one long table."""
    out = _long(groups, "groups", F.col("grp"), "grp")
    for more in (
        _long(districts, "districts", F.col("district"), "district", "grp"),
        _long(flows, "flows", F.concat_ws(" > ", "from_grp", "to_grp"), "from_grp", "to_grp"),
        _long(decay, "decay", F.concat_ws(" @ ", "grp", F.col("distance").cast("long")), "grp", "distance"),
        _long(sensitivity, "sensitivity", F.concat_ws(" / ", "variant", "grp"), "variant", "grp"),
        accuracy.select(F.lit("accuracy").alias("part"), F.concat_ws(" ", "part", "name").alias("name"), "measure", "value"),
    ):
        out = out.unionByName(more)
    return out


def write_reports(spark: SparkSession, folder: str, cells: DataFrame, xwalk: DataFrame, detail: DataFrame, s: Settings = Settings()) -> None:
    """The tables as CSV files in `folder`: crosstab_acres, crosstab_pct, implementation, reverse_view, detail (largest first)."""
    acres, pct = crosstab_tables(cells, xwalk, s)
    for name, df in (("crosstab_acres", acres), ("crosstab_pct", pct)):
        write_csv(df.orderBy("grp", "level", "zone_name").drop("level", "grp"), f"{folder}/{name}")
    write_csv(C.implementation(cells, xwalk, s.cell_acres).orderBy("grp", "is_group", "district"), f"{folder}/implementation")
    reverse = C.reverse_view(cells, xwalk).select("lu", "grp", (F.col("n") * s.cell_acres).alias("acres"), "pct")
    write_csv(reverse.orderBy("lu", "grp"), f"{folder}/reverse_view")
    write_csv(detail.orderBy(F.col("acres").desc(), "detail"), f"{folder}/detail", digits=3)


def write_statistics(folder: str, summary: DataFrame, accuracy: DataFrame, bundle: DataFrame, s: Settings = Settings()) -> None:
    """The summary as CSV and as text lines, the accuracy table and the bundle as JSON; a group's interval must hold its own value."""
    kept = check(summary, "strict_pct IS NULL OR strict_pct BETWEEN strict_lo AND strict_hi OR abs(strict_pct - strict_lo) < 5", "an interval is far from its value")
    write_csv(kept.orderBy("grp"), f"{folder}/stats_summary", digits=4)
    line = F.format_string("%s: strict %.1f %% [%.1f, %.1f], baseline %.1f %%, p = %s", "grp", "strict_pct", "strict_lo", "strict_hi", "strict_baseline", below(F.col("strict_p"), s.null_shifts))
    kept.orderBy("grp").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/stats_report")
    write_json(accuracy, f"{folder}/accuracy")
    write_json(bundle, f"{folder}/results")
