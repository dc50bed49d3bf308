"""Cross-tabulation of zones and land uses on a grid of cells, and all tables made from it.

The cells are read once: every table here starts from the crosstab, at most zones x uses rows, which is pre-aggregated where the
cells are. What follows is tiny, whatever the grid's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """scale * part / whole; null where whole is 0."""
    return F.when(whole != 0, F.lit(scale) * part.cast("double") / whole.cast("double"))


def crosstab(cells: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """Counts of cells by the given columns."""
    return cells.groupBy(*by).agg(F.count("*").alias(n))


def complete(counts: DataFrame, domain: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """The counts with a row for every row of the (small) domain; missing ones are 0."""
    return F.broadcast(domain).join(counts, on, "left").select(*on, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def valid(cells: DataFrame) -> DataFrame:
    """Cells for inference: inside the extent, with a parcel and a zone."""
    return cells.where("ext AND lu > 0 AND zone > 0")


def inside(cells: DataFrame) -> DataFrame:
    """Cells for tables: inside the extent; zone 0 and use 0 stay."""
    return cells.where("ext")


def subtotals(cells: DataFrame, xwalk: DataFrame) -> DataFrame:
    """(level, grp, zone, lu, n, row_pct): districts, groups, unclassified land and everything, with the share of the row.

    level: 0 district, 1 group, 2 all. Land without a zone has a null grp.
    """
    groups = xwalk.select("zone", "grp").distinct()
    ct = crosstab(inside(cells), "zone", "lu").join(F.broadcast(groups), "zone", "left")
    sets = ct.groupingSets([["grp", "zone", "lu"], ["grp", "lu"], ["lu"]], "grp", "zone", "lu").agg(
        F.sum("n").alias("n"), (F.grouping("zone") + F.grouping("grp")).cast("int").alias("level")
    )
    row = Window.partitionBy("level", "grp", "zone")
    return sets.select("level", "grp", "zone", "lu", "n", F.round(share(F.col("n"), F.sum("n").over(row)), 6).alias("row_pct"))


def wide(ct: DataFrame, uses: list[int], by: list[str], n: str = "n") -> DataFrame:
    """A row for each `by`, a column u<code> for each use, and the total."""
    out = ct.groupBy(*by).pivot("lu", uses).agg(F.sum(n))
    cells = [F.coalesce(F.col(str(u)), F.lit(0)).cast("long").alias(f"u{u}") for u in uses]
    total = sum((F.coalesce(F.col(str(u)), F.lit(0)) for u in uses[1:]), F.coalesce(F.col(str(uses[0])), F.lit(0)))
    return out.select(*by, *cells, total.cast("long").alias("total"))


def implementation(cells: DataFrame, xwalk: DataFrame, cell_acres: float) -> DataFrame:
    """For each district and group: acres of the zone, on parcels, neutral, the denominator, and how much of the plan was built."""
    joined = crosstab(inside(cells), "zone", "lu").join(F.broadcast(xwalk), ["zone", "lu"])
    acres = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    on = F.col("lu") > 0
    sums = joined.groupingSets([["grp", "district"], ["grp"]], "grp", "district").agg(
        F.grouping("district").cast("int").alias("is_group"),
        F.sum("n").alias("zone_n"),
        acres(on).alias("parcel_n"),
        acres(on & F.col("is_neutral")).alias("neutral_n"),
        acres(on & F.col("is_strict")).alias("strict_n"),
        acres(on & F.col("is_cumulative")).alias("cumulative_n"),
    )
    denom = F.col("parcel_n") - F.col("neutral_n")
    to_acres = lambda c: F.round(dbl(c) * cell_acres, 6)
    return sums.select(
        "is_group", "grp", "district",
        to_acres(F.col("zone_n")).alias("zone_acres"),
        to_acres(F.col("parcel_n")).alias("parcel_acres"),
        F.round(share(F.col("zone_n") - F.col("parcel_n"), F.col("zone_n")), 6).alias("row_share_pct"),
        to_acres(F.col("neutral_n")).alias("neutral_acres"),
        F.round(share(F.col("neutral_n"), F.col("parcel_n")), 6).alias("neutral_pct"),
        to_acres(denom).alias("denom_acres"),
        F.round(share(F.col("strict_n"), denom), 6).alias("strict_pct"),
        F.round(share(F.col("cumulative_n"), denom), 6).alias("cumulative_pct"),
    )


def reverse_view(cells: DataFrame, xwalk: DataFrame) -> DataFrame:
    """For each use: cells, and the share of them in each group and unclassified."""
    groups = xwalk.select("zone", "grp").distinct()
    ct = crosstab(inside(cells).where("lu > 0"), "zone", "lu").join(F.broadcast(groups), "zone", "left").withColumn("grp", F.coalesce("grp", F.lit("Unclassified")))
    by = ct.groupBy("lu", "grp").agg(F.sum("n").alias("n"))
    return by.select("lu", "grp", "n", F.round(share(F.col("n"), F.sum("n").over(Window.partitionBy("lu"))), 6).alias("pct"))


def off_diagonal(cells: DataFrame, xwalk: DataFrame, use_groups: DataFrame) -> DataFrame:
    """Share of each plan group's denominator that went to each present-day group; (use, use_grp) are given."""
    ct = crosstab(valid(cells), "zone", "lu").join(F.broadcast(xwalk), ["zone", "lu"]).where("NOT is_neutral")
    total = ct.groupBy("grp").agg(F.sum("n").alias("denom"))
    part = ct.join(F.broadcast(use_groups), "use").groupBy("grp", "use_grp").agg(F.sum("n").alias("n"))
    return part.join(F.broadcast(total), "grp").select("grp", "use_grp", "n", F.round(share(F.col("n"), F.col("denom")), 6).alias("pct"))


def flows(cells: DataFrame, xwalk: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells from each plan group to each target group (use, to_grp)."""
    ct = crosstab(valid(cells), "zone", "lu").join(F.broadcast(xwalk), ["zone", "lu"])
    return ct.join(F.broadcast(targets), "use").groupBy(F.col("grp").alias("from_grp"), "to_grp").agg(F.sum("n").alias("n"))


def before_after(before: DataFrame, after: DataFrame, code: str) -> DataFrame:
    """Cells of each code in two versions, the difference and its percentage; codes of either side."""
    b = before.groupBy(code).agg(F.count("*").alias("n_before"))
    a = after.groupBy(code).agg(F.count("*").alias("n_after"))
    both = b.join(a, code, "full").select(code, F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"), F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after"))
    delta = F.col("n_after") - F.col("n_before")
    return both.withColumn("delta", delta).withColumn("delta_pct", F.round(share(delta, F.col("n_before")), 6))
