"""Agreement of a plan with what is there: percentages, an independence baseline and a chance-corrected index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crosstab import crosstab, dbl, share, valid


def agreement_class(zone: Column, lu: Column, neutral: Column, strict: Column, cumulative: Column) -> Column:
    """0 no zone or parcel, 4 neutral, 1 strict, 2 cumulative, 3 mismatch; the first that holds."""
    return F.when((zone == 0) | (lu == 0), 0).when(neutral, 4).when(strict, 1).when(cumulative, 2).otherwise(3)


def classify_cells(cells: DataFrame, xwalk: DataFrame) -> DataFrame:
    """The cells with their agreement class."""
    small = F.broadcast(xwalk.select("zone", "lu", "is_neutral", "is_strict", "is_cumulative"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return cells.join(small, ["zone", "lu"], "left").withColumn("agree", agreement_class(F.col("zone"), F.col("lu"), flag("is_neutral"), flag("is_strict"), flag("is_cumulative"))).drop("is_neutral", "is_strict", "is_cumulative")


def measures(ct: DataFrame, xwalk: DataFrame, *by: str, n: str = "n") -> DataFrame:
    """denom, strict_n and cumulative_n of counted (zone, lu) rows, by the given columns."""
    joined = ct.join(F.broadcast(xwalk), ["zone", "lu"]).where("lu > 0")
    part = lambda cond: F.sum(F.when(cond, F.col(n)).otherwise(F.lit(0)))
    return joined.groupBy(*by).agg(part(~F.col("is_neutral")).alias("denom"), part(F.col("is_strict")).alias("strict_n"), part(F.col("is_cumulative")).alias("cumulative_n"))


def percentages(sums: DataFrame) -> DataFrame:
    keys = [c for c in sums.columns if c not in ("denom", "strict_n", "cumulative_n")]
    return sums.select(*keys, "denom", F.round(share(F.col("strict_n"), F.col("denom")), 6).alias("strict_pct"), F.round(share(F.col("cumulative_n"), F.col("denom")), 6).alias("cumulative_pct"))


def agreement(cells: DataFrame, xwalk: DataFrame, *by: str) -> DataFrame:
    """Strict and cumulative percentages of valid cells by group, district or both."""
    return percentages(measures(crosstab(valid(cells), "zone", "lu"), xwalk, *by))


def baseline(cells: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Expected percentages by group if uses were spread over zones at random.

    Uses have their shares among all valid, non-neutral cells; districts weigh as their valid cells, neutral ones included.
    """
    ct = crosstab(valid(cells), "zone", "lu")
    flagged = ct.join(F.broadcast(xwalk), ["zone", "lu"])
    uses = flagged.where("NOT is_neutral").groupBy("lu").agg(F.sum("n").alias("use_n"))
    total = uses.agg(F.sum("use_n").alias("all_n"))
    spread = uses.join(F.broadcast(total)).select("lu", (dbl("use_n") / dbl("all_n")).alias("pi"))  # one row
    weights = ct.groupBy("zone").agg(F.sum("n").alias("w"))
    by_zone = xwalk.join(F.broadcast(spread), "lu").groupBy("zone", "grp").agg(
        F.sum(F.when(F.col("is_strict"), F.col("pi")).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("is_cumulative"), F.col("pi")).otherwise(0.0)).alias("c")
    )
    weighted = by_zone.join(F.broadcast(weights), "zone").groupBy("grp").agg(
        F.sum(dbl("w") * F.col("s")).alias("s"), F.sum(dbl("w") * F.col("c")).alias("c"), F.sum("w").alias("w")
    )
    return weighted.select("grp", F.round(share(F.col("s"), F.col("w")), 6).alias("strict_pct"), F.round(share(F.col("c"), F.col("w")), 6).alias("cumulative_pct"))


def corrected_index(observed: Column, expected: Column) -> Column:
    """(o - e) / (1 - e) of percentages; null if e is 100 or more."""
    o, e = observed / 100.0, expected / 100.0
    return F.when(e < 1, (o - e) / (1 - e))


def corrected(observed: DataFrame, expected: DataFrame, on: str = "grp") -> DataFrame:
    e = expected.select(on, F.col("strict_pct").alias("e_strict"), F.col("cumulative_pct").alias("e_cumulative"))
    joined = observed.join(F.broadcast(e), on)
    return joined.select(on, F.round(corrected_index(F.col("strict_pct"), F.col("e_strict")), 6).alias("strict_index"), F.round(corrected_index(F.col("cumulative_pct"), F.col("e_cumulative")), 6).alias("cumulative_index"))
