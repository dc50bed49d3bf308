"""Recoding of categories, neutral flags, and one category for each cluster of duplicate features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def code_of(value: Column, names: Sequence[str], other: int) -> Column:
    """Position of the value among the names, from 1; `other` for anything else and null."""
    out = F.lit(other)
    for i, name in enumerate(names, 1):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def burn_code(value: Column, names: Sequence[str], neutral: Column, unknown: int, undeveloped: int) -> Column:
    """null: unknown; neutral: undeveloped; else the code."""
    return F.when(value.isNull(), F.lit(unknown)).when(neutral, F.lit(undeveloped)).otherwise(code_of(value, names, unknown))


def is_vacant(text: Column, prefix: str = "Vacant") -> Column:
    return F.coalesce(F.startswith(F.trim(text), F.lit(prefix)), F.lit(False))


def is_neutral(category: Column, detail: Column, neutral: Sequence[str], vacant_as_neutral: bool = True, prefix: str = "Vacant") -> Column:
    """Null and listed categories are neutral; vacant details too, if asked for."""
    flag = category.isNull() | category.isin(*neutral)
    return flag | is_vacant(detail, prefix) if vacant_as_neutral else flag


def fingerprint(geometry: Column) -> Column:
    """md5 of a binary geometry; all nulls have that of nothing."""
    return F.md5(F.coalesce(geometry, F.lit(b"")))


def or_sentinel(value: Column, sentinel: str = "(null)") -> Column:
    return F.coalesce(value, F.lit(sentinel))


def safe_int(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("int")


def cluster_winners(features: DataFrame, cluster: str, category: str, neutral: str, order: str, neutral_first: bool = False) -> DataFrame:
    """(cluster, winner): the most frequent category of each cluster.

    Ties: non-neutral categories first, or neutral ones if asked for, then by name. A category's flag is that of its last member
    by `order`. Counted in two pre-aggregated steps, so a large cluster is no large task.
    """
    counts = features.groupBy(cluster, category).agg(F.count("*").alias("__n"), F.max_by(neutral, order).alias("__neutral"))
    flag = F.col("__neutral").cast("int")
    best = F.struct((-F.col("__n")).alias("n"), (-flag if neutral_first else flag).alias("f"), F.col(category).alias("g"))
    return counts.groupBy(cluster).agg(F.min(best).alias("b")).select(cluster, F.col("b.g").alias("winner"))


def with_winners(features: DataFrame, winners: DataFrame, cluster: str, category: str) -> DataFrame:
    """Each feature with its cluster's winner, its own category where there is none."""
    return features.join(winners, cluster, "left").withColumn("winner", F.coalesce("winner", category))


def duplicate_report(features: DataFrame, cluster: str, area: str) -> DataFrame:
    """One row: features, clusters of two or more, their members, and the area counted more than once."""
    sizes = features.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(area).alias("area"), F.max(area).alias("one"))
    many = F.col("n") > 1
    pick = lambda c: F.coalesce(F.sum(F.when(many, c)), F.lit(0))
    return sizes.agg(F.sum("n").alias("features"), pick(F.lit(1)).cast("long").alias("clusters"), pick(F.col("n")).cast("long").alias("members"), F.round(F.coalesce(F.sum(F.when(many, F.col("area") - F.col("one"))), F.lit(0.0)), 4).alias("multi_area"))


def last_writer(rows: DataFrame, key: str | list[str], value: str, *order: Column) -> DataFrame:
    """One row for each key: the value that is written last in the given order."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias(value))


def top_per_class(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
