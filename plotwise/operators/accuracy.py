"""Design-based accuracy of a map from a stratified sample (Olofsson et al. 2014).

Samples and their design are small; their tables are joined to each other, one row for each stratum and class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def d(name: str):
    return F.col(name).cast("double")


def error_matrix(sample: DataFrame, design: DataFrame) -> DataFrame:
    """(stratum, ref, n, p): counts and area proportions. `sample`: (stratum, ref); `design`: (stratum, size)."""
    weights = design.select("stratum", (d("size") / F.sum("size").over(Window.partitionBy())).alias("w"))
    n_h = sample.groupBy("stratum").agg(F.count("*").alias("n_h"))
    n_hj = sample.groupBy("stratum", "ref").agg(F.count("*").alias("n"))
    joined = n_hj.join(F.broadcast(n_h), "stratum").join(F.broadcast(weights), "stratum")
    return joined.select("stratum", "ref", "n", "n_h", "w", (F.col("w") * d("n") / d("n_h")).alias("p"))


def overall(matrix: DataFrame) -> DataFrame:
    """One row: overall accuracy, its standard error and 95 % interval."""
    hit = matrix.where("stratum = ref").select("w", "p", "n_h", (d("n") / d("n_h")).alias("u"))
    sums = hit.agg(F.sum("p").alias("oa"), F.sqrt(F.sum(F.col("w") ** 2 * F.col("u") * (1 - F.col("u")) / (d("n_h") - 1))).alias("se"))
    return sums.select("oa", "se", (F.col("oa") - Z * F.col("se")).alias("lo"), (F.col("oa") + Z * F.col("se")).alias("hi"))


def by_class(matrix: DataFrame, design: DataFrame) -> DataFrame:
    """For each mapped class: user's and producer's accuracy and error-adjusted share, with standard errors."""
    sizes = design.select("stratum", d("size").alias("size"))
    m = matrix.join(F.broadcast(sizes), "stratum").withColumn("u", d("n") / d("n_h"))
    v = F.col("u") * (1 - F.col("u")) / (d("n_h") - 1)
    own = F.col("stratum") == F.col("ref")
    total = m.groupBy("ref").agg(
        F.sum("p").alias("share"),
        F.sqrt(F.sum(F.col("w") ** 2 * v)).alias("share_se"),
        F.sum(F.col("size") * F.col("u")).alias("n_hat"),
        F.sum(F.when(own, F.col("p")).otherwise(0.0)).alias("p_jj"),
        F.max(F.when(own, F.col("u"))).alias("users"),
        F.max(F.when(own, d("n_h"))).alias("n_j"),
        F.max(F.when(own, F.col("size"))).alias("size_j"),
        F.sum(F.when(~own, F.col("size") ** 2 * v).otherwise(0.0)).alias("others"),
    )
    users = F.col("users")
    producers = F.col("p_jj") / F.col("share")
    a = F.col("size_j") ** 2 * (1 - producers) ** 2 * users * (1 - users) / (F.col("n_j") - 1)
    b = producers**2 * F.col("others")
    return total.where("users IS NOT NULL").select(
        F.col("ref").alias("cls"), "users", F.sqrt(users * (1 - users) / (F.col("n_j") - 1)).alias("users_se"),
        producers.alias("producers"), (F.sqrt(a + b) / F.col("n_hat")).alias("producers_se"), "share", "share_se",
    )


def ratio_estimate(sample: DataFrame, design: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """One row: the stratified combined ratio of y to x, its linearised standard error and the number of points with x.

    Means by stratum first; then residuals y - R x, whose sample variance by stratum gives the error.
    """
    weights = design.select("stratum", (d("size") / F.sum("size").over(Window.partitionBy())).alias("w"))
    means = sample.groupBy("stratum").agg(F.avg(d(y)).alias("my"), F.avg(d(x)).alias("mx"), F.sum(x).alias("nx")).join(F.broadcast(weights), "stratum")
    total = means.agg(F.sum(F.col("w") * F.col("my")).alias("mean_y"), F.sum(F.col("w") * F.col("mx")).alias("mean_x"), F.sum("nx").alias("n")).withColumn("ratio", F.col("mean_y") / F.col("mean_x"))
    one = F.broadcast(total.select("mean_x", "ratio", "n"))  # one row
    spread = sample.join(one).groupBy("stratum").agg(F.var_samp(d(y) - F.col("ratio") * d(x)).alias("v"), F.count("*").alias("n_h"), F.max("mean_x").alias("mean_x"), F.max("ratio").alias("ratio"), F.max("n").alias("n"))
    return spread.join(F.broadcast(weights), "stratum").agg(
        F.max("ratio").alias("ratio"), (F.sqrt(F.sum(F.col("w") ** 2 * F.col("v") / d("n_h"))) / F.max("mean_x")).alias("se"), F.max("n").cast("long").alias("n")
    )


def confusion(sample: DataFrame, mapped: str = "pred", ref: str = "ref") -> DataFrame:
    """(mapped, ref, n, users): counts, and each mapped class's user's accuracy."""
    n = sample.groupBy(mapped, ref).agg(F.count("*").alias("n"))
    row = Window.partitionBy(mapped)
    hit = F.sum(F.when(F.col(mapped) == F.col(ref), F.col("n")).otherwise(0)).over(row)
    return n.withColumn("users", hit.cast("double") / F.sum("n").over(row).cast("double"))


def kappa(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n, agreed, agreement and Cohen's kappa of two ratings; kappa is null where chance agreement is 1."""
    n = pairs.groupBy(first, second).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(first) == F.col(second), F.col("n")).otherwise(0)).alias("agreed"))
    a = n.groupBy(F.col(first).alias("c")).agg(F.sum("n").alias("na"))
    b = n.groupBy(F.col(second).alias("c")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "c").agg(F.coalesce(F.sum(d("na") * d("nb")), F.lit(0.0)).alias("e"))
    joined = total.join(F.broadcast(chance))  # one row each
    po, pe = d("agreed") / d("n"), F.col("e") / (d("n") * d("n"))
    return joined.select("n", F.col("agreed").cast("long").alias("agreed"), po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def matrix_table(rows: DataFrame, classes: list[str], prefix: str = "") -> DataFrame:
    """The error matrix (pred, a column for each reference class, n) of rows (pred, ref); references outside `classes` count in n only."""
    each = [F.count(F.when(F.col("ref") == c, 1)).alias(f"{prefix}{c}") for c in classes]
    return rows.groupBy("pred").agg(*each, F.count("*").alias("n"))
