"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with the share s of all characters and the target weight w gets the mean repetition rate r = epochs * w / s. Each
document is repeated as often as a Poisson distribution with mean r says, inverted at a number in [0, 1) that a seeded hash of
the document gives; the copies are dealt out and ordered by a second hash. Poisson counts need no coordination between
documents, and they keep every source's expected volume at its target.

The distribution is tabulated once per source. For a rate above `chunk` the count is the sum of n independent counts with the
rate r / n, so that no tail is cut off: a table reaches to where the distribution function is 1 in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, text_of, unused


@dataclass(frozen=True)
class Mixture:
    """weights: target weight by source, of any sum; a source that is not named gets `other`. Without weights, a source with the
    share s gets s ** temper, the usual way to raise small sources. epochs: mean number of passes over the whole corpus."""

    weights: tuple[tuple[str | None, float], ...] = ()
    other: float = 0.0
    temper: float = 0.5
    epochs: float = 1.0
    seed: int = 17
    chunk: float = 8.0
    steps: int = 63


def unit(key: Column, *salt: Column | int) -> Column:
    """A number in [0, 1) with 52 bits, from md5 of the key and the salts."""
    named = F.concat_ws(":", key, *[F.lit(str(x)) if isinstance(x, int) else x.cast("string") for x in salt])
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, p: Mixture = Mixture(), source: str = "source") -> DataFrame:
    """(source, rate, n_chunks, table): a row for each source; table[k] is the chance of at most k copies in a chunk.

    Two sums come to the driver; the table of sources does not.
    """
    size = F.sum(F.char_length(text_of())).alias("size")
    sized = stored(docs.groupBy(F.col(source).cast("string").alias("source")).agg(size), "sizes")
    total = float(sized.agg(F.sum("size").alias("n")).first()["n"] or 0)
    share = F.col("size") / F.lit(total) if total else F.lit(0.0)
    if p.weights:
        weight = F.lit(p.other)
        for name, w in p.weights:
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    else:
        weight = F.pow(share, F.lit(p.temper))
    weighted = sized.select("source", share.alias("share"), weight.alias("weight"))
    norm = float(weighted.agg(F.sum(F.round("weight", 12)).alias("n")).first()["n"] or 0)
    rate = F.when(F.col("share") > 0, F.lit(p.epochs) * F.col("weight") / F.lit(norm) / F.col("share")).otherwise(F.lit(p.epochs)) if norm else F.lit(p.epochs)
    rated = weighted.select("source", F.round(rate, 9).alias("rate"))
    chunks = F.greatest(F.ceil(F.col("rate") / p.chunk), F.lit(1)).cast("int")
    split = rated.withColumn("n_chunks", chunks).withColumn("mean", F.col("rate") / F.col("n_chunks"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        chance = acc["p"] * F.col("mean") / k
        return F.struct(chance.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + chance)).alias("sums"))

    return split.select("source", "rate", "n_chunks", F.aggregate(F.sequence(F.lit(1), F.lit(p.steps)), first, step)["sums"].alias("table"))


def mix_sources(docs: DataFrame, p: Mixture = Mixture(), source: str = "source", text: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as drawn, in a global random order, with __copy (from 0) and __place (the order).

    Rows are sorted by __place over all partitions. Equal rows (same doc_id, same text) draw the same count, each for itself.
    Null sources are a source; null texts have no characters but are drawn at their source's rate. If there are no characters
    at all, every rate is `epochs`. An empty table gives no rows. All columns are kept, whatever their names; those named __copy or
    __place are replaced. Equal rows have equal places and follow each other in no stated order, which cannot be told apart.
    """
    known = rates(docs.select(F.col(source).alias("source"), F.col(text).alias("text")), p)
    names = [c for c in docs.columns if c not in ("__copy", "__place")]
    id_, own, chunks, table, zero = unused(docs, "key", "source", "chunks", "table", "0")
    shared = stored(known.select(F.col("source").alias(own), F.col("n_chunks").alias(chunks), F.col("table").alias(table)), "rates")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    keyed = docs.select(*names, key.alias(id_))
    # sources are few as a rule and the join is planned by size; with many, skewed sources are split
    joined = keyed.join(shared, F.col(source).cast("string").eqNullSafe(F.col(own)))
    draws = F.transform(F.sequence(F.lit(1), F.col(chunks)), lambda j: unit(F.col(id_), p.seed, j))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(table), lambda c: c <= u)))
    copies = joined.select(*names, id_, F.posexplode(F.array_repeat(F.lit(0), count)).alias("__copy", zero))
    place = unit(F.col(id_), p.seed + 1, F.col("__copy"))
    return copies.select(*names, F.col("__copy"), place.alias("__place")).orderBy("__place", "doc_id", "__copy")
