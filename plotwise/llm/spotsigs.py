"""Document fingerprints by SpotSigs (Theobald, Siddharth, Paepcke 2008), in DataFrame functions only.

A spot signature starts at an anchor, a very common word, and is the chain of the next `chain` content words after it, common words
passed over. A document's fingerprint is the set of its signatures. Sets are compared by Jaccard similarity; for pairs over all
documents they are partitioned by their size, since sets whose sizes differ too much cannot be similar, and only sets that share
one of their rarest signatures are compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_of

#: Very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it its of on or she that the they this to was were which with you "
    "als auf aus bei das dem den der des die ein eine einer es für hat im ist mit nicht sich sie sind und von war wie zu "
    "au aux avec ce dans de du elle en est et il la le les ne ou par pas pour qui que sa se son sur un une "
    "al como con del el esta la las lo los más no para pero por se son su sus una y"
).split()

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‚‘’…–—·¡¿"


@dataclass(frozen=True)
class SpotSigs:
    """anchors: the common words. chain: content words in a signature. similarity: of a pair. bands of sizes grow by it."""

    anchors: tuple[str, ...] = tuple(dict.fromkeys(ANCHORS))
    chain: int = 2
    similarity: float = 0.8


def signatures(text: Column, p: SpotSigs = SpotSigs()) -> Column:
    """The sorted distinct signatures of a text, as 64-bit hashes.

    Words are cut at white space, in lower case, without punctuation at their ends. A text without a full chain has its whole
    normalised text for its one signature, so that different short texts differ; the empty text has one too.
    """
    bare = lambda w: F.btrim(w, F.lit(PUNCTUATION))
    words = F.array_remove(F.transform(F.split(F.lower(text), r"\s+"), bare), "")
    padded = F.concat(F.array_join(words, " "), F.lit(" "))
    # `~`, which no word starts with, stands for the common words
    marked = F.concat(F.array_join(F.transform(words, lambda w: F.when(w.isin(*p.anchors), F.lit("~")).otherwise(w)), " "), F.lit(" "))
    gap = "(?:~ )*+"
    content = "([^ ~][^ ]*+ )"
    chain = f"(?<![^ ])~ (?={gap}({content}{(gap + content) * (p.chain - 1)}))"
    found = F.regexp_extract_all(marked, F.lit(chain), F.lit(1))
    hashes = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.xxhash64(F.replace(x, F.lit("~ "), F.lit(""))))))
    return F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.xxhash64(padded)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def as_string(sigs: Column) -> Column:
    """A fingerprint as text: its signatures in hexadecimal."""
    return F.array_join(F.transform(sigs, lambda x: F.hex(x)), " ")


def dealt(own: DataFrame, per: int = 8) -> DataFrame:
    """`own` with `bucket`: ranges of the order (rid, key) from the largest down, about the root of the number of rows, with about as
    many rows each however the ids are spread.

    The bounds are taken from a sample of some `per` rows a range, chosen by hash, and found in two steps of the root of their
    number, so that a row costs little.
    """
    n = own.count()
    ranges = max(1, math.isqrt(n))
    narrow = own.select("has", "rid", "key")
    part = max(1, n // (per * ranges))
    some = narrow.where(F.pmod(F.xxhash64("has", "rid", "key", F.lit(3)), F.lit(part)) == 0).collect()  # per * ranges rows or so
    places = sorted({(r["has"], r["rid"], r["key"]) for r in some}, reverse=True)
    bounds = [places[i * len(places) // ranges] for i in range(1, ranges)] if len(places) >= ranges else places[1:]
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    place = "struct<has:int,rid:bigint,key:bigint>"
    table = own.sparkSession.createDataFrame([([g[-1] for g in groups], groups)], f"tops array<{place}>, groups array<array<{place}>>")
    me = F.struct("has", "rid", "key")
    above = lambda bounds_: F.size(F.filter(bounds_, lambda x: x > me))
    found = own.crossJoin(F.broadcast(table)).withColumn("__g", above(F.col("tops")))  # one row
    inside = F.coalesce(above(F.try_element_at(F.col("groups"), F.col("__g") + 1)), F.lit(0))
    return found.withColumn("bucket", (F.col("__g") * step + F.greatest(inside, F.lit(0))).cast("long")).drop("tops", "groups", "__g")


def with_next(own: DataFrame, derive, *columns: str) -> DataFrame:
    """`own` (has, rid, key, text...), with what `derive` adds to a frame, once for each distinct (has, rid, key), with n_rows and
    next_<column> of the next one in descending order; after the last one the first. `has` is 1 where there is an id, else 0.

    Rows are dealt out by ranges of the order; so texts are shuffled once and no range is large. A range's last row has the first
    of the next range for its next, and those are found by one narrow row for each range.
    """
    placed = dealt(own)
    first = stored(placed.groupBy("bucket").agg(F.max(F.struct("has", "rid", "key")).alias("head")), "heads")
    along = Window.orderBy("bucket")  # one row for each range
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select("bucket", F.coalesce(F.lead("head").over(along), F.first("head").over(whole)).alias("head")).select("bucket", "head.*")
    # a row for each range, the root of all rows
    named = derive(own.join(F.broadcast(stored(heads, "heads")), ["has", "rid", "key"])).groupBy("bucket").agg(*[F.first(c).alias(f"head_{c}") for c in columns])
    texts = derive(placed.repartition("bucket"))
    same = Window.partitionBy("bucket", "has", "rid", "key").orderBy(F.lit(1))
    every = Window.partitionBy("bucket", "has", "rid", "key")
    once = texts.withColumn("n_rows", F.count("*").over(every)).withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")
    back = Window.partitionBy("bucket").orderBy("has", "rid", "key")
    chained = once.withColumn("__first", F.lag("rid").over(back).isNull()).withColumns({f"next_{c}": F.lag(c).over(back) for c in columns})
    joined = chained.join(named, "bucket")
    return joined.withColumns({f"next_{c}": F.when(F.col("__first"), F.col(f"head_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}).drop("bucket", "__first", *[f"head_{c}" for c in columns])


def edited_fingerprints(docs: DataFrame, p: SpotSigs = SpotSigs()) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) characters replaced by the first as many, or all, of the next document by
    descending doc_id (after the last: the first). Null text is empty. Equal rows are one document and have equal results; texts
    that share a doc_id follow each other by their hash; a null doc_id comes last. An only document is its own next. An empty
    table gives no rows; other columns are not read.
    """
    known = F.col("doc_id").isNotNull().cast("int")
    own = docs.select("doc_id", known.alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("rid"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    joined = with_next(own, lambda df: df.withColumn("sigs", signatures(F.col("text"), p)), "text", "sigs")
    n = F.char_length("text")
    keep = (n - F.floor(n / 3)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 3).cast("int")))
    signed = joined.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited"), p))
    each = signed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return each.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sigs")).alias("fingerprint"),
        as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_sets(sets: DataFrame, p: SpotSigs = SpotSigs()) -> DataFrame:
    """(a, b, sim) for the pairs a < b of different sets among `sets` (id, sigs) with a likeness of at least p.similarity.

    Equal sets are one, named by their least id (see set_names). Sizes are cut into bands that grow by 1 / similarity: a set can
    only be similar to sets in its own band and the two beside it. A set is represented by its rarest signatures, as many as a
    similar set cannot miss all of; pairs that meet there are pruned by their sizes before their sets are compared.
    """
    step = math.log(1 / p.similarity)
    band = F.floor(F.log(F.size("sigs").cast("double")) / step)
    known = stored(sets.groupBy("sigs").agg(F.min("id").alias("id")).select("id", "sigs", F.size("sigs").alias("n"), band.alias("band")), "sets")
    each = known.select("id", "n", "band", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("id").orderBy("often", "sig")
    need = F.col("n") - F.ceil(F.col("n") * p.similarity) + 1
    prefix = each.join(often, "sig").withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= need).where("often > 1").select("id", "n", "band", "sig")
    near = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "sig")
    met = prefix.withColumnRenamed("id", "a").join(near, ["sig", "band"]).where((F.col("a") < F.col("b")) & (F.least("n", "nb") >= F.greatest("n", "nb") * p.similarity)).select("a", "b").distinct()
    left, right = (known.select(F.col("id").alias(k), F.col("sigs").alias(f"sigs_{k}")) for k in "ab")
    sim = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("sim"))
    return sim.where(F.col("sim") >= p.similarity)


def set_names(sets: DataFrame) -> DataFrame:
    """(id, name): the name, in similar_sets, of each id's set."""
    return sets.join(sets.groupBy("sigs").agg(F.min("id").alias("name")), "sigs").select("id", "name")
