"""Quality rules: cross-document line frequency per host, beside a few rules on single documents.

Normalised lines are hashed; each (host, line) is counted over the distinct documents of the host that hold it, so neither a line
that a document repeats nor a document that a host repeats counts twice. A line above both limits, a number of documents and a
share of its host's documents, is taken out, and a document that is left with too little is rejected. The share keeps the
verdict alike at every size: what twenty pages of a hundred share is a template, what twenty of a million share is chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import stored, text_of, unused

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class QualityRules:
    """min_words, repeat_percent: the rules on one document. line_docs, line_permille: a line in more distinct documents of a
    host, and in a larger share of them, is taken out. left_words, left_percent: a document is rejected if fewer words and a
    smaller share of its words are left."""

    min_words: int = 50
    repeat_percent: int = 50
    line_docs: int = 20
    line_permille: int = 10
    left_words: int = 50
    left_percent: int = 50


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row columns..., text) to (row columns..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines).

    lines: (h, n_words) of each line with a word, as a list.
    """
    kind = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    for batch in batches:
        for block in K.blocks(batch.column(batch.num_columns - 1)):
            n = block.hi - block.lo
            w = K.words(block)
            docs, first = w.docs(), w.first
            upto = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            chars = np.bincount(docs, upto[w.ends] - upto[w.starts], minlength=n).astype(np.int64)
            marks = np.concatenate([[0], np.cumsum(SYMBOLS[block.data])])
            symbols = marks[block.bounds[1:]] - marks[block.bounds[:-1]]
            hashes = K.word_hashes(block, w)
            # windows of three words met twice in the document
            got, at = K.windows(hashes, first, 3)
            order = np.lexsort((got, docs[at]))
            g, d = got[order], docs[at][order]
            same = np.flatnonzero((g[1:] == g[:-1]) & (d[1:] == d[:-1]))
            again = np.zeros(len(got), dtype=bool)
            again[order[same]] = again[order[same + 1]] = True
            covered = np.zeros(len(hashes), dtype=bool)
            for k in range(3):
                covered[at[again] + k] = True
            repeats = np.bincount(docs[covered], minlength=n)
            # lines: the words between two \n; white space in a line counts for being equal, so hash the line's bytes
            cuts = np.flatnonzero(block.data == 10)
            begin = np.unique(np.concatenate([block.bounds[:-1], cuts + 1]))
            begin = begin[begin < len(block.data)]
            end = np.append(begin[1:], len(block.data))
            end = np.where(np.isin(end - 1, cuts), end - 1, end)
            line_doc = np.searchsorted(block.bounds, begin, side="right") - 1
            line_first, line_last = np.searchsorted(w.starts, begin), np.searchsorted(w.starts, end)
            has = line_last > line_first
            begin, end, line_doc, line_first, line_last = (x[has] for x in (begin, end, line_doc, line_first, line_last))
            exact = K.FIRST.spans(K.FIRST.byte[block.data], begin, end)
            order = np.lexsort((np.arange(len(exact)), exact, line_doc))
            e, d = exact[order], line_doc[order]
            dup_lines = np.bincount(d[1:][(e[1:] == e[:-1]) & (d[1:] == d[:-1])], minlength=n)
            # normalised: lower-case ASCII letters, white space runs as one
            low = K.word_hashes(block, w, lower=True)
            line = K.SECOND.spans(low, line_first, line_last)
            counts = np.bincount(line_doc, minlength=n)
            structs = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array((line_last - line_first).astype(np.int32))], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs)
            columns = [batch.column(i).slice(block.lo, n) for i in range(batch.num_columns - 1)]
            columns += [pa.array(x.astype(np.int64)) for x in (w.counts, chars, symbols, dup_lines, repeats)] + [lists]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>"


def common_lines(measured: DataFrame, p: QualityRules) -> DataFrame:
    """(host, h): the lines above both limits of their host. `measured` has host, key (of the text) and lines.

    A host has at most 1000 / line_permille of them for each line of a mean document, however large it is.
    """
    held = measured.select("host", "key", F.explode(F.array_distinct("lines.h")).alias("h")).distinct()
    often = held.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > p.line_docs)
    hosts = measured.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("all"))
    both = often.alias("o").join(hosts.alias("a"), F.col("o.host").eqNullSafe(F.col("a.host")))
    return both.where(1000 * F.col("docs") > p.line_permille * F.col("all")).select("o.host", "h")


def quality_verdicts(docs: DataFrame, p: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """One row for each distinct (doc_id, text, host): doc_id, key, the measures, n_left_words, base_failed, kept, n_rows.

    key is a hash of the text, n_rows the number of equal rows. Null text has no words (base_failed); a null host is a host of
    its own. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_of().alias("text")).select("doc_id", "host", F.xxhash64("text").alias("key"), "text")
    # hashes of lines are few bytes; stored, texts are parsed once
    measured = stored(rows.mapInArrow(measure, f"doc_id {dict(docs.dtypes)['doc_id']}, host string, key long, {MEASURES}"), "measured")
    common = common_lines(measured, p)
    names = ["doc_id", "host", "key"]
    of_doc = measured.select(*names, F.explode("lines").alias("l")).select(*names, "l.h", "l.w")
    # shuffled to the frequent lines by line; hot lines are split, as nothing above the join needs a line's rows together
    met = of_doc.alias("d").join(common.alias("c"), F.col("d.host").eqNullSafe(F.col("c.host")) & (F.col("d.h") == F.col("c.h"))).select("doc_id", "d.host", "key", "w")
    zero = F.lit(0).cast("long")
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    parts = measured.select(*names, *numbers, zero.alias("gone"), F.lit(1).cast("long").alias("n_rows")).unionByName(met.select(*names, *[zero.alias(x) for x in numbers], F.col("w").cast("long").alias("gone"), zero.alias("n_rows")))
    summed = parts.groupBy(*names).agg(*[F.sum(x).alias(x) for x in [*numbers, "gone", "n_rows"]])
    each = summed.select(*names, *[F.expr(f"{x} div n_rows").alias(x) for x in [*numbers, "gone"]], "n_rows")
    left = F.col("n_words") - F.col("gone")
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))
    depleted = (left < p.left_words) & (100 * left < p.left_percent * F.col("n_words"))
    return each.withColumn("n_left_words", left).withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def keep_good(docs: DataFrame, p: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """The rows of `docs` whose verdict is kept, with all their columns unchanged, whatever these are named.

    Nulls and repeated rows are as in quality_verdicts; rows that repeat one another are all kept or all rejected.
    """
    i, h, k = unused(docs, "id", "host", "key")
    good = quality_verdicts(docs, p, host).where("kept").select(F.col("doc_id").alias(i), F.col("host").alias(h), F.col("key").alias(k))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col(host).cast("string").eqNullSafe(F.col(h)) & (F.xxhash64(text_of()) == F.col(k))
    return docs.join(good, same, "left_semi")
