"""Sources: control points, CSV and JSON, token lists, Markdown tables, images and paged services."""

from __future__ import annotations

import json
import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import stored

POINTS = "id string, pixel_x double, pixel_y double, lon double, lat double"


def read_control_points(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """Control points of a CSV file; a missing id is the row's ordinal. Fewer than `least` points raise."""
    raw = spark.read.option("header", True).csv(path)
    ordinal = F.monotonically_increasing_id().cast("string")  # a small file is one partition
    given = F.col("id") if "id" in raw.columns else F.lit(None).cast("string")
    out = raw.coalesce(1).select(F.coalesce(given, ordinal).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("pixel_x", "pixel_y", "lon", "lat")])
    if out.limit(least).count() < least:
        raise ValueError(f"{path}: at least {least} control points are needed")
    return out


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def tokens_of(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """(by..., pos, token) of the white-space separated tokens of each text."""
    return texts.select(*by, F.posexplode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias("pos", "token"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token) of a file's white-space separated tokens."""
    return tokens_of(spark.read.text(path, wholetext=True), "value")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """The rows with pos, their place in the order from 0: sorted in ranges, which are numbered on from the counts of those before."""
    dealt = stored(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each range
    placed = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    return placed.join(F.broadcast(before), "__part").withColumn("pos", F.col("__before") + F.col("__r")).drop("__part", "__before", "__r")


def zip_positions(rows: DataFrame, order: str, tokens: DataFrame) -> DataFrame:
    """An ordered table with its tokens (pos, token) by position; different lengths raise."""
    n, m = rows.count(), tokens.count()
    if n != m:
        raise ValueError(f"{n} rows and {m} tokens")
    return numbered(rows, order).join(tokens, "pos").drop("pos")


def markdown_rows(lines: DataFrame, line: str, number: str, by: list[str]) -> DataFrame:
    """(by..., number, cells) of the rows of Markdown tables, without separator rows."""
    is_row = F.trim(line).startswith("|")
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return lines.where(is_row).select(*by, number, cells.alias("cells")).where(~F.forall("cells", lambda x: x.rlike("^:?-+:?$")))


def markdown_table(spark: SparkSession, text: str, header_contains: str) -> list[dict[str, str]]:
    """The rows of the first table whose header has the words; of equal headers the last wins."""
    lines = [x.strip() for x in text.splitlines()]
    for i, x in enumerate(lines):
        if x.startswith("|") and header_contains in x:
            head = [c.strip() for c in x.strip("|").split("|")]
            out = []
            for row in lines[i + 2 :]:
                if not row.startswith("|"):
                    break
                out.append(dict(zip(head, [c.strip() for c in row.strip("|").split("|")], strict=False)))
            return out
    return []


def read_json(spark: SparkSession, path: str, schema: str, default: str | None = None) -> DataFrame:
    """A JSON file by schema; a missing file is the default document, if one is given."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception:
        if default is None:
            raise
        text = spark.createDataFrame([(default,)], "value string")
    return text.select(F.from_json("value", schema).alias("j")).select("j.*")


def grey_pixels(images: DataFrame) -> DataFrame:
    """(path, row, col, grey) of Spark's image source (origin, height, width, nChannels, data in BGR order)."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, h, w, n, data in pdf.itertuples(index=False):
                x = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n).astype(float)
                y = x[:, :, 0] if n == 1 else 0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2]
                row, col = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"path": path, "row": row, "col": col, "grey": np.clip(y, 0, 255).astype(np.uint8).ravel().astype(np.int32)})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "path string, row long, col long, grey int")


class PagedSource(DataSource):
    """`paged`: a service that gives ids, and features for chunks of ids, as JSON.

    Options: url (with {ids} where a chunk's ids go), ids (comma-separated or from ids_url), chunk, tries. A partition is a chunk of
    ids; each is tried again with doubling pauses, and an answer with an `error` key counts as a failure.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id long, feature string"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(dict(self.options))


class Chunk(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def get(self, url: str) -> dict:
        tries = int(self.options.get("tries", 6))
        for i in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 120))) as f:
                    answer = json.load(f)
                if "error" not in answer:
                    return answer
                failure: Exception = OSError(str(answer["error"]))
            except OSError as e:
                failure = e
            if i + 1 < tries:
                time.sleep(float(self.options.get("pause", 1)) * 2**i)
        raise failure

    def partitions(self) -> list[Chunk]:
        ids = self.options.get("ids")
        numbers = sorted(int(x) for x in ids.split(",")) if ids else sorted(self.get(self.options["ids_url"])["ids"])
        n = int(self.options.get("chunk", 2000))
        return [Chunk(numbers[i : i + n]) for i in range(0, len(numbers), n)]

    def read(self, partition: Chunk):
        answer = self.get(self.options["url"].replace("{ids}", ",".join(map(str, partition.ids))))
        for f in answer["features"]:
            yield int(f["id"]), json.dumps(f)


def is_loaded(target: DataFrame, ids: DataFrame) -> bool:
    """Whether a load can be left out: the target has as many rows as there are ids."""
    return target.count() == ids.count()
