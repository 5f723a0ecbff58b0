"""Helpers of the text operators: written tables, sampled range buckets, word codes."""

from __future__ import annotations

import re
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.session import ensure_checkpoint_dir

#: A splitter holds so many bytes of its text; what follows is told apart by a hash, so nothing is cut off a comparison.
CLIP_BYTES = 64
#: Spark removes the shuffle files of a query when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Range buckets for each shuffle partition, and at most (the list of splitters is part of the plan).
BUCKETS_EACH, BUCKETS_MOST = 8, 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back.

    That cuts the lineage, lets several jobs read one result, and survives the loss of any executor. What the job
    shuffled is removed when it is written. The folder goes with ``discard``, or when the driver's JVM ends.
    ``few``: rows are short, so the last step runs in four tasks a core; a file a shuffle partition costs more than its rows.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode("error").option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    path, files = _folder(spark, folder)
    files.deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(folder)
    table.stored_in = folder
    return table


def _folder(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` returned and that no later job reads."""
    for df in tables:
        path, files = _folder(df.sparkSession, df.stored_in)
        files.delete(path, True)


_LAST: list = []


def alone(memo):
    """``memo``, after the worker's memo of any other operator was emptied: workers are reused, and their memos would add up."""
    if not _LAST or _LAST[0] is not memo:
        for other in _LAST:
            other.clear()
        _LAST[:] = [memo]
    return memo


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what a Python worker holds at once: whole texts come in batches of so many rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sortable(number: Column) -> Column:
    """A 64-bit number as 16 hex digits that sort as the numbers do; null sorts first, with the least number."""
    least = F.lit(-(2**63)).cast("long")
    return F.lpad(F.hex(F.coalesce(number.cast("long"), least).bitwiseXOR(least)), 16, "0")


def range_key(text: Column, *numbers: Column) -> Column:
    """A string whose byte order is that of (first bytes of ``text``, hash of all of ``text``, numbers)."""
    head = F.hex(F.substring(text.cast("binary"), 1, CLIP_BYTES))
    return F.concat(head, F.lit(" "), sortable(F.xxhash64(text)), *[sortable(n) for n in numbers])


def range_bucket(df: DataFrame, key: Column, seed: int = 17) -> Column:
    """The number of a row's range between splitters sampled from ``df``.

    Only the splitters reach the driver: so many for each shuffle partition and 65,536 at most. The sample
    places borders; each row of ``df`` gets a bucket. A key that ends in a row number lets a text that a
    third of the rows share cover as many buckets as its share asks for.
    """
    spark = df.sparkSession
    buckets = min(BUCKETS_EACH * partitions(spark), BUCKETS_MOST)
    rows = df.count()
    if rows == 0:
        return F.lit(0)
    share = min(1.0, 4 * buckets / rows)
    sample = df.where(F.rand(seed) < share).select(key.alias("k")).toPandas()["k"].sort_values().to_list()
    step = max(1, len(sample) // buckets)
    borders = sorted(set(sample[step::step]))
    if not borders:
        return F.lit(0)
    listed = F.split(F.lit(",".join(borders)), ",")
    steps = F.array(*[F.lit(2**p) for p in reversed(range(len(borders).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= len(borders)) & (F.get(listed, at + s - 1) <= key), at + s).otherwise(at))


WORD_EDGE = re.compile(r"^\W+|\W+$")


class WordCodes(dict):
    """Raw token -> 64-bit code of the word in it (lower case, without punctuation at its edges; 0: no word).

    A plain memo that is emptied when it reaches ``most`` entries; a code depends on the token alone.
    """

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        word = WORD_EDGE.sub("", token.lower())
        code = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1) + 1 if word else 0
        if len(self) >= self.most:
            self.clear()
        self[token] = code
        return code
