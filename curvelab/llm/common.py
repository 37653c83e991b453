"""What the training-data operators share: intermediate tables in the shared
folder, and ranks that no single task has to compute alone."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) is a temporary
    folder made and used instead; executors elsewhere would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_curvelab_shared", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="curvelab-")
            spark._curvelab_shared = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/curvelab/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may be gone; the folder's owner then clears it
            return


class Stored:
    """A table written to the shared folder, so that its lineage ends there
    and a lost executor costs no recomputation of what made it."""

    def __init__(self, df: DataFrame, name: str, codec: str | None = None):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        (df.write.option("compression", codec) if codec else df.write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    return Stored(df, name, codec).df


def bucketed(df: DataFrame, key: str, parts: int, name: str, codec: str | None = None) -> DataFrame:
    """A table written to the shared folder in ``parts`` buckets by a key, so that what is grouped by the key later finds it dealt already."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "curvelab_" + path.rpartition("/")[2].replace("-", "_")
    writer = df.write.format("parquet").option("path", path).bucketBy(parts, key)
    (writer.option("compression", codec) if codec else writer).saveAsTable(table)
    return spark.table(table)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Arrow batches hold so many rows at most: what runs over whole texts then holds few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bits of a bitmap of keys: 16 MB, whatever the keys' number.
_ROWS, _BITS = 4096, 32768


def maybe_in(df: DataFrame, key: str, keys: DataFrame, other: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be one of ``keys.other``, rows whose key is none for certain).

    Keys (longs, none null) set a bit each by hash, and a broadcast bitmap of fixed size
    tells before a shuffle what need not go through it. It decides nothing: an exact join follows.
    """
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(_ROWS)), F.pmod(F.shiftright(F.xxhash64(c), 20), F.lit(_BITS)))
    row, bit = place(F.col(other))
    table = keys.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    row, bit = place(F.col(key))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = df.join(F.broadcast(table), row == F.col("_row"), "left").withColumn("_set", F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))).drop("_row", "_bits")
    return told.where("_set").drop("_set"), told.where("not _set").drop("_set")


def unique_names(*names: str, taken: list[str]) -> list[str]:
    """Working column names that clash with none of those taken."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str, spread: Column, groups: int = 0, sizes: str | None = None) -> DataFrame:
    """Add ``out``, a gapless rank from 0 within the groups of ``by``.

    The columns of ``by`` must not be null. A group is dealt over sub-groups by ``spread`` (a long, evenly
    distributed), ``groups`` of them or as many as the column ``sizes`` says;
    rows are ranked within a sub-group, and what the sub-groups before it hold
    is added. So no task gets a whole group, however large one is. Ranks
    follow (sub-group, ``order``); rows equal in both are interchangeable.
    """
    n = F.col(sizes).cast("long") if sizes else F.lit(int(max(1, groups))).cast("long")
    sub = df.withColumn("_sub", F.pmod(spread, F.greatest(n, F.lit(1).cast("long"))).cast("int"))
    before = Window.partitionBy(*by).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sub.groupBy(*by, "_sub").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
        .drop("_n")
    )
    keys = [*by, "_sub"]
    left, right = sub, offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_before")
    same = [left[k] == right[f"_o_{k}"] for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        left.join(right, cond, "inner")
        .withColumn(out, (F.row_number().over(within) - 1).cast("long") + F.col("_before"))
        .drop("_sub", "_before", *[f"_o_{k}" for k in keys])
    )
