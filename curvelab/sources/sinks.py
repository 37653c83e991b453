"""What goes out: CSV and JSON exports of curves and results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.window import Window

from curvelab.functions.text import fixed

# fixed values
STRAIN, STRESS, PIXEL_X, PIXEL_Y = "Strain (%)", "Stress (kN/m²)", "Pixel_X", "Pixel_Y"


def csv_rows(points: DataFrame, pixels: bool = False, decimals: int = 4, key: list[str] | None = None, smoothed: bool = False) -> DataFrame:
    """points (strain, stress[, pixel_x, pixel_y, smoothed]) as the export's text columns; a pixel of 0 is blank."""
    if not 1 <= decimals <= 10:
        raise ValueError("decimals must be between 1 and 10")
    shown = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, "").otherwise(F.col(c).cast("string"))
    more = [shown("pixel_x").alias(PIXEL_X), shown("pixel_y").alias(PIXEL_Y)] if pixels else []
    if smoothed:
        more.append(fixed(F.col("smoothed"), decimals).alias("Smoothed"))
    return points.select(*(key or []), fixed(F.col("strain"), decimals).alias(STRAIN), fixed(F.col("stress"), decimals).alias(STRESS), *more)


def write_csv(points: DataFrame, path: str, pixels: bool = False, decimals: int = 4, separator: str = ",", mode: str = "error", smoothed: bool = False, blank: str = '""', key: list[str] | None = None) -> None:
    """Lines end with carriage return and line feed; ``blank`` is how an empty cell is written, "" for a bare one."""
    out = csv_rows(points.orderBy("strain") if "idx" not in points.columns else points.orderBy("idx"), pixels, decimals, key, smoothed)
    out.write.mode(mode).option("header", True).option("sep", separator).option("lineSep", "\r\n").option("emptyValue", blank).csv(path)


def write_binary(files: DataFrame, path: str) -> None:
    """A file for every row (name, content), whatever is in it; a task that runs again writes the same files again."""

    def run(batches):
        fs, folder = FileSystem.from_uri(path)
        fs.create_dir(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content or b"")
            yield b.select(["name"])

    files.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


class _FilesWriter(DataSourceArrowWriter):
    """Writes runs of rows (name, line) to a file a name. A task that runs again writes the same files again, so nothing is there twice or in part."""

    def __init__(self, path: str, header: str, end: str):
        self.path, self.header, self.end = path, header, end

    def write(self, batches):
        fs, folder = FileSystem.from_uri(self.path)
        attempt, names, out, n = uuid.uuid4().hex, [], None, 0

        def close() -> None:
            nonlocal n
            if out is not None:
                n += out.tell()
                out.close()
                fs.move(f"{folder}/_writing/{attempt}-{len(names)}", f"{folder}/{names[-1]}")  # a file is there whole or not at all

        fs.create_dir(f"{folder}/_writing")
        for b in batches:
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not names or names[-1] != name:
                    close()
                    names.append(name)
                    out = fs.open_output_stream(f"{folder}/_writing/{attempt}-{len(names)}")
                    out.write((self.header + self.end).encode())
                out.write((line + self.end).encode())
        close()
        if names:  # what a task has written, as a list beside the files
            fs.create_dir(f"{folder}/_lists")
            with fs.open_output_stream(f"{folder}/_lists/{names[0]}") as listed:
                listed.write("\n".join(names).encode())
        return _Written(len(names), n)

    def commit(self, messages):
        fs, folder = FileSystem.from_uri(self.path)
        fs.create_dir(folder)
        done = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(f"{sum(m.files for m in done)} files, {sum(m.size for m in done)} bytes\n".encode())

    def abort(self, messages):
        fs, folder = FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{folder}/_writing").type.name == "Directory":
            fs.delete_dir(f"{folder}/_writing")


@dataclass
class _Written(WriterCommitMessage):
    files: int
    size: int


class FilePerName(DataSource):
    """A data source that writes rows (name, line) to a file a name; rows of a name must be successive, and in one partition."""

    @classmethod
    def name(cls) -> str:
        return "file_per_name"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool):
        return _FilesWriter(self.options["path"], self.options.get("header", ""), self.options.get("end", "\r\n"))


def write_csv_files(points: DataFrame, path: str, key: str, pixels: bool = False, decimals: int = 4, separator: str = ",", smoothed: bool = False, order: str = "idx") -> None:
    """A CSV file for every value of ``key``, named after it (``<key>.csv``, other letters than plain ones percent-coded), its rows in order; files of keys that are written again are replaced.

    A key's rows are sorted together and streamed to its file, so a long one needs no memory; a path that the tasks' file system library knows.
    """
    shown = csv_rows(points.withColumns({"_key": F.col(key), "_order": F.col(order)}), pixels, decimals, ["_key", "_order"], smoothed)
    cells = [c for c in shown.columns if c not in ("_key", "_order")]
    name = F.concat(F.replace(F.url_encode(F.col("_key").cast("string")), F.lit("+"), F.lit("%20")), F.lit(".csv"))
    lines = shown.where("_key is not null").select(name.alias("name"), "_order", F.concat_ws(separator, *[F.col(f"`{c}`") for c in cells]).alias("line"))
    points.sparkSession.dataSource.register(FilePerName)
    dealt = lines.repartition("name").sortWithinPartitions("name", "_order").select("name", "line")
    dealt.write.format("file_per_name").mode("append").option("path", path).option("header", separator.join(cells)).save()


def completed(jobs: DataFrame) -> DataFrame:
    """The jobs that may be exported."""
    return jobs.where(F.col("status") == "completed")


def result_json(points: DataFrame, features: DataFrame, first: int = 10) -> DataFrame:
    """(curve_id, json): the first points, how many there are, and the features of each curve. Only the points shown are put together."""
    shown = F.struct("idx", F.bround("strain", 4).alias("strain"), F.bround("stress", 2).alias("stress"))
    few = points.withColumn("_r", F.row_number().over(Window.partitionBy("curve_id").orderBy("idx"))).where(F.col("_r") <= first)
    head = few.groupBy("curve_id").agg(F.sort_array(F.collect_list(shown)).alias("head"))
    total = points.groupBy("curve_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    rest = [c for c in features.columns if c != "curve_id"]
    bare = F.transform("head", lambda v: F.struct(v["strain"].alias("strain"), v["stress"].alias("stress")))
    return head.join(total, "curve_id").join(features, "curve_id").select("curve_id", F.to_json(F.struct(bare.alias("data_points"), F.col("total").alias("total_points"), F.struct(*rest).alias("features"))).alias("json"))


def chart_json(results: DataFrame, first: int | None = None) -> DataFrame:
    """(image_id, json): the whole record of each chart that ``extraction.extract`` gives: points (the first ones only, if asked for) and their number, features,
    critical points, axes, confidence, method, units, and the reason of a failure. Nulls are written as nulls."""
    points = F.col("data_points") if first is None else F.slice("data_points", 1, first)
    rest = [c for c in results.columns if c not in ("image_id", "data_points")]
    record = F.struct("image_id", points.alias("data_points"), F.size(F.coalesce("data_points", F.array().cast(results.schema["data_points"].dataType))).alias("total_points"), *rest)
    return results.select("image_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; without that, and with a local master only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_curvelab_folder", None)
        if not folder:
            folder = spark._curvelab_folder = "file://" + tempfile.mkdtemp(prefix="curvelab-")
    return folder.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/curvelab/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms, whatever store the path is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                fs, target = file_system(spark, path)
                fs.delete(target, True)
        except Exception:  # the session may be gone; the folder's owner then clears it
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder: what made it runs once, however often it is read, and a lost executor does not repeat it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
