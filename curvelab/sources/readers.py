"""What comes in: chart images, point lists in JSON, synthetic curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: file endings of the accepted image types
ACCEPTED = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
POINTS = "curve_id string, points array<struct<strain:double,stress:double,pixel_x:int,pixel_y:int>>"


def images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, channels, data, status): decoded images; files of other types and undecodable ones have status failed and no data."""
    df = spark.read.format("image").option("dropInvalid", False).load(path)
    i = F.col("image")
    ok = (i["height"] > 0) & F.lower(i["origin"]).rlike(rf"\.({'|'.join(ACCEPTED)})$")
    return df.select(i["origin"].alias("image_id"), F.when(ok, i["height"]).alias("height"), F.when(ok, i["width"]).alias("width"), F.when(ok, i["nChannels"]).alias("channels"), F.when(ok, i["data"]).alias("data"), F.when(ok, "completed").otherwise("failed").alias("status"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of accepted files, undecoded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(ACCEPTED) + "}").load(path)


def points_json(spark: SparkSession, path: str) -> DataFrame:
    """(curve_id, idx, x, y, pixel_x, pixel_y) of JSON lines with a curve_id and points."""
    df = spark.read.schema(POINTS).json(path)
    return df.select("curve_id", F.posexplode("points").alias("idx", "p")).select("curve_id", "idx", F.col("p.strain").alias("x"), F.col("p.stress").alias("y"), F.col("p.pixel_x").alias("pixel_x"), F.col("p.pixel_y").alias("pixel_y"))


# fixed values of the test curve: its peak and where it lies, the exponents of rise and fall, the share that it falls by and how far
PEAK, PEAK_AT, RISE, FALL, SHARE, BEYOND, END = 4200, 2.5, 0.8, 1.5, 0.4, 3, 5.5


def synthetic_points(curves: DataFrame, noise: float = 30.0, seed: int = 42) -> DataFrame:
    """(curve_id, idx, x, y): a test curve of so many points for each row of ``curves`` (curve_id, points): a rise to 4200 at 2.5 and a fall after it, with normal noise, never below 0."""
    s = F.col("x")
    rise = PEAK * F.pow(s / PEAK_AT, F.lit(RISE))
    fall = PEAK * (1 - SHARE * F.pow(F.greatest(s - PEAK_AT, F.lit(0.0)) / BEYOND, F.lit(FALL)))
    at = curves.where("points > 0").select("curve_id", "points", F.explode(F.sequence(F.lit(0), (F.col("points") - 1).cast("int"))).alias("idx"))
    at = at.select("curve_id", "idx", (F.col("idx") * (END / F.greatest(F.col("points") - 1, F.lit(1)))).alias("x"))
    return at.withColumn("y", F.greatest(F.lit(0.0), F.when(s <= PEAK_AT, rise).otherwise(fall) + noise * F.randn(seed)))


def synthetic_curves(spark: SparkSession, curves: int = 1, points: int = 200, noise: float = 30.0, seed: int = 42) -> DataFrame:
    """(curve_id, idx, x, y): test curves numbered from 0."""
    return synthetic_points(spark.range(curves).select(F.col("id").alias("curve_id"), F.lit(points).alias("points")), noise, seed)


def event_points(events: DataFrame) -> DataFrame:
    """(curve_id, idx, x, y): a curve per user, x in hours since the start of 2024."""
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 3600000000.0
    return events.select(F.col("user_id").alias("curve_id"), F.col("event_id").alias("idx"), hours.alias("x"), F.col("value").alias("y"))
