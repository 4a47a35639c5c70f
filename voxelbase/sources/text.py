"""Text formats: frame geometry, spectra, material tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_COLUMNS = [f"{p}_{a}" for p in ("source", "centre", "u", "v") for a in "xyz"]


def _numbers(spark: SparkSession, path: str, columns: list[str], most: float) -> DataFrame:
    """Rows of ``columns`` numbers in file order; blank, comment and header lines are passed over, odd lines stop the query."""
    rows = spark.read.text(path).withColumn("place", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id")))
    rows = rows.withColumn("value", F.trim("value")).where(r"value <> '' and value not like '#%' and not value rlike '^[A-Za-z_]'")
    parts = F.transform(F.split("value", r"[,\s]+"), lambda x: x.try_cast("double"))
    bad = (F.size(parts) != len(columns)) | F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("odd line: "), F.col("value"))).cast("array<double>")).otherwise(parts)
    rows = rows.select("place", checked.alias("p"))
    return rows.select("place", *(F.col("p")[i].alias(c) for i, c in enumerate(columns)))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(view, src, centre, u, v): 12 numbers a line, numbered in file order (a scan's table is small)."""
    rows = _numbers(spark, path, FRAME_COLUMNS, 1e8)
    vec = lambda p: F.struct(*(F.col(f"{p}_{a}").alias(a) for a in "xyz"))
    view = F.row_number().over(Window.orderBy("place")) - 1
    return rows.select(view.alias("view"), vec("source").alias("src"), vec("centre").alias("centre"), vec("u").alias("u"), vec("v").alias("v"))


def write_frames(frames: DataFrame, path: str) -> None:
    cols = [F.format_string("%.17g", F.col(f"{p}.{a}")) for p in ("src", "centre", "u", "v") for a in "xyz"]
    frames.orderBy("view").select(F.concat_ws(",", *cols)).coalesce(1).write.text(path)  # one line a view, in order


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """(energy, fluence, width): energies rise, widths are positive, fluences not negative; else the query stops."""
    rows = _numbers(spark, path, ["energy", "fluence", "width"], 1e30).drop("place")
    last = F.lag("energy").over(Window.orderBy("energy"))
    bad = (F.col("width") <= 0) | (F.col("fluence") < 0) | (F.col("energy") <= 0) | (F.col("energy") == last)
    return rows.withColumn("ok", F.when(bad, F.raise_error(F.lit("odd spectrum bin")).cast("boolean")).otherwise(True)).where("ok").drop("ok")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(medium_id, name, density, element, fraction) of a wide table of element fractions, normalised by their sum."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    keys = [c for c in ("id", "sex", "medium_id", "name", "density", "source") if c in wide.columns]
    elements = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, elements, "element", "fraction").withColumn("fraction", F.col("fraction").cast("double")).where("fraction > 0")
    total = F.sum("fraction").over(Window.partitionBy(*keys))
    return long.withColumn("fraction", F.col("fraction") / total)
