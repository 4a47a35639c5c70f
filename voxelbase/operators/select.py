"""Selections: top rows of a group, robust thresholds, nearest partner within a gate, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelbase.functions.scratch import settle


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark keeps n rows a task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    return (F.get(sorted_values, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_values, F.floor(n / 2).cast("int"))) / 2


def robust_threshold(frames: DataFrame, sigmas: float, least: float = 2.220446049250313e-16) -> DataFrame:
    """(view, threshold, above) of each frame: median + sigmas * 1.4826 * MAD; the standard deviation takes the MAD's place where that is ``least`` or less."""
    rows = frames.withColumn("__m", _median(F.array_sort("data")))
    mad = _median(F.array_sort(F.transform("data", lambda x: F.abs(x - F.col("__m")))))
    n = F.size("data")
    mean = F.aggregate("data", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate("data", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    rows = rows.withColumn("__s", 1.4826 * mad)
    rows = rows.withColumn("threshold", F.col("__m") + F.lit(sigmas) * F.when(F.col("__s") > least, F.col("__s")).otherwise(spread))
    return rows.select("view", "threshold", F.size(F.filter("data", lambda x: x > F.col("threshold"))).cast("long").alias("above"))


def nearest(points: DataFrame, targets: DataFrame, gate: float) -> DataFrame:
    """The target within ``gate`` of each point (k, x) that is nearest, (bead, bx); ties go to the smaller bead.

    Distinct places of both are sorted once over ranges of x, and each looks at the last target up to it and
    the first from it on, so no pairs are made. A range knows the targets next to it on either side. Of targets at
    different places whose distances round to the same number the nearer one is taken.
    """
    flags = lambda target: (F.lit(target).alias("target"), F.lit(not target).alias("asks"))
    places = points.select("x", F.lit(None).alias("bead"), *flags(False)).unionByName(targets.select(F.col("bx").alias("x"), "bead", *flags(True)))
    places = places.where(~F.isnan("x")).groupBy("x").agg(F.min("bead").alias("bead"), F.max("target").alias("target"), F.max("asks").alias("asks"))
    places = settle(places.repartitionByRange("x").select("x", "asks", F.spark_partition_id().alias("range"), F.when(F.col("target"), F.struct("x", F.col("bead").isNull().alias("unnamed"), "bead")).alias("at")))
    ends = places.groupBy("range").agg(F.min("at").alias("least"), F.max("at").alias("most"))  # a row for each range
    before, after = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("range"), F.col("range").desc()))
    ends = ends.select("range", F.last("most", ignorenulls=True).over(before).alias("left"), F.last("least", ignorenulls=True).over(after).alias("right"))
    own = Window.partitionBy("range")
    up, down = (F.last("at", ignorenulls=True).over(own.orderBy(o)) for o in (F.col("x"), F.col("x").desc()))
    sides = places.withColumns({"up": up, "down": down}).where("asks").join(F.broadcast(ends), "range")
    sides = sides.select("x", F.coalesce("up", "left").alias("up"), F.coalesce("down", "right").alias("down"))
    away = [F.when(F.abs(F.col("x") - F.col(s)["x"]) <= gate, F.struct(F.abs(F.col("x") - F.col(s)["x"]).alias("d"), F.col(s)["unnamed"].alias("unnamed"), F.col(s)["bead"].alias("bead"))) for s in ("up", "down")]
    found = sides.select("x", F.array_min(F.array(*away)).alias("found")).where("found IS NOT NULL")
    return points.select("k", "x").join(found, "x").groupBy("k").agg(F.min("found").alias("found")).select("k", F.col("found.bead").alias("bead"))


def lower_quantiles(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per group the elements at place floor(q (n - 1)) of the sorted values, without interpolation.

    Equal values are counted before they are sorted, so a group's task sorts distinct values only.
    """
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group)
    counts = counts.withColumns({"up_to": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    at = lambda q: F.min(F.when(F.col("up_to") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col(value)))
    return counts.groupBy(group).agg(*(at(q).alias(name) for name, q in quantiles.items()))


def best(rows: DataFrame, group: str, candidate: str, error: str) -> DataFrame:
    """Each group's candidate of the least error; ties go to the smaller candidate."""
    return rows.groupBy(group).agg(F.min_by(candidate, F.struct(error, candidate)).alias(candidate), F.min(error).alias(error))
