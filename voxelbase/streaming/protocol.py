"""Scans that arrive as commands and packets: keyed state says which are taken.

A stream has rows (scan, seq, op, first_view, frames): ``begin`` opens a scan, ``packet`` brings
frames (view, data) from first_view on, ``complete`` closes it once all views have come,
``cancel`` drops it and lets it begin again. The state of a scan (attempt, received, active,
failed) lives across micro-batches and restarts. A command that the state doesn't allow
is answered with ``accepted`` false and changes nothing, save that a packet out of order or
with frames of another size or with values that are not finite fails the scan until it
is cancelled. Rows of one micro-batch are taken in order of seq; a row whose seq was
seen before is answered false and changes nothing, so a producer may send again.

Frames never pass through the state: what has come is kept by micro-batch with each packet's size and whether it is whole,
the state is asked about that alone, and taken packets are then joined to their frames by row.
Taken frames go on to a projection; its partial volumes are kept by micro-batch, scan and
attempt, so a batch that runs again replaces its own part, and what a cancelled attempt
left is never added to the next.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .halo import keyed_state

FRAMES = "array<struct<view: long, data: array<double>>>"
COMMANDS = f"scan string, seq long, op string, first_view long, frames {FRAMES}"
#: What the state is asked: n frames, all of them whole; ``row`` of the micro-batch ``batch`` in which it came.
ASKED = "scan string, seq long, op string, first_view long, n long, whole boolean, row long, batch long"
ANSWERS = "scan string, seq long, op string, accepted boolean, attempt long, received long, active boolean, failed boolean, row long, came long"


class _Scan(StatefulProcessor):
    def __init__(self, views: int):
        self.views = views

    def init(self, handle):
        self.state = handle.getValueState("scan", "attempt long, received long, active boolean, failed boolean, seen long")

    def handleInputRows(self, key, rows, timers):
        attempt, received, active, failed, seen = self.state.get() if self.state.exists() else (0, 0, False, False, -1)
        answers, commands = [], pd.concat(list(rows)).sort_values(["batch", "seq"], kind="stable")
        for seq, op, first, n, whole, row, came in zip(*(commands[c].tolist() for c in ("seq", "op", "first_view", "n", "whole", "row", "batch")), strict=True):
            taken = seq > seen
            seen = max(seen, seq)
            if not taken:
                pass
            elif op == "begin":
                taken = not active
                if taken:
                    attempt, received, active, failed = attempt + 1, 0, True, False
            elif op == "packet":
                taken = active and not failed and first == received and 0 < n <= self.views - received and whole
                if taken:
                    received += n
                elif active:
                    failed = True
            elif op == "complete":
                taken = active and not failed and received == self.views
                active = active and not taken
            elif op == "cancel":
                received, active, failed = 0, False, False
            else:
                taken = False
            answers.append((key[0], seq, op, bool(taken), attempt, received, active, failed, row, came))
        self.state.update((int(attempt), int(received), bool(active), bool(failed), int(seen)))
        yield pd.DataFrame(answers, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def close(self):
        pass


def asked(commands: DataFrame, pixels: int) -> DataFrame:
    """Commands with the number of their frames, and whether these follow first_view one by one, have ``pixels`` values each, and all are finite."""
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    right = F.transform("frames", lambda f, i: (f["view"] == F.col("first_view") + i) & (F.size(f["data"]) == pixels) & F.forall(f["data"], finite))
    return commands.withColumns({"n": F.coalesce(F.when(F.col("frames").isNotNull(), F.size("frames")), F.lit(0)).cast("long"), "whole": F.coalesce(F.forall(right, lambda ok: F.coalesce(ok, F.lit(False))), F.lit(True))})


def answered(questions: DataFrame, views: int) -> DataFrame:
    """The stream of answers to a stream of ``ASKED``."""
    return questions.groupBy("scan").transformWithStateInPandas(_Scan(views), ANSWERS, "append", "none")


def run(commands: DataFrame, views: int, pixels: int, project, path: str) -> None:
    """Take a stream of commands to its present end. ``project``: frames (view, data) to a partial volume (voxel_id, value).

    Below ``path``: ``came`` (commands with their frames), ``log`` (answers), ``parts`` and the checkpoints, kept by batch.
    """
    spark, came = commands.sparkSession, f"{path}/came"

    def keep(batch: DataFrame, number: int) -> None:
        asked(batch, pixels).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{came}/batch={number}")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        taken = spark.read.schema(ANSWERS).parquet(f"{path}/log/batch={number}").where("accepted and op = 'packet'")
        batches = [r.came for r in taken.select("came").distinct().collect()]
        kept = spark.read.schema(f"row long, frames {FRAMES}, batch long").parquet(came).where(F.col("batch").isin(batches)).withColumnRenamed("batch", "came")
        parts = None
        for scan, attempt in taken.select("scan", "attempt").distinct().collect():  # scans that brought frames in this batch
            rows = taken.where((F.col("scan") == scan) & (F.col("attempt") == attempt)).select("came", "row")
            own = kept.join(rows, ["came", "row"]).select(F.explode("frames").alias("f")).select("f.view", "f.data")
            part = project(own).select(F.lit(scan).alias("scan"), F.lit(attempt).cast("long").alias("attempt"), "voxel_id", "value")
            parts = part if parts is None else parts.unionByName(part)
        if parts is not None:
            parts.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    spark.createDataFrame([], f"{COMMANDS}, n long, whole boolean, row long").write.mode("ignore").parquet(f"{came}/batch=-1")  # so that the folder is there
    commands.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/taking").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    with keyed_state(spark):
        questions = spark.readStream.schema(ASKED).parquet(came)
        answered(questions, views).writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def log(spark: SparkSession, path: str) -> DataFrame:
    """Every answer so far, without frames."""
    return spark.read.schema(f"{ANSWERS.split(', row')[0]}, batch long").parquet(f"{path}/log")


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """(scan, voxel_id, value) of scans whose latest attempt is complete."""
    own = Window.partitionBy("scan").orderBy(F.col("seq").desc())
    done = log(spark, path).where("op = 'complete' and accepted").withColumn("n", F.row_number().over(own)).where("n = 1").select("scan", "attempt")
    latest = log(spark, path).groupBy("scan").agg(F.max("attempt").alias("attempt"))
    parts = spark.read.schema("scan string, attempt long, voxel_id long, value double, batch long").parquet(f"{path}/parts")
    return parts.join(done.join(latest, ["scan", "attempt"]), ["scan", "attempt"]).groupBy("scan", "voxel_id").agg(F.sum("value").alias("value"))
