"""Versioned updates: closures that grow by additions, and sessions fed by a stream of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import closure, fixpoint, written


def add_edges(closed: DataFrame, new: DataFrame, src: str = "sub", dst: str = "sup") -> DataFrame:
    """The closure after adding edges: only pairs that use a new edge are derived."""
    base = new.select(src, dst).distinct()
    known = closed.select(src, dst)
    into = known.select(F.col(src), F.col(dst).alias("_m"))
    # old paths end where a new edge starts, and go on where it ends
    start = base.unionByName(into.join(base.withColumnRenamed(src, "_m"), "_m").select(src, dst)).distinct()
    out = start.unionByName(start.select(F.col(src), F.col(dst).alias("_m")).join(known.select(F.col(src).alias("_m"), F.col(dst)), "_m").select(src, dst)).distinct()

    def step(delta: DataFrame, _: DataFrame) -> DataFrame:
        return delta.select(F.col(src), F.col(dst).alias("_m")).join(out.select(F.col(src).alias("_m"), F.col(dst)), "_m").select(src, dst)

    return known.unionByName(fixpoint(out, step)).distinct()


def remove_edges(told: DataFrame, closed: DataFrame, gone: DataFrame, src: str = "sub", dst: str = "sup") -> DataFrame:
    """The closure after removing told edges: pairs whose source cannot reach a removed edge stay, the others are closed again from what is left."""
    touched = written(gone.select(F.col(src).alias("x")).unionByName(closed.join(gone.select(F.col(src).alias(dst)), dst, "left_semi").select(F.col(src).alias("x"))).distinct())
    left = told.select(src, dst).distinct().join(gone.select(src, dst), [src, dst], "left_anti")
    safe = closed.join(touched.withColumnRenamed("x", src), src, "left_anti").select(src, dst)
    seed = left.join(touched.withColumnRenamed("x", src), src, "left_semi")

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        one = delta.select(F.col(src), F.col(dst).alias("_m"))
        onward = left.unionByName(safe).select(F.col(src).alias("_m"), F.col(dst))
        return one.join(onward, "_m").select(src, dst)

    return safe.unionByName(fixpoint(seed, step)).distinct()


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, sub, sup): rows an update added (+) and took away (-)."""
    plus = after.join(before, ["sub", "sup"], "left_anti").select(F.lit("+").alias("op"), "sub", "sup")
    return plus.unionByName(before.join(after, ["sub", "sup"], "left_anti").select(F.lit("-").alias("op"), "sub", "sup"))


OPERATION = "revision long, op string, sub string, sup string"


class Session:
    """A session of add and remove operations that arrive as JSON lines; each micro-batch commits one revision, or none if it fails."""

    def __init__(self, spark: SparkSession, told: DataFrame):
        self.spark, self.revision = spark, 0
        self.told = written(told.select("sub", "sup").distinct())
        self.closed = written(closure(self.told, "sub", "sup"))

    def commit(self, batch: DataFrame, _batch_id: int) -> None:
        last = batch.groupBy("sub", "sup").agg(F.max_by("op", "revision").alias("op"))
        plus = written(last.where("op = 'add'").select("sub", "sup").join(self.told, ["sub", "sup"], "left_anti"))
        minus = written(last.where("op = 'remove'").select("sub", "sup").join(self.told, ["sub", "sup"], "left_semi"))
        told, closed = self.told, self.closed
        if not minus.isEmpty():
            closed = written(remove_edges(told, closed, minus))
            told = written(told.join(minus, ["sub", "sup"], "left_anti"))
        if not plus.isEmpty():
            closed, told = written(add_edges(closed, plus)), written(told.unionByName(plus))
        self.told, self.closed, self.revision = told, closed, self.revision + 1

    def follow(self, path: str, checkpoint: str):
        """Reads all operations that are in `path` now, as a stream, and commits them."""
        stream = self.spark.readStream.schema(OPERATION).option("maxFilesPerTrigger", 1).json(path)
        return stream.writeStream.foreachBatch(self.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
