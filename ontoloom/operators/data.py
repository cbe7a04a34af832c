"""Data ranges over facts: facet membership, cells of a number line, literal profiles, data clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import small, written


def facet_members(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ind, range_name): facts (ind, value) in half-open intervals (range_name, low, high). The few ranges are joined by a condition."""
    return facts.join(small(ranges), (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high"))).select("ind", "range_name").distinct()


def binned_members(facts: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """facet_members for many ranges: both sides meet in bins of the line, so the join is an equi-join."""
    wide = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    rows = facts.withColumn("bin", F.floor(F.col("value") / width)).join(wide, "bin")
    return rows.where("value >= low and value < high").select("ind", "range_name").distinct()


def cells(bounds: DataFrame) -> DataFrame:
    """(low, high): the cells that all mentioned bounds (value) cut the line into; open ends are null. Bounds are sorted by ranges; each
    range takes its upper end from the next one, so no task holds all of them."""
    parted = written(bounds.select("value").distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    inside = parted.select("part", F.col("value").alias("low"), F.lead("value").over(Window.partitionBy("part").orderBy("value")).alias("high"))
    firsts = parted.groupBy("part").agg(F.min("value").alias("first"))  # a row a range
    following = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("following"))
    inner = inside.join(F.broadcast(following), "part").select("low", F.coalesce("high", "following").alias("high"))
    return inner.unionByName(parted.agg(F.min("value").alias("high")).select(F.lit(None).cast("double").alias("low"), "high"))


def profiles(members: DataFrame) -> DataFrame:
    """(ind, rep): individuals with one and the same set of ranges share a representative."""
    vector = members.groupBy("ind").agg(F.array_sort(F.collect_set("range_name")).alias("ranges"))
    low = vector.groupBy("ranges").agg(F.min("ind").alias("rep"))
    return vector.join(low, "ranges").select("ind", "rep")


def functional_clash(facts: DataFrame) -> DataFrame:
    """(ind, prop): functional data properties with two values (value_key)."""
    return facts.groupBy("ind", "prop").agg(F.count_distinct("value_key").alias("n")).where("n > 1").select("ind", "prop")


def empty_ranges(ranges: DataFrame) -> DataFrame:
    """Properties (prop, items array) whose enumerated ranges have no common value."""
    every = ranges.select("prop", F.explode(F.array_distinct("items")).alias("item")).groupBy("prop", "item").agg(F.count(F.lit(1)).alias("n"))
    total = ranges.groupBy("prop").agg(F.count(F.lit(1)).alias("all"))
    some = every.join(total, "prop").where("n = all").select("prop").distinct()
    return total.select("prop").join(some, "prop", "left_anti")
