"""Least fixpoints as driver loops of ordinary Spark jobs, one job a round."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


class Deferred(RuntimeError):
    """The loop reached its cap: no answer is given rather than part of one."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without it gets a fresh temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="ontoloom-"))
    return _LOCAL[0]


def written(df: DataFrame, *by: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, in folders `by` columns if any; its size is known to later plans."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`written`, and the number of rows, counted by the same job."""
    seen = Observation()
    got = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return got, seen.get["n"]


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """An axiom table, written; broadcast if it has at most `most` rows, else left to Spark's own joins. Facts that meet it by role or class
    must not be shuffled by that: all facts of one role would be one task's, as Spark takes a table without statistics for a large one."""
    kept, n = counted(df)
    return F.broadcast(kept) if n <= most else kept


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """Semi-naive least fixpoint. `step(delta, known)` derives rows from at least one row of delta; rows of `known`
    (delta included) are dropped, the rest is the next delta. Every round is written, so a lost executor costs one round.

    What a round derives is looked up in `known` from its own side: a small delta is broadcast and `known` scanned in place, so the
    shuffle of a round follows the delta. Facts over a finite set of names end by themselves, so no operator sets `max_rounds`; a caller
    whose step makes new values may, and gets no answer beyond it."""
    columns = seed.columns
    delta, n = counted(seed.distinct())
    known, rounds, total = delta, 1, n
    while n:
        if max_rounds is not None and rounds > max_rounds:
            raise Deferred(f"no fixpoint after {max_rounds} rounds")
        new, n = counted(step(delta, known).select(*columns).distinct())
        if n:
            # of a round as large as what is known, both sides move once; of a small one only it moves
            old = known if 4 * n > total else known.join(new, columns, "left_semi")
            delta, n = counted(new.join(old, columns, "left_anti"))
            known, rounds, total = known.unionByName(delta), rounds + 1, total + n
            if rounds % 8 == 0:  # many small files become few
                known = written(known)
    return known


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Transitive closure of edges (src, dst); cycles close on themselves."""
    base = edges.select(src, dst).distinct()

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        # doubling: the rounds grow with the logarithm of the longest path
        left = delta.select(F.col(src), F.col(dst).alias("_mid")).join(known.select(F.col(src).alias("_mid"), F.col(dst)), "_mid")
        right = known.select(F.col(src), F.col(dst).alias("_mid")).join(delta.select(F.col(src).alias("_mid"), F.col(dst)), "_mid")
        return left.select(src, dst).unionByName(right.select(src, dst))

    return fixpoint(base, step)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, rep): the smallest node of each connected component, by minimum label and pointer jumping. Labels grow with the nodes, so
    they are joined by sorting and none is sent to the driver, however well its file compresses."""
    moved = lambda df: df.hint("merge")
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    label = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("rep")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(moved(label.withColumnRenamed("node", "y")), "y").groupBy("x").agg(F.min("rep").alias("near"))
        best = label.join(moved(near.withColumnRenamed("x", "node")), "node").select("node", F.col("rep").alias("old"), F.least("rep", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("rep").alias("far"))
        new = written(best.join(moved(jump), "mid").select("node", "old", F.least("mid", "far").alias("rep")))
        changed = new.where("rep <> old").isEmpty()
        label = new.select("node", "rep")
        if changed:
            return label
