"""Type elimination for ALC: subsumption with disjunction, existentials and universals.

A knowledge base is: gcis (body array, head array: all of body implies some of head), some_right
(a, role, b: a <= some role.b) and all_right (a, role, b: a <= all role.b) over atomic names. A type is a set of names
that satisfies every gci. Types grow from the subsets that violated gcis force (branching on heads) and are eliminated
while an existential has no compatible witness: a greatest fixpoint of anti-joins. The number of types is exponential in the worst case; a caller may set a `cap`, beyond which the
run stops without an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Deferred, small, written


def _met(types: DataFrame, gcis: DataFrame) -> DataFrame:
    """(root, t, id, head): the gcis whose whole body a type has, by an equi-join on the body's names; those without a body hold everywhere."""
    body = gcis.select("id", F.explode("body").alias("name"), F.size("body").alias("n"))
    has = types.select("root", "t", F.explode("t").alias("name"))
    full = has.join(body, "name").groupBy("root", "t", "id", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n").select("root", "t", "id").join(gcis.select("id", "head"), "id")
    always = small(gcis.where("size(body) = 0").select("id", "head"))
    return full.select("root", "t", "id", "head").unionByName(types.select("root", "t").join(always).select("root", "t", "id", "head"))


def _saturate(types: DataFrame, gcis: DataFrame, cap: int | None) -> DataFrame:
    """Every minimal extension of the types that satisfies all gcis; a gci is worked off one at a time in each type."""
    done = None
    while True:
        met = written(_met(types, gcis))
        bad = met.where("size(head) = 0").select("root", "t").distinct()
        hit = met.where(~F.arrays_overlap("head", "t") & (F.size("head") > 0)).groupBy("root", "t").agg(F.min("id").alias("id"))
        open_ = written(types.join(bad, ["root", "t"], "left_anti").join(hit, ["root", "t"], "left"))
        ok = open_.where("id is null").select("root", "t")
        done = written(ok if done is None else done.unionByName(ok).distinct())
        more = open_.where("id is not null").join(gcis, "id").select("root", "t", F.explode("head").alias("x"))
        types = written(more.select("root", F.array_sort(F.array_union("t", F.array("x"))).alias("t")).distinct())
        n = types.count()
        if cap is not None and n > cap:
            raise Deferred(f"over {cap} types")
        if not n:
            return done


def alive_types(gcis: DataFrame, some_right: DataFrame, all_right: DataFrame, names: list[str], cap: int | None = None) -> DataFrame:
    """(root, t): the types that contain a name, are closed under the gcis and have all their witnesses."""
    spark = gcis.sparkSession
    some = small(some_right)
    all_ = small(all_right.select(F.col("a").alias("x"), F.col("role").alias("r"), F.col("b").alias("y")))
    seeds = spark.createDataFrame([(n, [n]) for n in names], "root string, t array<string>")
    types = _saturate(seeds, gcis, cap)
    while True:  # witnesses: b and what universals push, as new seeds, until no new one comes
        wants = types.select("t").distinct().join(some, F.array_contains("t", F.col("a"))).select("t", "role", "b")
        push = wants.join(all_, F.array_contains("t", F.col("x")) & (F.col("role") == F.col("r")), "left")
        seed = push.groupBy("t", "role", "b").agg(F.collect_set("y").alias("ys")).select(F.array_sort(F.array_union(F.array("b"), "ys")).alias("t")).distinct()
        seed = seed.select(F.concat(F.lit("#"), F.array_join("t", ",")).alias("root"), "t")
        new = written(seed.join(types.select("root").distinct(), "root", "left_anti"))
        if new.isEmpty():
            break
        types = written(types.unionByName(_saturate(new, gcis, cap)))
        if cap is not None and types.count() > cap:
            raise Deferred(f"over {cap} types")
        if new.join(types, "root", "left_semi").count() < new.count():  # seeds without any type stay known by an empty marker
            dead = new.join(types.select("root").distinct(), "root", "left_anti").select("root", F.lit(None).cast("array<string>").alias("t"))
            types = written(types.unionByName(dead))
    types = written(types.where("t is not null"))
    while True:
        wants = types.select("root", "t").join(some, F.array_contains("t", F.col("a"))).select("root", "t", "role", "b")
        push = wants.join(all_, F.array_contains("t", F.col("x")) & (F.col("role") == F.col("r")), "left")
        need = push.groupBy("root", "t", "role", "b").agg(F.collect_set("y").alias("ys")).withColumn("seed", F.concat(F.lit("#"), F.array_join(F.array_sort(F.array_union(F.array("b"), "ys")), ",")))
        lost = need.join(types.select(F.col("root").alias("seed")).distinct(), "seed", "left_anti").select("root", "t").distinct()
        kept = written(types.join(lost, ["root", "t"], "left_anti"))
        if kept.count() == types.count():
            return kept
        types = kept


def subsumptions(types: DataFrame, names: list[str]) -> DataFrame:
    """(sub, sup): sup is in every alive type that was grown from sub; without one, sub is under owl:Nothing."""
    spark = types.sparkSession
    own = types.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "root string")), "root")
    total = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    each = own.select("root", F.explode("t").alias("sup")).where("root <> sup").groupBy("root", "sup").agg(F.count(F.lit(1)).alias("m"))
    subs = each.join(total, "root").where("m = n").select(F.col("root").alias("sub"), "sup")
    lost = spark.createDataFrame([(n,) for n in names], "sub string").join(total.select(F.col("root").alias("sub")), "sub", "left_anti")
    return subs.unionByName(lost.select("sub", F.lit("owl:Nothing").alias("sup")))
