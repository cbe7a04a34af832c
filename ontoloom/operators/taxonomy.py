"""Services over entailed subsumptions: direct links, equivalents, navigation, modules, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure, fixpoint, written


def equivalents(subs: DataFrame) -> DataFrame:
    """(cls, rep): classes that lie under each other, by their smallest name."""
    turned = subs.select(F.col("sub").alias("sup"), F.col("sup").alias("sub"))
    pairs = subs.select("sub", "sup").join(turned, ["sub", "sup"], "left_semi")
    names = subs.select(F.explode(F.array("sub", "sup")).alias("cls")).distinct()
    low = pairs.groupBy(F.col("sub").alias("cls")).agg(F.min("sup").alias("low"))
    return names.join(low, "cls", "left").select("cls", F.least(F.coalesce("low", "cls"), F.col("cls")).alias("rep"))


def direct(subs: DataFrame) -> DataFrame:
    """(sub, sup): links without a class strictly between, over equivalence representatives."""
    rep = written(equivalents(subs))
    a, b = rep.select(F.col("cls").alias("sub"), F.col("rep").alias("x")), rep.select(F.col("cls").alias("sup"), F.col("rep").alias("y"))
    strict = written(subs.join(a, "sub").join(b, "sup").where("x <> y").select(F.col("x").alias("sub"), F.col("y").alias("sup")).distinct())
    between = strict.select("sub", F.col("sup").alias("m")).join(strict.select(F.col("sub").alias("m"), "sup"), "m").select("sub", "sup").distinct()
    return strict.join(between, ["sub", "sup"], "left_anti")


def entailed(subs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (sub, sup) with `entailed`; an unsatisfiable class is under everything."""
    lost = subs.where(F.col("sup") == "owl:Nothing").select("sub", F.lit(True).alias("lost"))
    told = subs.select("sub", "sup", F.lit(True).alias("told")).distinct()
    got = asked.join(told, ["sub", "sup"], "left").join(lost, "sub", "left")
    return got.select("sub", "sup", F.coalesce("told", "lost", F.col("sub") == F.col("sup")).alias("entailed"))


def module(axioms: DataFrame, signature: DataFrame) -> DataFrame:
    """Axioms (id, left array, right array) whose left names are all reachable from the signature: a syntactic module, grown to its fixpoint.

    `axioms` must be small enough for its exploded names to shuffle; each round joins only new names."""
    needs = written(axioms.select("id", F.explode("left").alias("name"), F.size(F.array_distinct("left")).alias("n")).distinct())
    gives = written(axioms.select("id", F.explode(F.array_union("left", "right")).alias("name")).distinct())

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        touched = needs.join(delta, "name", "left_semi").select("id").distinct()
        met = needs.join(touched, "id", "left_semi").join(known.select(F.col("name").alias("k")), F.col("name") == F.col("k")).groupBy("id", "n").agg(F.count(F.lit(1)).alias("m")).where("n = m")
        return gives.join(met, "id", "left_semi").select("name")

    names = fixpoint(signature.select("name"), step)
    met = needs.join(names, "name").groupBy("id", "n").agg(F.count(F.lit(1)).alias("m")).where("n = m")
    return axioms.join(met, "id", "left_semi")


def justifications(told: DataFrame, sub: str, sup: str, cap: int = 10_000) -> DataFrame:
    """(axioms): all minimal sets of told axioms (id, sub, sup) that entail sub <= sup: the simple paths, grown breadth first and
    pruned to those without a smaller one inside. More than `cap` open paths stop the run: no partial answer."""
    spark = told.sparkSession
    edges = written(told.select("id", F.col("sub").alias("x"), F.col("sup").alias("y")).distinct())
    paths = spark.createDataFrame([(sub, [sub], [])], "at string, seen array<string>, axioms array<long>")
    found = None
    while True:
        grown = written(
            paths.join(edges, F.col("at") == F.col("x")).where(~F.array_contains("seen", F.col("y"))).select(
                F.col("y").alias("at"), F.array_append("seen", F.col("y")).alias("seen"), F.array_append("axioms", F.col("id").cast("long")).alias("axioms"))
        )
        n = grown.count()
        if n > cap:
            raise RuntimeError(f"over {cap} open paths; no explanation is given")
        done = grown.where(F.col("at") == sup).select(F.sort_array("axioms").alias("axioms"))
        found = done if found is None else found.unionByName(done)
        if not n:
            break
        paths = grown.where(F.col("at") != sup)
    found = written(found.distinct())
    other = found.select(F.col("axioms").alias("small"))
    smaller = found.join(other, (F.size("small") < F.size("axioms")) & (F.size(F.array_except("small", "axioms")) == 0), "left_semi")
    return found.join(smaller, "axioms", "left_anti")


def told_closure(told: DataFrame) -> DataFrame:
    return closure(told, "sub", "sup")
