"""Clashes of an assertion box and the single answer they add up to. Every check is a join over entailed facts (role, src, dst)
and returns the offenders; equality is given by representatives (node, rep) and applied first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import small
from . import abox


def merged(facts: DataFrame, same: DataFrame | None) -> DataFrame:
    return facts.select("role", "src", "dst") if same is None else abox.rewrite(facts, same)


def irreflexive(facts: DataFrame, roles: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(role, src): irreflexive roles (role) from an individual to itself or to one that equals it."""
    return merged(facts, same).where("src = dst").join(small(roles), "role", "left_semi").select("role", "src").distinct()


def asymmetric(facts: DataFrame, roles: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(role, src, dst): links of asymmetric roles that also run back, each pair once."""
    rows = merged(facts, same).join(small(roles), "role", "left_semi").distinct()
    back = rows.select("role", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rows.join(back, ["role", "src", "dst"], "left_semi").where("src <= dst")


def disjoint_roles(facts: DataFrame, pairs: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(a, b, src, dst): individuals linked by both roles of a disjoint pair (a, b)."""
    rows = merged(facts, same)
    left = rows.join(small(pairs), F.col("role") == F.col("a")).select("a", "b", "src", "dst")
    right = rows.select(F.col("role").alias("b"), "src", "dst")
    return left.join(right, ["b", "src", "dst"], "left_semi").select("a", "b", "src", "dst").distinct()


def self_members(facts: DataFrame, restrictions: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(ind, cls): individuals with a role to themselves, for restrictions (role, cls)."""
    return merged(facts, same).where("src = dst").join(small(restrictions), "role").select(F.col("src").alias("ind"), "cls").distinct()


def self_links(types: DataFrame, restrictions: DataFrame) -> DataFrame:
    """(role, src, dst): members of a self restriction's class have the role to themselves."""
    return types.join(small(restrictions), "cls").select("role", F.col("ind").alias("src"), F.col("ind").alias("dst")).distinct()


def too_many(facts: DataFrame, limits: DataFrame, groups: DataFrame, same: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """(role, src, n): more successors than `limits` (role, most[, cls]) allow, counted within one group (grp, ind) of individuals that are all
    different. A filler class counts only its members in `types` (ind, cls)."""
    rows = merged(facts, same).distinct().join(small((limits.select("role", "most") if types is None else limits).distinct()), "role")
    if types is not None:
        rows = rows.join(types.select(F.col("ind").alias("dst"), "cls").distinct(), ["dst", "cls"], "left_semi")
    # without filler classes rows are distinct already, so nothing is told apart a second time
    n = F.count(F.lit(1)) if types is None else F.count_distinct("dst")
    counted = rows.join(groups.select("grp", F.col("ind").alias("dst")).distinct(), "dst").groupBy("role", "src", "most", "grp").agg(n.alias("n"))
    return counted.where("n > most").groupBy("role", "src").agg(F.max("n").alias("n"))


def functional(facts: DataFrame, roles: DataFrame, different: DataFrame) -> DataFrame:
    """(role, src): functional roles with two successors that are asserted different (a, b)."""
    rows = facts.join(small(roles), "role", "left_semi").select("role", "src", "dst")
    two = rows.join(different, F.col("dst") == F.col("a")).select("role", "src", F.col("b").alias("dst"))
    return two.join(rows, ["role", "src", "dst"], "left_semi").select("role", "src").distinct()


def consistency(checks: dict[str, DataFrame]) -> DataFrame:
    """(why, n): how many offenders each check has, those without any too. An ontology is consistent when every n is 0."""
    out = None
    for why, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(why).alias("why"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def consistent(checks: DataFrame) -> DataFrame:
    """(consistent): the answer, one row."""
    return checks.agg((F.coalesce(F.sum("n"), F.lit(0)) == 0).alias("consistent"))
