"""Role boxes: hierarchies with inverses, simplicity, regularity, and role closures of facts.

Roles are names; an inverse is written with a leading '-'. Axioms are rows of small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure, fixpoint, small


def flip(role: Column) -> Column:
    return F.when(role.startswith("-"), F.regexp_replace(role, "^-", "")).otherwise(F.concat(F.lit("-"), role))


def super_closure(subrole: DataFrame) -> DataFrame:
    """(sub, sup): reflexive-transitive role hierarchy over signed roles; r below s makes -r below -s."""
    both = subrole.select("sub", "sup").unionByName(subrole.select(flip(F.col("sub")).alias("sub"), flip(F.col("sup")).alias("sup"))).distinct()
    names = both.select(F.explode(F.array("sub", "sup")).alias("sub")).distinct()
    return closure(both, "sub", "sup").unionByName(names.select("sub", F.col("sub").alias("sup"))).distinct()


def non_simple(subrole: DataFrame, chains: DataFrame, transitive: DataFrame) -> DataFrame:
    """(role): composite roles (named), closed upwards through the hierarchy and inverses."""
    seed = chains.select(F.col("sup").alias("role")).unionByName(transitive.select("role")).distinct()
    up = super_closure(subrole)
    signed = seed.unionByName(seed.select(flip(F.col("role")).alias("role")))
    reached = signed.unionByName(signed.join(up, F.col("role") == F.col("sub")).select(F.col("sup").alias("role")))
    return reached.select(F.regexp_replace("role", "^-", "").alias("role")).distinct()


def irregular(subrole: DataFrame, chains: DataFrame) -> DataFrame:
    """(role): chain super-roles on a cycle of the strict order that chains and the hierarchy must share. Recursion at one end and transitivity are exempt."""
    parts = chains.select(F.explode(F.array("first", "second")).alias("low"), F.col("sup").alias("high"))
    strict = parts.where("low <> high").distinct()
    order = strict.unionByName(subrole.select(F.col("sub").alias("low"), F.col("sup").alias("high")).where("low <> high")).distinct()
    reach = closure(order, "low", "high")
    back = strict.join(reach.select(F.col("low").alias("high"), F.col("high").alias("low")), ["high", "low"], "left_semi")
    return back.select(F.col("high").alias("role")).distinct()


def role_facts(facts: DataFrame, subrole: DataFrame, inverse: DataFrame, symmetric: DataFrame, transitive: DataFrame, chains: DataFrame) -> DataFrame:
    """(role, src, dst): closure of role facts under hierarchy, inverses, symmetry, transitivity and binary chains.

    One-premise rules are one join with a small table; chains and transitivity join the round's new facts on both sides,
    partitioned by the middle individual and role."""
    flat = subrole.select("sub", "sup", F.lit(False).alias("turn"))
    flat = flat.unionByName(inverse.select(F.col("role").alias("sub"), F.col("inverse").alias("sup"), F.lit(True).alias("turn")))
    flat = flat.unionByName(inverse.select(F.col("inverse").alias("sub"), F.col("role").alias("sup"), F.lit(True).alias("turn")))
    flat = flat.unionByName(symmetric.select(F.col("role").alias("sub"), F.col("role").alias("sup"), F.lit(True).alias("turn")))
    flat = small(flat)
    two = small(chains.select("first", "second", "sup").unionByName(transitive.select(F.col("role").alias("first"), F.col("role").alias("second"), F.col("role").alias("sup"))))
    seconds = small(two.select("second").distinct())

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        one = delta.join(flat, delta.role == flat.sub).select(
            F.col("sup").alias("role"), F.when(F.col("turn"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("turn"), F.col("src")).otherwise(F.col("dst")).alias("dst")
        )
        out = one
        for a, b in ((delta, known), (known, delta)):
            start = a.join(two, F.col("role") == F.col("first")).select(F.col("src"), F.col("dst").alias("mid"), "second", "sup")
            end = b.select(F.col("src").alias("mid"), F.col("role").alias("second"), "dst").join(seconds, "second", "left_semi")
            out = out.unionByName(start.join(end, ["mid", "second"]).select(F.col("sup").alias("role"), "src", "dst"))
        return out

    return fixpoint(facts.select("role", "src", "dst"), step)


def domain_range(facts: DataFrame, domain: DataFrame, range_: DataFrame) -> DataFrame:
    """(ind, cls) that domains and ranges give."""
    d = facts.join(small(domain), "role").select(F.col("src").alias("ind"), "cls")
    return d.unionByName(facts.join(small(range_), "role").select(F.col("dst").alias("ind"), "cls")).distinct()


def path_automaton(facts: DataFrame, transitions: DataFrame, start: str, accept: list[str]) -> DataFrame:
    """(src, dst) pairs joined by a role path that a nondeterministic automaton (from_state, role, to_state) accepts."""
    transitions = small(transitions)
    first = transitions.where(F.col("from_state") == start).join(facts, "role").select("src", "dst", F.col("to_state").alias("state"))
    moves = facts.join(transitions, "role").select(F.col("src").alias("mid"), "from_state", F.col("dst").alias("next"), "to_state")

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        on = (F.col("dst") == F.col("mid")) & (F.col("state") == F.col("from_state"))
        return delta.join(moves, on).select("src", F.col("next").alias("dst"), F.col("to_state").alias("state"))

    return fixpoint(first, step).where(F.col("state").isin(accept)).select("src", "dst").distinct()
