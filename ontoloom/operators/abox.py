"""Assertions: materialised types, equality with propagation, clashes, realisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure, components, fixpoint, small, written


def all_types(class_facts: DataFrame, told: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(ind, cls): every class of every individual. The hierarchy is closed once; facts join it once."""
    up = closure(told, "sub", "sup")
    facts = class_facts.select("ind", "cls") if extra is None else class_facts.select("ind", "cls").unionByName(extra.select("ind", "cls"))
    return facts.unionByName(facts.join(up, F.col("cls") == F.col("sub")).select("ind", F.col("sup").alias("cls"))).distinct()


def direct_types(types: DataFrame, told: DataFrame) -> DataFrame:
    """(ind, cls): the most specific types: no other type of the individual lies strictly below."""
    up = closure(told, "sub", "sup")
    strict = up.join(up.select(F.col("sub").alias("sup"), F.col("sup").alias("sub")), ["sub", "sup"], "left_anti")
    covered = types.join(strict, F.col("cls") == F.col("sub")).select("ind", F.col("sup").alias("cls")).distinct()
    return types.join(covered, ["ind", "cls"], "left_anti")


def materialize(class_facts: DataFrame, role_facts: DataFrame, told: DataFrame, conj: DataFrame, some: DataFrame, domain: DataFrame, range_: DataFrame) -> DataFrame:
    """(ind, cls): types under told classes, conjunctions (left, right, sup), some (role, filler, sup), domains and ranges."""
    roles = written(role_facts)
    told, conj, some, domain, range_ = map(small, (told, conj, some, domain, range_))
    seed = class_facts.select("ind", "cls")
    for facts, at in ((domain, "src"), (range_, "dst")):
        seed = seed.unionByName(roles.join(facts, "role").select(F.col(at).alias("ind"), "cls"))
    wanted = written(roles.join(some, "role").select("src", F.col("dst").alias("ind"), "filler", "sup"))

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        out = delta.join(told, F.col("cls") == F.col("sub")).select("ind", F.col("sup").alias("cls"))
        for one, two in (("left", "right"), ("right", "left")):
            half = delta.join(conj, F.col("cls") == F.col(one)).select("ind", F.col(two).alias("need"), "sup")
            other = known.select(F.col("ind").alias("i"), F.col("cls").alias("c"))
            out = out.unionByName(half.join(other, (F.col("ind") == F.col("i")) & (F.col("need") == F.col("c"))).select("ind", F.col("sup").alias("cls")))
        hit = delta.select(F.col("ind").alias("i"), "cls")
        return out.unionByName(wanted.join(hit, (F.col("ind") == F.col("i")) & (F.col("filler") == F.col("cls"))).select(F.col("src").alias("ind"), F.col("sup").alias("cls")))

    return fixpoint(seed, step)


def _to_first(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """(a, b): every value of a group tied to the group's smallest: linear in the group, not its square."""
    low = facts.groupBy(*by).agg(F.min(value).alias("b"))
    return facts.join(low, by).where(F.col(value) != F.col("b")).select(F.col(value).alias("a"), "b").distinct()


def same_functional(role_facts: DataFrame, functional: DataFrame, inverse_functional: DataFrame | None = None) -> DataFrame:
    """(node, rep) of individuals that functional and inverse-functional roles make equal. Merging changes the facts,
    so they are rewritten to representatives until nothing merges."""
    facts = written(role_facts.select("role", "src", "dst"))
    functional = small(functional.select("role").distinct())
    inverse_functional = None if inverse_functional is None else small(inverse_functional.select("role").distinct())
    merged = None
    while True:
        ties = _to_first(facts.join(functional, "role", "left_semi"), ["role", "src"], "dst")
        if inverse_functional is not None:
            ties = ties.unionByName(_to_first(facts.join(inverse_functional, "role", "left_semi"), ["role", "dst"], "src"))
        ties = written(ties)
        if ties.isEmpty():
            break
        rep = components(ties)
        merged = written(rep if merged is None else _compose(merged, rep))
        facts = written(rewrite(facts, rep))
    return role_facts.sparkSession.createDataFrame([], "node long, rep long") if merged is None else merged


def _compose(old: DataFrame, new: DataFrame) -> DataFrame:
    """Representatives after another merge."""
    n = new.select(F.col("node").alias("n"), F.col("rep").alias("r"))
    kept = old.join(n, F.col("rep") == F.col("n"), "left").select("node", F.coalesce("r", "rep").alias("rep"))
    return kept.unionByName(new.join(old.select("node"), "node", "left_anti")).distinct()


def rewrite(facts: DataFrame, rep: DataFrame) -> DataFrame:
    """Role facts with individuals replaced by their representatives."""
    r = rep.select(F.col("node").alias("n"), F.col("rep").alias("r"))
    once = facts.join(r, F.col("src") == F.col("n"), "left").select("role", F.coalesce("r", "src").alias("src"), "dst")
    return once.join(r, F.col("dst") == F.col("n"), "left").select("role", "src", F.coalesce("r", "dst").alias("dst")).distinct()


def same_by_key(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(node, rep): named individuals that agree on all key values (none null) are equal; one aggregate and one join."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    low = known.groupBy(*keys).agg(F.min(node).alias("rep"))
    return known.join(low, keys).select(F.col(node).alias("node"), "rep")


def disjoint_clash(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(ind, a, b): individuals with both classes of a disjoint pair."""
    left = types.join(small(disjoint), F.col("cls") == F.col("a")).select("ind", "a", "b")
    return left.join(types.select(F.col("ind").alias("i"), F.col("cls").alias("c")), (F.col("ind") == F.col("i")) & (F.col("b") == F.col("c"))).select("ind", "a", "b").distinct()


def negative_clash(facts: DataFrame, negative: DataFrame) -> DataFrame:
    """(role, src, dst): entailed role facts that are also denied."""
    return facts.select("role", "src", "dst").join(negative.select("role", "src", "dst"), ["role", "src", "dst"], "left_semi").distinct()


def different_clash(same: DataFrame, different: DataFrame) -> DataFrame:
    """(a, b): pairs asserted different that are equal."""
    rep = same.select(F.col("node").alias("n"), F.col("rep").alias("r"))
    a = different.join(rep, F.col("a") == F.col("n"), "left").select("a", "b", F.coalesce("r", "a").alias("ra"))
    return a.join(rep, F.col("b") == F.col("n"), "left").select("a", "b", "ra", F.coalesce("r", "b").alias("rb")).where("ra = rb").select("a", "b")


def successor_counts(facts: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(role, src, n): distinct successors after equality; a clash with at-most n needs them pairwise different, so this is a count, not a verdict."""
    rows = facts if same is None else rewrite(facts, same)
    return rows.groupBy("role", "src").agg(F.count_distinct("dst").alias("n"))


def quotient(types: DataFrame, same: DataFrame) -> DataFrame:
    """(ind, cls): types shared by all members of an equality class."""
    rep = same.select(F.col("node").alias("ind"), "rep")
    by = types.join(rep, "ind", "left").select(F.coalesce("rep", "ind").alias("rep"), "cls").distinct()
    members = types.select("ind").distinct().join(rep, "ind", "left").select("ind", F.coalesce("rep", "ind").alias("rep"))
    return members.unionByName(rep.select("ind", "rep")).distinct().join(by, "rep").select("ind", "cls")
