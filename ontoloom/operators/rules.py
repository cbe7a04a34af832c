"""DL-safe rules: bodies are joins over named individuals, heads add facts until nothing is new."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import fixpoint


@dataclass(frozen=True)
class Atom:
    """C(x), or r(x, y) when `second` is set. Names that start with '?' are variables."""

    name: str
    first: str
    second: str | None = None


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...]
    head: Atom
    where: str = "true"  # SQL over the variables, without their question marks


def _match(atom: Atom, facts: DataFrame) -> DataFrame:
    """The atom's variables from facts (pred, s, o); a class fact has o = -1."""
    rows = facts.where(F.col("pred") == atom.name)
    terms = [("s", atom.first), ("o", atom.second)] if atom.second else [("s", atom.first)]
    out = []
    for column, term in terms:
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == int(term))
        elif term[1:] in [t for _, t in out]:
            rows = rows.where(F.col(column) == F.col(next(c for c, t in out if t == term[1:])))
        else:
            out.append((column, term[1:]))
    return rows.select(*(F.col(c).alias(t) for c, t in out))


def bindings(rule: Rule, facts: list[DataFrame]) -> DataFrame:
    """Bindings of the body, atom i read from facts[i]: equi-joins on shared variables, in the order Catalyst picks."""
    got = _match(rule.body[0], facts[0])
    for atom, source in zip(rule.body[1:], facts[1:]):
        new = _match(atom, source)
        shared = [c for c in new.columns if c in got.columns]
        got = got.join(new, shared) if shared else got.join(new)
    return got.where(rule.where).distinct()


def chase(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Facts (pred, s, o) closed under the rules; every round has one atom of each body read new facts."""

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        out = None
        for rule in rules:
            for i in range(len(rule.body)):
                got = bindings(rule, [delta if j == i else known for j in range(len(rule.body))])
                h = rule.head
                term = lambda t: F.col(t[1:]) if t and t.startswith("?") else F.lit(int(t) if t else -1)
                rows = got.select(F.lit(h.name).alias("pred"), term(h.first).cast("long").alias("s"), term(h.second).cast("long").alias("o"))
                out = rows if out is None else out.unionByName(rows)
        return out

    return fixpoint(facts.select("pred", "s", "o"), step)
