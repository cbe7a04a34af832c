"""Classification from axioms to answers: the engine is chosen by what occurs, and nothing is left out in silence."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import el, normalise, types
from ..operators.normalise import BOTTOM, TOP
from ..sources import answers, ofn
from .fixpoint import Deferred, written

# fixed values: heads about individuals; they bear on consistency, so classification alone refuses them
ASSERTIONS = ["ClassAssertion", "ObjectPropertyAssertion", "NegativeObjectPropertyAssertion", "DataPropertyAssertion", "NegativeDataPropertyAssertion", "SameIndividual", "DifferentIndividuals", "HasKey", "DLSafeRule"]


class Answer(NamedTuple):
    engine: str  # el or alc
    consistent: bool
    subs: DataFrame  # sub, sup between named classes; an unsatisfiable one is under owl:Nothing only


def named(column: str):
    """Class names proper, not those that stand for expressions."""
    return ~F.col(column).contains(" ") & ~F.col(column).contains("(")


def class_names(axioms: DataFrame) -> DataFrame:
    """(name): the classes that declarations and class axioms name."""
    declared = ofn.class_names(axioms).where("kind = 'Class'").select("name")
    used = axioms.where(F.col("head").isin("SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion")).select(F.explode("args").alias("name"))
    return declared.unionByName(used).where(named("name") & ~F.col("name").isin(TOP, BOTTOM)).distinct()


def classify(axioms: DataFrame) -> Answer:
    """EL completion where the normal forms take every axiom, else type elimination, else Deferred with what stands in the way."""
    axioms = written(axioms)
    ofn.no_imports(axioms)
    facts = [r["head"] for r in axioms.where(F.col("head").isin(ASSERTIONS)).select("head").distinct().collect()]
    if facts:
        raise Deferred(f"assertions: {', '.join(sorted(facts))}")
    names = written(class_names(axioms))
    tables = normalise.el_tables(axioms)
    if tables.pop("rest").isEmpty():
        kb = el.ELAxioms(axioms.sparkSession, **tables, extra_names=names)
        symbols = kb.symbols()
        done = written(el.complete(kb, symbols))
        subs = written(el.readout(done, symbols).where(named("sub") & named("sup")))
        return Answer("el", el.consistent(done), subs)
    return by_types(axioms, names)


def by_types(axioms: DataFrame, names: DataFrame) -> Answer:
    """Classification by type elimination. The names are those of one TBox; each grows its own types."""
    kb = normalise.alc_tables(axioms)
    known = [r.name for r in names.collect()]  # seeds of the search, as many as the TBox has names
    alive = written(types.alive_types(kb["gcis"], kb["some"], kb["all"], [TOP, *known]))
    subs = types.subsumptions(alive, known).where(named("sub") & named("sup") & (F.col("sup") != TOP))
    return Answer("alc", not alive.where(F.col("root") == TOP).isEmpty(), written(subs))


def lines(axioms: DataFrame) -> DataFrame:
    """The answer as text lines."""
    got = classify(axioms)
    return answers.lines(got.subs, consistent=got.consistent)
